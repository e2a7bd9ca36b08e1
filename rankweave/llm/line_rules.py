"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text
goes with them.

Rules of a line (the first that applies names it): `symbols` (a tenth or more of its visible characters
are of `#*$%&|<>{}`), `navigation` (separators between short entries), `boilerplate` (a stock phrase
of one of four languages, such as a cookie notice), `punctuation` (a line of more than `heading_words` words without sentence
punctuation at its end). Lines without words are neither judged nor counted.

Before that, whole-document counts rule out short or repetitive texts: fewer than `least_words` words, or
more than half of all words in 3-word windows that the text has twice or more.

Null and empty texts have no words and fail. Texts are judged whole, whatever their length. Repeated
rows each come back, alike. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.llm.shared import shingle_hashes, word_hashes

LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
MOST_LOSS = 0.5
HEADING_WORDS = 12
SYMBOLS = b"#*$%&|<>"
_LINE_SYMBOLS = re.compile(r"[#*$%&|<>{}]")
_SEPARATORS = re.compile(r"(?:^|\s)(?:[|>»›·•/]|::|-{1,2})(?=\s|$)")
_ENDS = re.compile(r"[.!?…:;。！？]['\"”’»)\]]*$")
#: Stock phrases by language. Each holds one of HINTS, by which most texts are let through at once.
STOCK = {
    "en": r"cookies? (?:policy|notice|settings)|accept (?:all )?cookies|all rights reserved|terms (?:of (?:use|service)|and conditions)|privacy policy|"
    r"(?:enable|turn on) javascript|sign (?:in|up)|log ?in|subscribe (?:now|to our)|skip to content|click here|share (?:this|on)|read more|back to top",
    "fr": r"tous droits réservés|politique de (?:confidentialité|cookies)|mentions légales|conditions (?:générales|d['’]utilisation)|(?:accepter|gérer) (?:tous )?les cookies|"
    r"active[rz] javascript|se connecter|connectez-vous|inscrivez-vous|abonnez-vous|aller au contenu|cliquez ici|lire la suite|partager (?:sur|cet)|haut de page",
    "de": r"alle rechte vorbehalten|datenschutz(?:erklärung|hinweise?|bestimmungen)?|impressum|nutzungsbedingungen|allgemeine geschäftsbedingungen|cookie-(?:richtlinie|einstellungen|hinweis)|"
    r"(?:alle )?cookies akzeptieren|javascript aktivieren|(?:jetzt )?anmelden|registrieren|newsletter abonnieren|zum inhalt springen|hier klicken|weiterlesen|mehr lesen|nach oben",
    "es": r"todos los derechos reservados|política de (?:privacidad|cookies)|aviso legal|términos y condiciones|condiciones de uso|aceptar (?:todas )?(?:las )?cookies|"
    r"activ(?:ar|e) javascript|iniciar sesión|inicia sesión|regístrate|suscríbete|suscribirse|saltar al contenido|haga clic aquí|haz clic aquí|leer más|compartir en|volver arriba",
}
HINTS = (
    "cookie", "rights", "terms of", "terms and", "privacy", "javascript", "sign in", "sign up", "login", "log in", "subscribe", "skip to", "click here", "share ", "read more", "back to top",
    "droits", "confidentialité", "légales", "conditions", "connecter", "connectez", "inscrivez", "abonnez", "aller au", "cliquez", "lire la", "partager", "haut de",
    "rechte", "datenschutz", "impressum", "bedingungen", "anmelden", "registrieren", "abonnieren", "zum inhalt", "klicken", "weiterlesen", "mehr lesen", "nach oben",
    "derechos", "privacidad", "aviso legal", "términos", "condiciones", "sesión", "regístrate", "suscrí", "suscribirse", "saltar al", "haga clic", "haz clic", "leer más", "compartir", "volver arriba",
)
_STOCK = re.compile(r"\b(?:" + "|".join(STOCK.values()) + r")\b")


def has_hint(text: str) -> bool:
    """Whether a lower-case text may hold a stock phrase."""
    return any(hint in text for hint in HINTS)


def failed_rule(line: str, words: int, heading_words: int = HEADING_WORDS, hinted: bool = True) -> str | None:
    """The rule that a line with words breaks, if any. `hinted` is false where no line has a stock phrase."""
    bare = line.strip()
    symbols = len(_LINE_SYMBOLS.findall(bare))
    if not bare or symbols and 10 * symbols >= sum(map(len, bare.split())):
        return "symbols"
    if (cuts := len(_SEPARATORS.findall(bare))) >= 2 and 4 * cuts >= words:
        return "navigation"
    if hinted and words <= 25 and _STOCK.search(bare.lower()):
        return "boilerplate"
    if words > heading_words and not _ENDS.search(bare):
        return "punctuation"
    return None


def clean(text: str | None, heading_words: int = HEADING_WORDS) -> tuple[str, int, int, dict[str, int]]:
    """The text without failing lines, its words before and after, and the failed lines by rule."""
    lines, before, after, failed = [], 0, 0, {}
    hinted = has_hint((text or "").lower())
    for line in (text or "").split("\n"):
        words = len(line.encode("utf-8", "surrogatepass").split())
        rule = failed_rule(line, words, heading_words, hinted) if words else None
        before += words
        if rule:
            failed[rule] = failed.get(rule, 0) + 1
        else:
            after += words
            lines.append(line)
    return "\n".join(lines), before, after, failed


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hashes = word_hashes(raw)
    n = len(hashes)
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            repeated_lines += line in seen
            seen.add(line)
    repeated = 0
    if n >= 3:
        windows = shingle_hashes(hashes, 3)
        _, back, often = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(often[back] > 1)
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[at + k] = True
        repeated = int(covered.sum())
    return n, len(text or "") - spaces, symbols, repeated_lines, repeated


def judge(docs: DataFrame, least_words: int = LEAST_WORDS, most_repeat_percent: int = MOST_REPEAT_PERCENT, most_loss: float = MOST_LOSS, with_text: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, kept, lost_words and, if asked for, the cleaned text of each row."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", *["clean_text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, chars, symbols, dup_lines, repeats = counts(text)
                failed = n < least_words or 100 * repeats > most_repeat_percent * n
                cleaned, before, after, _ = clean(text)
                kept = not failed and before - after <= most_loss * before
                rows.append((n, chars, symbols, dup_lines, repeats, failed, kept, before - after, *[cleaned] * with_text))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long" + ", clean_text string" * with_text
    return docs.select("doc_id", "text").mapInArrow(run, schema)
