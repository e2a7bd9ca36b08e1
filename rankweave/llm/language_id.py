"""Language identification by interpolated Kneser-Ney character models.

Training counts character n-grams of labelled texts in Spark, derives continuation counts and
discounts by grouping, and interpolates each order with the next lower one. Every n-gram that any
language has seen gets its finished log-probability in all languages; these stand in one array,
sorted by the 64-bit hash of the n-gram, so that scoring needs one binary search a character (and
more only where the full context was never seen). A text goes to the language of the lowest
cross-entropy a character. A second, disjoint part of the training rows calibrates a temperature for
the score (on whole rows and on short pieces of them) and, per language, how far a text's cross-entropy
lies from its own language's; languages of fewer than five such rows share the others' width. Texts
farther out than KEEP of the calibration rows are rejected, and their score falls off with the
distance. Only with no calibration row that the model gets right (no language of two ids or more) is
every text with a letter accepted.

The fit uses a sample of about `max_docs` labelled rows per language, picked by a hash of doc_id at a
rate that one count per language sets, so the model's size does not grow with the corpus. With many
languages the rarest full-width n-grams are left out, so that the model stays below MODEL_BYTES. Whole
texts are counted and scored.

Null texts and texts without a letter get `und`, score 0 and are rejected. Rows without lang, or with
an empty table, teach nothing; with no language learned every text is `und`. Ties go to the language
that is first by code point. Repeated rows are scored alike. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.memory import give_back
from rankweave.llm.shared import cut, mix64

ORDER = 4
MAX_DOCS = 1500
CALIBRATION_DOCS = 500
KEEP = 0.999
PIECE = 24
MODEL_BYTES = 256 << 20
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PAD = "\x02"


def plain(text: str) -> str:
    """Lower case, with runs of anything but letters as one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def _codes(text: str) -> np.ndarray:
    padded = _PAD * (ORDER - 1) + f" {text} "
    return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def gram_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the `width` characters that end at each position from ORDER - 1 on. Code
    points need 21 bits, so up to three characters pack exactly; the fourth is mixed in."""
    n = len(codes) - ORDER + 1
    acc = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        at = ORDER - 1 - (width - 1 - k)
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + codes[at : at + n] + np.uint64(1)
    return mix64(acc)


@dataclass
class CharModel:
    """Sorted hashes per order with a row of values per n-gram and a column per language."""

    languages: list[str]
    keys: list[np.ndarray]  # by width - 1
    log_p: list[np.ndarray]
    context_keys: list[np.ndarray]  # by width of the context
    back_off: list[np.ndarray]
    floor: np.ndarray
    temperature: float
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    reject_at: float

    def entropies(self, text: str) -> tuple[np.ndarray, int]:
        """Nats a character in each language, and the characters."""
        codes = _codes(text)
        n = len(codes) - ORDER + 1
        total = np.zeros(len(self.languages))
        part = 1 << 16  # long texts go through in blocks of bounded memory
        for first in range(0, n, part):
            block = codes[first : first + part + ORDER - 1]
            carried: np.ndarray | None = None
            hashed_at = np.arange(len(block) - ORDER + 1)
            for width in range(ORDER, 0, -1):
                hashed = gram_hashes(block, width)[hashed_at]
                keys = self.keys[width - 1]
                at = np.searchsorted(keys, hashed)
                at[at == len(keys)] = 0
                hit = keys[at] == hashed if len(keys) else np.zeros(len(hashed), dtype=bool)
                values = self.log_p[width - 1][at[hit]]
                total += values.sum(axis=0, dtype=np.float64)
                if carried is not None:
                    total += carried[hit].sum(axis=0, dtype=np.float64)
                if hit.all():
                    hashed_at = hashed_at[:0]
                    break
                hashed_at = hashed_at[~hit]
                carried = carried[~hit] if carried is not None else np.zeros((len(hashed_at), len(self.languages)))
                if width > 1:
                    context = self.context_keys[width - 1]
                    before = _context_hashes(block, width)[hashed_at]
                    to = np.searchsorted(context, before)
                    to[to == len(context)] = 0
                    seen = context[to] == before if len(context) else np.zeros(len(before), dtype=bool)
                    carried[seen] += self.back_off[width - 1][to[seen]]
            if len(hashed_at):
                total += carried.sum(axis=0) + len(hashed_at) * self.floor
        return -total / n, n

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        """Language, score, accepted and cross-entropy of a whole text."""
        simple = plain(text) if text else ""
        if not simple or not self.languages:
            return "und", 0.0, False, 0.0
        entropy, n = self.entropies(simple)
        best = int(np.argmin(entropy))
        share = np.exp(-(entropy - entropy[best]) * min(n, 200) / self.temperature)
        odd = (entropy[best] - self.mean[best]) / np.sqrt(self.spread[best] ** 2 + self.noise[best] ** 2 / n)
        score = np.exp(min(0.0, self.reject_at - odd)) / share.sum()
        return self.languages[best], float(score), bool(odd <= self.reject_at), float(entropy[best])


def _context_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the width - 1 characters before each position."""
    shifted = np.concatenate([np.zeros(1, np.uint64), codes[:-1]])
    return gram_hashes(shifted, width - 1)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the full-width n-grams (as strings) per language, summed within a batch."""
    from collections import Counter

    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            padded = _PAD * (ORDER - 1) + f" {plain(text)} "
            counts.setdefault(lang, Counter()).update(padded[k : k + ORDER] for k in range(len(padded) - ORDER + 1))
        flat = [(lang, gram, n) for lang, c in counts.items() for gram, n in c.items()]
        columns = list(zip(*flat, strict=True)) if flat else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["lang", "gram", "n"])


def _sample(rows: DataFrame, per_language: int, calibration: int) -> DataFrame:
    """About so many rows of each language, with `part` 0 to count and 1 to calibrate. A second hash
    deals the picked rows of every language in the same proportion; of two ids or more, the lowest by
    the first hash counts and the highest calibrates, so that no language lacks either."""
    at = (F.xxhash64(F.lit("language-sample"), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("at")
    placed = rows.select("doc_id", "lang", "text", at)
    totals = placed.groupBy("lang").agg(F.count("*").alias("total"), F.min("at").alias("low"), F.max("at").alias("high"))
    picked = placed.join(F.broadcast(totals) if _few(totals) else totals, "lang").where(F.col("at") * F.col("total") < per_language + calibration)
    dealt = F.pmod(F.xxhash64(F.lit("language-part"), "doc_id"), F.lit(per_language + calibration)) < calibration
    return picked.select("lang", "text", F.when(F.col("at") == F.col("low"), 0).when(F.col("at") == F.col("high"), 1).otherwise(dealt.cast("int")).alias("part"))


def _few(totals: DataFrame, most: int = 1000) -> bool:
    """Whether there are few enough languages to send their counts to all tasks."""
    return totals.limit(most + 1).count() <= most


def train(labelled: DataFrame, max_docs: int = MAX_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> CharModel:
    """Fits on rows with doc_id, text and lang; rows with a null in text or lang teach nothing."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sample = cut(_sample(rows, max_docs, calibration_docs))
    grams = cut(sample.where("part = 0").select("lang", "text").mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    levels = {ORDER: grams}
    for width in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before the n-gram
        levels[width] = levels[width + 1].groupBy("lang", F.substring("gram", 2, width).alias("gram")).agg(F.count("*").alias("n"))
    tables = {}
    least = _least_count(grams)
    if least > 1:
        levels[ORDER] = grams.join(grams.groupBy("gram").agg(F.max("n").alias("most")).where(F.col("most") >= least).select("gram"), "gram", "left_semi")
    for width, level in levels.items():
        known = level.where(~F.substring("gram", width, 1).eqNullSafe(F.lit(_PAD))) if width < ORDER else level
        tables[width] = known.toPandas()
    languages = sorted(set(tables[ORDER]["lang"]), key=lambda s: s.encode())
    model = _interpolate(languages, tables)
    return _calibrate(model, sample.where("part = 1").select("lang", "text"))


def _least_count(grams: DataFrame, most_bytes: int = MODEL_BYTES) -> int:
    """The smallest count in any language from which on n-grams fit into the model: each takes a row of
    one number a language. One count per count value comes to the driver, 64 at most."""
    languages = grams.select("lang").distinct().count()
    by_count = grams.groupBy("gram").agg(F.least(F.max("n"), F.lit(64)).alias("most")).groupBy("most").agg(F.count("*").alias("k")).collect()
    kept = 0
    for count, k in sorted(((r["most"], r["k"]) for r in by_count), reverse=True):
        kept += k
        if kept * 8 * languages > most_bytes:
            return count + 1
    return 1


def _interpolate(languages: list[str], tables: dict) -> CharModel:
    index = {x: k for k, x in enumerate(languages)}
    L = len(languages)
    keys: list[np.ndarray] = []
    log_p: list[np.ndarray] = []
    context_keys: list[np.ndarray] = [np.empty(0, np.uint64)]
    back_off: list[np.ndarray] = [np.empty((0, L))]
    characters = max(1, len(set(tables[1]["gram"])) + 1) if languages else 1
    floor = np.full(L, -np.log(characters))
    below: dict[str, np.ndarray] = {}
    for width in range(1, ORDER + 1):
        t = tables[width]
        grams = sorted(set(t["gram"]))
        row = {g: k for k, g in enumerate(grams)}
        counts = np.zeros((len(grams), L))
        counts[[row[g] for g in t["gram"]], [index[x] for x in t["lang"]]] = t["n"]
        once, twice = (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)
        discount = np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5).clip(0.1, 0.95)
        contexts = sorted({g[:-1] for g in grams})
        of = {c: k for k, c in enumerate(contexts)}
        owner = np.array([of[g[:-1]] for g in grams], dtype=np.int64)
        total, kinds = np.zeros((len(contexts), L)), np.zeros((len(contexts), L))
        np.add.at(total, owner, counts)
        np.add.at(kinds, owner, counts > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        lower = np.full((len(grams), L), 1.0 / characters) if width == 1 else np.array([below[g[1:]] if g[1:] in below else np.full(L, 1.0 / characters) for g in grams]).reshape(len(grams), L)
        p = np.where(total[owner] > 0, np.maximum(counts - discount, 0) / np.maximum(total[owner], 1), 0.0) + weight[owner] * lower
        if width == 1:
            floor = np.log(weight[0] / characters) if len(weight) else floor
        below = dict(zip(grams, p, strict=True))
        hashed = np.array([gram_hashes(_tail(g), width)[0] for g in grams], dtype=np.uint64)
        order = np.argsort(hashed)
        keys.append(hashed[order])
        log_p.append(np.log(p[order]))
        if width > 1:
            before = np.array([gram_hashes(_tail(c), width - 1)[0] for c in contexts], dtype=np.uint64)
            order = np.argsort(before)
            context_keys.append(before[order])
            back_off.append(np.log(weight[order]))
    return CharModel(languages, keys, log_p, context_keys, back_off, floor, 1.0, np.zeros(L), np.ones(L), np.ones(L), np.inf)


def _tail(gram: str) -> np.ndarray:
    """Codes of one n-gram, behind as much padding as makes its end the first position."""
    return np.frombuffer((_PAD * (ORDER - len(gram)) + gram).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _range(apart: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Spread of longer texts' distances from the median cross-entropy, and the noise of n characters; by
    medians, as a single odd row would widen a mean for all."""
    long_ = apart[n >= np.median(n)]
    return max(0.02, 1.4826 * np.median(np.abs(long_))), max(1.0, 1.4826 * np.median(np.abs(apart) * np.sqrt(n)))


def _calibrate(model: CharModel, rows: DataFrame) -> CharModel:
    """Sets mean and spread of the cross-entropy per language, the share of noise that shorter texts
    add (both pooled over languages where fewer than five rows tell), the rejection bound (that which
    KEEP of the calibration rows that the model gets right don't exceed, the largest of few rows) and
    the temperature of the score."""
    if not model.languages:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if simple := plain(text):
                    middle = max(0, (len(simple) - PIECE) // 2)
                    for whole, part in ((True, simple), (False, simple[middle : middle + PIECE])):
                        entropy, n = shared.value.entropies(part)
                        out.append((lang, whole, n, entropy.tolist()))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "whole", "n", "entropy"])

    found = rows.mapInArrow(run, "lang string, whole boolean, n long, entropy array<double>").toPandas()
    if not len(found):
        return model
    model.temperature = _temperature(model, found)
    seen = found[found["whole"]]
    entropy = np.stack(seen["entropy"].to_numpy())
    n = seen["n"].to_numpy(dtype=float)
    truth = np.array([model.languages.index(x) if x in model.languages else -1 for x in seen["lang"]])
    best = entropy.argmin(axis=1)
    own = [(truth == k) & (best == k) for k in range(len(model.languages))]
    right = np.logical_or.reduce(own)
    if right.any():
        middle = np.array([np.median(entropy[o, k]) if o.any() else np.nan for k, o in enumerate(own)])
        apart, m = entropy[right, truth[right]] - middle[truth[right]], n[right]
        pooled = _range(apart, m)
        model.mean = np.where(np.isnan(middle), np.median(entropy[right, truth[right]]), middle)
        for k, o in enumerate(own):
            model.spread[k], model.noise[k] = _range(entropy[o, k] - middle[k], n[o]) if o.sum() >= 5 else pooled
        odd = apart / np.sqrt(model.spread[truth[right]] ** 2 + model.noise[truth[right]] ** 2 / m)
        place = min(len(odd), int(np.ceil((len(odd) + 1) * KEEP)))
        model.reject_at = max(4.0, float(np.sort(odd)[place - 1]))
    return model


def _temperature(model: CharModel, found: pd.DataFrame) -> float:
    """That of the least log-loss over texts and pieces; the languages are smoothed by one more text that
    is as likely of any, so that rows which are all right don't ask for certainty."""
    truth = np.array([model.languages.index(x) if x in model.languages else -1 for x in found["lang"]])
    known = truth >= 0
    if not known.any():
        return model.temperature
    entropy = np.stack(found["entropy"].to_numpy())[known]
    n = found["n"].to_numpy(dtype=float)[known]
    gaps = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(n, 200)[:, None]
    want = np.full(entropy.shape, 1 / (len(n) + 1) / entropy.shape[1])
    want[np.arange(len(n)), truth[known]] += len(n) / (len(n) + 1)
    losses = {}
    for t in np.geomspace(0.5, 50, 60):
        logs = -gaps / t - np.log(np.exp(-gaps / t).sum(axis=1, keepdims=True))
        losses[float(t)] = -(want * np.maximum(logs, -14)).sum(axis=1).mean()
    return min(losses, key=losses.get)


def predict(docs: DataFrame, model: CharModel) -> DataFrame:
    """doc_id, lang_pred, score, accepted and entropy of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(text.as_py()) for text in batch.column(1)]
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True))],
                names=["doc_id", "lang_pred", "score", "accepted", "entropy"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean, entropy double")


def accepts(model: CharModel, docs: DataFrame) -> Column:
    """A column over `text` that is true where the model accepts the text; rows keep all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield text.map(lambda t: shared.value.predict(t)[2]).astype(bool)
        give_back()

    return accepted(F.col("text"))
