"""HTML pages read into nested records: one pass of tokens, with a stack of open elements.

A token is a comment, a declaration, a tag (attributes quoted by either mark, unquoted or bare), the raw content
of a script or style, or text. What a link, a heading or a text belongs to follows from the elements that are
open around it, so a link in a navigation is known by where it stands, not by how it looks. References in links are
resolved as RFC 3986 says, against the page's URL or its base element.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

_VALUE = r"(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))"
_ATTRIBUTE = re.compile(rf"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+{_VALUE})?+")
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?!!--)[!?](?P<declaration>[^>]*+)>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<attributes>(?>[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)*+)[\s/]*+>",
    re.DOTALL,
)
#: Elements whose content isn't markup, and elements that have none.
RAW = {"script", "style", "title", "textarea"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text in these can't be seen.
HIDDEN = {"head", "script", "style", "nav", "template"}
LANDMARKS = ("main", "article", "section", "nav", "aside", "header", "footer")
_LEVELS = {f"h{k}": k for k in range(1, 7)}
#: A start of one of these ends an open paragraph.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def attributes(source: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; the first of equal names counts, a bare one is empty."""
    found: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(source):
        name, *values = match.groups()
        found.setdefault(name.lower(), unescape(next((v for v in values if v is not None), "")))
    return found


def ampersands(text: str) -> str:
    """Text as the source states it, but for `&amp;`: what the SQL of queries over given pages reads."""
    return text.replace("&amp;", "&")


def tokens(html: str, decoded: Callable[[str], str] = unescape) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, what, attributes): start and end with a tag's name, text, declaration and comment. `decoded` resolves
    the references of texts."""
    at = 0
    # Behind the last `>` is text, unless a comment that doesn't end hides the rest.
    last = len(html) if html.rfind("<!--") > html.rfind("-->") else html.rfind(">") + 1
    while (match := _TOKEN.search(html, at, last)) is not None:
        if match.start() > at:
            yield "text", decoded(html[at : match.start()]), {}
        at = match.end()
        if match["comment"] is not None:
            yield "comment", match["comment"], {}
        elif match["declaration"] is not None:
            yield "declaration", match["declaration"], {}
        else:
            name = match["tag"].lower()
            if match["end"]:
                yield "end", name, {}
                continue
            yield "start", name, attributes(match["attributes"])
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.IGNORECASE).search(html, at)
                inside = html[at : close.start() if close else len(html)]
                if inside:
                    yield "text", inside if name in ("script", "style") else decoded(inside), {}
                at = close.end() if close else len(html)
                yield "end", name, {}
    if at < len(html):
        yield "text", decoded(html[at:]), {}


def resolve(href: str | None, base: str) -> str | None:
    """A reference's target without its fragment; null for fragments alone, scripts, mail and telephones."""
    if href is None or not (bare := urldefrag(href.strip())[0]):
        return None
    try:
        if urlsplit(bare).scheme.lower() in ("javascript", "mailto", "tel", "data"):
            return None
        return urljoin(base, bare)
    except ValueError:
        return None


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Record:
    """A page's record, as its tokens come."""

    def __init__(self, url: str) -> None:
        self.base, self.based, self.open, self.depth = url, False, [], Counter()
        self.title: list[str] | None = None
        self.titles = 0
        self.metas: dict[str, str] = {}
        self.charset = self.doctype = False
        self.row: dict[str, list] = {k: [] for k in ("canonicals", "headings", "links", "images", "styles", "scripts", "json_ld", "dates", "paragraphs")}
        self.seen: list[str] = []
        self.landmarks: Counter = Counter()
        #: Texts being gathered, by the open element they belong to.
        self.gathering: list[tuple[str, list[str], dict]] = []

    def start(self, name: str, given: dict[str, str]) -> None:
        if name in _BLOCKS and self.depth["p"]:
            self.end("p")
        if name in self.landmarks or name in LANDMARKS:
            self.landmarks[name] += 1
        if name == "base" and not self.based and given.get("href"):
            self.base, self.based = urljoin(self.base, given["href"]), True
        elif name == "meta":
            self.charset = self.charset or "charset" in given or "charset=" in given.get("content", "").lower()
            self.metas.setdefault(given.get("name", "").lower(), given.get("content", ""))
        elif name == "link":
            kinds = given.get("rel", "").lower().split()
            if "canonical" in kinds:
                self.row["canonicals"].append(given.get("href"))
            if "stylesheet" in kinds:
                self.row["styles"].append(given.get("href"))
        elif name == "img":
            self.row["images"].append({k: given.get(k) for k in ("src", "alt", "width")})
        elif name == "script":
            if given.get("src") is not None:
                self.row["scripts"].append(given["src"])
            if given.get("type", "").lower().split(";")[0].strip() == "application/ld+json":
                self.gathering.append((name, [], {}))
        elif name == "title":
            self.titles += 1
            if self.title is None:
                self.title = []
                self.gathering.append((name, self.title, {}))
        elif name == "time":
            self.row["dates"].append(given.get("datetime"))
        elif name in _LEVELS or name == "p":
            self.gathering.append((name, [], given))
        elif name == "a":
            if self.depth["a"]:
                self.end("a")
            inside = bool(self.depth["nav"])
            self.gathering.append((name, [], {"href": given.get("href"), "rel": given.get("rel"), "target": resolve(given.get("href"), self.base), "nav": inside}))
        if name not in VOID:
            self.open.append(name)
            self.depth[name] += 1

    def end(self, name: str) -> None:
        """Closes the last open element of that name, and all that were opened in it."""
        if not self.depth[name]:
            return
        while True:
            last = self.open.pop()
            self.depth[last] -= 1
            self._finish(last)
            if last == name:
                return

    def _finish(self, name: str) -> None:
        if not self.gathering or self.gathering[-1][0] != name:
            return
        _, parts, given = self.gathering.pop()
        if name == "a":
            self.row["links"].append({"text": _squeezed(parts), **given})
        elif name == "script":
            self.row["json_ld"].append("".join(parts))
        elif name == "p":
            if text := _squeezed(parts):
                self.row["paragraphs"].append(text)
        elif name in _LEVELS:
            self.row["headings"].append({"level": _LEVELS[name], "text": _squeezed(parts)})
        if name in ("a", "p", *_LEVELS) and self.gathering and self.gathering[-1][0] != "title":
            self.gathering[-1][1].extend(parts)

    def text(self, what: str) -> None:
        if self.gathering:
            self.gathering[-1][1].append(what)
        if not any(self.depth[h] for h in HIDDEN) and not self.depth["title"]:
            self.seen.append(what)

    def finished(self) -> dict:
        while self.open:
            self.end(self.open[-1])
        text = _squeezed(self.seen)
        return {
            **self.row, "title": None if self.title is None else "".join(self.title), "titles": self.titles, "description": self.metas.get("description"), "robots": self.metas.get("robots"),
            "viewport": self.metas.get("viewport"), "charset": self.charset, "doctype": self.doctype, "main": bool(self.landmarks["main"] or self.landmarks["article"]),
            "landmarks": {k: self.landmarks[k] for k in LANDMARKS}, "text": text, "words": len(text.split(" ")) if text else 0,
        }


def record(html: str, url: str, decoded: Callable[[str], str] = unescape) -> dict:
    """A page's record."""
    page = _Record(url)
    for kind, what, given in tokens(html, decoded):
        if kind == "start":
            page.seen.append(" ")
            page.start(what, given)
        elif kind == "end":
            page.seen.append(" ")
            page.end(what)
        elif kind == "text":
            page.text(what)
        elif kind == "declaration" and what.lower().startswith("doctype"):
            page.doctype = True
    return page.finished()


_LINK = pa.struct([("href", pa.string()), ("text", pa.string()), ("rel", pa.string()), ("target", pa.string()), ("nav", pa.bool_())])
FIELDS = [
    ("title", pa.string()), ("titles", pa.int32()), ("description", pa.string()), ("canonicals", pa.list_(pa.string())), ("robots", pa.string()), ("viewport", pa.string()),
    ("charset", pa.bool_()), ("doctype", pa.bool_()), ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))), ("links", pa.list_(_LINK)),
    ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string()), ("width", pa.string())]))), ("styles", pa.list_(pa.string())), ("scripts", pa.list_(pa.string())),
    ("json_ld", pa.list_(pa.string())), ("dates", pa.list_(pa.string())), ("paragraphs", pa.list_(pa.string())), ("main", pa.bool_()),
    ("landmarks", pa.struct([(k, pa.int32()) for k in LANDMARKS])), ("text", pa.string()), ("words", pa.int32()),
]


def records(pages: DataFrame, html: str = "html", url: str = "url", rows: int = 64, decoded: Callable[[str], str] = unescape) -> DataFrame:
    """The pages' other columns, and each page's record. Null HTML gives an empty record."""
    carried = [f for f in pages.schema.fields if f.name != html]
    schema = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in carried), *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = [record(h or "", u or "", decoded) for h, u in zip(part.column(html).to_pylist(), part.column(url).to_pylist(), strict=True)]
                columns = [part.column(f.name) for f in carried] + [pa.array([r[n] for r in found], kind) for n, kind in FIELDS]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return pages.mapInArrow(run, from_arrow_schema(schema))
