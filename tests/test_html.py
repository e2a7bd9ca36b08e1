"""The HTML tokenizer against the standard library's parser over all given pages, and records of odd pages."""

from __future__ import annotations

from html.parser import HTMLParser

import duckdb
import pytest

from rankweave.operators import html
from tests.conftest import SF


class Plain(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__()
        self.found: list = []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        kept: dict = {}
        for k, v in attrs:
            kept.setdefault(k, v or "")
        self.found.append(("start", tag, kept))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.found.append(("end", tag, {}))

    def handle_data(self, data):
        if self.found and self.found[-1][0] == "text":
            self.found[-1] = ("text", self.found[-1][1] + data, {})
        else:
            self.found.append(("text", data, {}))

    def handle_comment(self, data):
        self.found.append(("comment", data, {}))

    def handle_decl(self, decl):
        self.found.append(("declaration", decl, {}))


def same(source: str) -> None:
    assert [t for t in html.tokens(source) if t[1]] == [t for t in Plain(source).found if t[1]]


def test_tokens_of_all_given_pages():
    pages = duckdb.sql(f"SELECT html FROM '{SF.replace('0.01', '0.1')}/pages.parquet' WHERE html IS NOT NULL").fetchall()
    assert len(pages) > 1000
    for (source,) in pages:
        same(source)


@pytest.mark.parametrize(
    "source",
    [
        """<meta name="d" content="Joe's pizza and more">""", "<meta content='say \"hi\"' name=d>", "<a href=/x/y?a=1&amp;b=2 target=_blank>t</a>", "<input disabled value=a checked>", "<A HREF = '/up'>x</A>",
        "<!-- a < b > c -- d --><p>t", "<!doctype html><p>a &lt; b &amp;&copy; &#233;", "<script>if (a < b && c > '</p>') {}</script><p>x", "<style>p > a {}</style>", "<p title='a > b'>x</p>", "<br/><img src=a.png/>",
        "a < b and c > d", "<p>one<p>two</p>", "<div\nclass='x'\n>t</div\n>", "<a b='1' B='2'>x</a>", "plain", "", "<custom-tag a:b='c'>x</custom-tag>",
    ],
)
def test_tokens_of_odd_sources(source):
    same(source)


@pytest.mark.parametrize(
    "href,target",
    [
        ("x", "https://a.example/b/x"), ("/x", "https://a.example/x"), ("../x", "https://a.example/x"), ("./x/../y", "https://a.example/b/y"), ("//cdn.example/x", "https://cdn.example/x"), ("?q=1#f", "https://a.example/b/c?q=1"),
        ("#f", None), ("", None), (None, None), ("JavaScript:void(0)", None), ("mailto:a@b", None), ("tel:1", None), ("http://o.example#x", "http://o.example"), ("http://[bad", None), ("../../../z", "https://a.example/z"),
    ],
)
def test_references_are_resolved(href, target):
    assert html.resolve(href, "https://a.example/b/c") == target


def test_nesting_decides():
    """The same link in the navigation and in the text; paragraphs that nothing closes; a base element."""
    page = html.record("<base href='https://b.example/d/'><nav><ul><li><a href=x>X</a></ul></nav><main><p>One <a href=x>X</a><p>Two<h2>H <b>bold</b></h2></main><footer>&copy; f", "https://a.example/")
    assert [(x["target"], x["nav"], x["text"]) for x in page["links"]] == [("https://b.example/d/x", True, "X"), ("https://b.example/d/x", False, "X")]
    assert page["paragraphs"] == ["One X", "Two"] and page["headings"] == [{"level": 2, "text": "H bold"}]
    assert page["landmarks"]["footer"] == 1 and page["landmarks"]["nav"] == 1 and page["main"]
    assert page["text"] == "One X Two H bold © f"


def test_robots_charset_and_scripts():
    page = html.record("<!DOCTYPE html><head><meta http-equiv=x content='text/html; charset=utf-8'><meta name=ROBOTS content=noindex><script type='application/ld+json'>{\"a\": \"<b>\"}</script><script src=/s.js></script></head>noindex", "https://a.example/")
    assert (page["robots"], page["charset"], page["doctype"], page["json_ld"], page["scripts"], page["text"]) == ("noindex", True, True, ['{"a": "<b>"}'], ["/s.js"], "noindex")
    assert html.record("", "https://a.example/")["title"] is None
    assert html.record("<p>a<!-- b <p>c</p> d", "https://a.example/")["paragraphs"] == ["a"]
    assert html.record("<title>a &amp; <b></title><p>x", "https://a.example/")["title"] == "a & <b>"


def test_hostile_sources_take_no_time():
    for source in ("<a " + "x" * 200_000, "<a " + "b=" * 100_000, "<" * 200_000, "<a b='" * 20_000, "<!--" * 50_000, "<p>" * 50_000 + "</p>" * 50_000):
        html.record(source, "https://a.example/")


def test_titles_of_given_pages_are_as_their_sql_reads_them(spark):
    """Only `&amp;` is resolved: a title that is cut within a reference, and references of other characters, stay."""
    from rankweave.operators import content

    titles = ["Cut &amp;&amp", "A &quot;b&quot; &amp; c &copy; d"]
    pages = spark.createDataFrame([(i, "https://a.example/", f"<html><head><title>{titles[i // 2]}</title></head><body><h1>x</h1></body></html>") for i in range(4)], "page_id long, url string, html string")
    got = {(r["page_id"], r["title"], r["pages"]) for r in content.duplicate_titles(content.page_record(pages)).collect()}
    assert got == {(0, "Cut &&amp", 2), (1, "Cut &&amp", 2), (2, "A &quot;b&quot; & c &copy; d", 2), (3, "A &quot;b&quot; & c &copy; d", 2)}


def test_texts_of_given_records_are_as_their_sql_reads_them(spark, tmp_path):
    """SRC26 of titles and headings with references, cut ones too, against its SQL."""
    import duckdb

    from rankweave.plans.registry import ORACLES, QUERIES

    texts = ["Cut &amp;&amp", 'token = &quot;77&quot; &amp; x', "a&nbsp;b &copy; c"]
    page = "<!DOCTYPE html><html><head><title>{0}</title></head><body><nav><a href=\"/x\">x</a></nav><article><h1>{0}</h1><p>{0}</p></article></body></html>"
    spark.createDataFrame([(i, "https://a.example/", page.format(t)) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(ORACLES["SRC26"])
    assert {tuple(r) for r in QUERIES["SRC26"](spark, str(tmp_path)).select(*want.columns).collect()} == set(want.fetchall())
