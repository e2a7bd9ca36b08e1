"""A crawled site, written from the given pages: responses with HTML, sitemaps and robots.txt files.

The given pages lack most of what the page checks look at. So each given page id becomes a page of one
shop whose HTML has those features by the id, and the operators read them back out of the HTML. FACTS
states the same features as DuckDB SQL over ids alone, for the independent twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.sources.tables import table

SITE = "https://www.shop.example"


def _url(p: str) -> str:
    return f"concat('{SITE}/c', {p} % 8, '/item-', {p})"


def _day(p: str, month: str) -> str:
    return f"concat('{month}-', lpad(cast({p} % 28 + 1 as string), 2, '0'))"


def _images() -> str:
    """Up to three images; alt, size, format and scheme vary by page and place."""
    image = """concat('<img src="', if((p + k) % 17 = 0, 'http', 'https'), '://img.shop.example/', p, '-', k, if((p + k) % 3 = 0, '.webp', '.jpg'), '"',
        CASE (p + k) % 5 WHEN 0 THEN '' WHEN 1 THEN ' alt=""' ELSE concat(' alt="view ', k, '"') END, if((p + k) % 2 = 0, ' width="80" height="60"', ''), '>')"""
    return f"array_join(transform(filter(array(0, 1, 2), k -> k < p % 4), k -> {image}), '')"


def _links() -> str:
    """The parent, the next page, and now and then a page that is gone, a file, or an anchor without a target."""
    return """concat('<nav><a href="/c0/item-0">Home</a></nav>',
        '<a href="/c', (p div 2) % 8, '/item-', p div 2, '"', if(p % 18 = 1, ' rel="nofollow"', ''), '>', CASE p % 12 WHEN 0 THEN 'Click here' WHEN 5 THEN '' ELSE concat('Item ', p div 2) END, '</a>',
        if(p % 3 <> 0, concat('<a href="/c', (p + 1) % 8, '/item-', p + 1, '">Next item</a>'), ''), if(p % 21 = 0, concat('<a href="/gone-', p, '">Gone</a>'), ''),
        if(p % 14 = 0, concat('<a href="/files/sheet-', p, '.pdf">Sheet</a>'), ''),
        CASE p % 7 WHEN 0 THEN '<a name="top">Top</a>' WHEN 1 THEN '<a href="#part">Part</a>' WHEN 2 THEN '<a href="javascript:void(0)">Open</a>' ELSE '' END)"""


def _markup() -> str:
    """JSON-LD: none, broken, a product without offers, a graph, an article, or an array."""
    product = """'{"@type":"Product","name":"Item ', p, '"'"""
    return f"""CASE p % 6 WHEN 0 THEN '' ELSE concat('<script type="application/ld+json">', CASE p % 6 WHEN 1 THEN concat({product}, ',')
        WHEN 2 THEN concat({product}, ',"datePublished":"', {_day("p", "2024-01")}, '"}}')
        WHEN 3 THEN concat('{{"@context":"https://schema.org","@graph":[', {product}, ',"offers":{{"@type":"Offer","price":"', p, '.50"}}}},{{"@type":"BreadcrumbList","itemListElement":[{{"position":1,"name":"Aisle ', p % 8, '"}},{{"position":2,"name":"Item ', p, '"}}]}}]}}')
        WHEN 4 THEN concat('{{"@type":"Article","headline":"Item ', p, '","dateModified":"', {_day("p", "2024-02")}, '"}}')
        ELSE concat('[{{"@type":"WebPage","name":"Shop"}},', {product}, ',"offers":{{"price":"1"}}}}]') END, '</script>') END"""


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, location, status, elapsed_ms, hsts and html (null but for status 200) of each response."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("p"), F.expr("if(page_id % 10 < 2, page_id - page_id % 10, page_id)").alias("g"))
    words = "array_join(transform(sequence(0, cast(39 + g % 60 as int)), k -> concat('w', (g * 31 + k * k * 7) % 997)), ' ')"
    heads = """concat(CASE WHEN p % 31 = 0 THEN '' WHEN p % 37 = 0 THEN '<h1>Item</h1><h1>Offer</h1>' ELSE concat('<h1>Item ', p, '</h1>') END, if(p % 6 = 0, '', '<h2>About it</h2>'), '<h3>Details</h3>')"""
    described = "CASE WHEN p % 9 = 0 THEN '' WHEN p % 11 < 2 THEN concat('<meta name=\"description\" content=\"Items of shelf ', p - p % 11, '\">') ELSE concat('<meta name=\"description\" content=\"Item ', p, ' ', repeat('as good as new ', cast(p % 12 as int)), '\">') END"
    own = f"concat('<link rel=\"canonical\" href=\"', {_url('p')}, '\">')"
    canonical = f"CASE p % 13 WHEN 0 THEN concat('<link rel=\"canonical\" href=\"', {_url('(p + 1)')}, '\">') WHEN 1 THEN '' WHEN 2 THEN concat('<link rel=\"canonical\" href=\"/item-', p, '\">') WHEN 3 THEN concat({own}, {own}) ELSE {own} END"
    assets = "concat('<link rel=\"stylesheet\" href=\"/css/', if(p % 5 = 0, 'site.css', 'site.min.css'), '\"><script src=\"/js/', if(p % 4 = 0, 'app.js', 'app.min.js'), '\"></script>')"
    body = f"if(p % 25 = 3, '<div id=\"root\"></div>', concat(if(p % 3 = 2, '<div>', '<main>'), {heads}, '<p>', {words}, '.</p>', {_images()}, if(p % 3 = 2, '</div>', '</main>')))"
    html = f"""concat('<!doctype html><html><head><meta charset="utf-8">', if(p % 43 = 0, '', concat('<title>Shop item number ', g, '</title>')), {described}, {canonical}, if(p % 29 = 0, '', '<meta name="viewport" content="width=device-width">'),
        if(p % 47 = 5, '<meta name="robots" content="noindex">', ''), {assets}, {_markup()}, '</head><body>', {_links()}, {body}, if(p % 4 = 1, concat('<time datetime="', {_day("p", "2023-05")}, '">then</time>'), ''), '</body></html>')"""
    seen = pages.withColumn("status", F.expr("CASE WHEN p % 19 = 5 THEN 404 WHEN p % 23 IN (7, 8) THEN 301 WHEN p % 97 = 3 THEN 500 ELSE 200 END"))
    return seen.selectExpr(
        "p AS page_id", f"{_url('p')} AS url", f"CASE WHEN status = 301 THEN {_url('(p - 1)')} END AS location", "status", "100 + (p * 37) % 3000 AS elapsed_ms", "p % 3 <> 0 AS hsts", f"CASE WHEN status = 200 THEN {html} END AS html"
    )


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file and xml: sitemap files of fifty page ids each, with some pages left out and some that are gone."""
    entry = f"""concat('<url><loc>', {_url('page_id')}, '</loc><lastmod>', {_day("page_id", "2024-03")}, '</lastmod></url>', if(page_id % 40 = 0, concat('<url><loc>{SITE}/old-', page_id, '</loc></url>'), ''))"""
    listed = table(spark, sf_dir, "pages").where("page_id % 5 <> 4").selectExpr("page_id div 50 AS file", "page_id", f"{entry} AS entry")
    files = listed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page_id", "entry"))).alias("e"))  # fifty entries at most
    return files.selectExpr("file", "concat('<?xml version=\"1.0\"?><urlset>', array_join(transform(e, x -> x.entry), ''), '</urlset>') AS xml")


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site and body: a robots.txt of each supplier's site."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS site",
        """concat('# rules\\nUser-agent: GPTBot\\nUser-Agent: ClaudeBot\\nDisallow: /private/', s_suppkey % 3, '/\\nAllow: /private/', s_suppkey % 3, '/open\\nCrawl-delay: ', s_suppkey % 5, '\\n\\nUser-agent: *\\nDisallow: /*.tmp$\\nDisallow: /s',
            s_suppkey % 4, '\\nAllow: /s', s_suppkey % 4, '\\nDisallow:\\n', if(s_suppkey % 2 = 0, concat('Sitemap: https://s', s_suppkey, '.example/sitemap.xml\\n'), '')) AS body""",
    )


_P = "p % 10 < 2"
#: The site's facts by id, as DuckDB SQL: `site` has one row a page, `ok` those that answered 200.
FACTS = f"""site AS (SELECT page_id AS p, '{SITE}/c' || (page_id % 8) || '/item-' || page_id AS url, CASE WHEN page_id % 10 < 2 THEN page_id - page_id % 10 ELSE page_id END AS g,
        CASE WHEN page_id % 19 = 5 THEN 404 WHEN page_id % 23 IN (7, 8) THEN 301 WHEN page_id % 97 = 3 THEN 500 ELSE 200 END AS status, 100 + (page_id * 37) % 3000 AS elapsed_ms, page_id % 3 <> 0 AS hsts FROM pages),
    ok AS (SELECT *, p % 25 = 3 AS shell, 40 + g % 60 AS words,
        CASE WHEN p % 43 = 0 THEN NULL ELSE 'Shop item number ' || g END AS title,
        CASE WHEN p % 9 = 0 THEN NULL WHEN p % 11 < 2 THEN 'Items of shelf ' || (p - p % 11) ELSE 'Item ' || p || ' ' || repeat('as good as new ', p % 12) END AS description,
        CASE WHEN p % 25 = 3 THEN 0 ELSE p % 4 END AS images, CASE WHEN p % 25 = 3 OR p % 31 = 0 THEN 0 WHEN p % 37 = 0 THEN 2 ELSE 1 END AS h1s, p % 25 <> 3 AND p % 6 = 0 AS skips FROM site WHERE status = 200),
    links AS (SELECT p, p // 2 AS q, CASE p % 12 WHEN 0 THEN 'Click here' WHEN 5 THEN '' ELSE 'Item ' || (p // 2) END AS anchor, p % 18 = 1 AS nofollow FROM ok UNION ALL SELECT p, p + 1, 'Next item', false FROM ok WHERE p % 3 <> 0)"""
