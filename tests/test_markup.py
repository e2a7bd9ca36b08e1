"""Markup nodes against a plain walk, and what they lack."""

from __future__ import annotations

import json

from rankweave.operators import site_checks

KEYS = tuple(site_checks.NESTED)
DOCS = [
    {"@graph": [{"@type": "Article", "author": {"@type": "Person", "publisher": [{"@type": "Organization"}, {"@type": ["A", "B"]}]}}, [{"@type": "Deep"}], {"name": "untyped", "provider": {"@type": "P"}}]},
    [{"@type": "Product", "name": "x", "offers": {"@type": "Offer"}, "itemReviewed": {"@type": "Thing"}}, "text", 3, None, [[{"@type": "Nested"}]]],
    {"@type": "Review", "author": "a name", "mainEntityOfPage": {"@type": "Page", "@graph": [{"@type": "InGraph"}]}},
    {"@type": ["Product", "Thing"], "name": " ", "offers": []},
]
for _ in range(9):
    DOCS.append({"@type": f"L{_}", "author": DOCS[-1] if _ else {"@type": "Last"}})


def plain(data, keys, depth=0):
    if not isinstance(data, (dict, list)) or depth > 6:
        return []
    if isinstance(data, list):
        return [t for d in data for t in plain(d, keys, depth + 1)]
    out = [t for d in data["@graph"] for t in plain(d, keys, depth + 1)] if isinstance(data.get("@graph"), list) else []
    kinds = data.get("@type")
    out += kinds if isinstance(kinds, list) else [kinds] if kinds else []
    return out + [t for k in keys if isinstance(data.get(k), (dict, list)) for t in plain(data[k], keys, depth + 1)]


def records(spark, docs):
    return spark.createDataFrame([(k, 200, [json.dumps(d), "{broken"]) for k, d in enumerate(docs)], "page_id long, status int, json_ld array<string>")


def test_nodes_match_a_plain_walk(spark):
    got: dict = {}
    for r in site_checks.nodes(records(spark, DOCS), KEYS).where("type IS NOT NULL").collect():
        got.setdefault(r["page_id"], []).append(r["type"])
    want = {k: sorted(plain(d, KEYS)) for k, d in enumerate(DOCS)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert len(want[len(DOCS) - 1]) == 7  # deeper nodes are left


def test_faults(spark):
    got = {(r["page_id"], r["type"]): (r["required"], r["recommended"]) for r in site_checks.markup_faults(records(spark, DOCS[:4])).collect()}
    assert got == {(0, "Article"): (["headline"], ["datePublished"]), (1, "Product"): ([], []), (3, "Product"): (["name", "offers|review|aggregateRating"], [])}
