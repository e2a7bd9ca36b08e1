"""Greedy choices against a plain pass over the sorted whole, graphs against plain walks, and page checks that the
given tables have no failing page for."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rankweave.operators import content, documents, graph, language, selection, site_checks
from rankweave.plans import choices, site_audit
from tests.conftest import SF


def plain_clusters(rows, least=0.4, contained=0.8, generic=0.6, most=30):
    """rows: id, weight, tokens, place."""
    n = len(rows)
    df = {}
    for _, _, tokens, _ in rows:
        for t in tokens:
            df[t] = df.get(t, 0) + 1
    order = sorted(rows, key=lambda r: (-r[1], len(r[0]), r[0]))
    heads = {r[0]: {t for t in r[2] if df[t] / n <= generic} for r in rows}
    seed_of = {}
    for id_, _, tokens, place in order:
        if id_ in seed_of:
            continue
        seed_of[id_] = id_
        found = []
        for k, (other, _, theirs, where) in enumerate(order):
            if other in seed_of or where != place:
                continue
            x, y = set(tokens), set(theirs)
            sim, part = len(x & y) / len(x | y), len(x & y) / min(len(x), len(y))
            if (sim >= least or part >= contained) and (not heads[id_] or not heads[other] or heads[id_] & heads[other]):
                found.append((-sim, k, other))
        for _, _, other in sorted(found)[: most - 1]:
            seed_of[other] = id_
    return seed_of


def test_clusters_match_a_plain_pass(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(14)] + ["all"]
    rows = {}
    for _ in range(160):
        tokens = sorted(set(rng.sample(words[:14], rng.randint(1, 3))) | ({"all"} if rng.random() < 0.8 else set()))
        rows[" ".join(tokens) + rng.choice(["", " x", " yy"])] = (rng.randint(1, 40), tokens, rng.choice(["", "austin"]))
    rows = [(i, *r) for i, r in rows.items()]
    items = spark.createDataFrame(rows, "id string, weight long, tokens array<string>, place string")
    for most in (30, 4):
        got = {r["id"]: r["seed"] for r in selection.greedy_clusters(items, selection.similar(items), most).collect()}
        assert got == plain_clusters(rows, most=most)


def test_phrase_clusters_match_a_plain_pass(spark):
    rows = [tuple(r) for r in choices.phrase_items(spark, SF).select("id", "weight", "tokens", "place").collect()]
    assert {r["id"]: r["seed"] for r in choices.clusters(spark, SF).collect()} == plain_clusters(rows)


def test_topics_and_subtopics_match_a_plain_fold(spark):
    """Merging by dominant page, in seed order, and stricter parts of large topics."""
    rng = random.Random(8)
    rows = []
    for k in range(240):
        tokens = sorted(set(rng.sample([f"w{j}" for j in range(9)], rng.randint(1, 3))))
        rows.append((f"{' '.join(tokens)} {k}", rng.randint(1, 30), rng.randint(0, 5), rng.randint(0, 3), tokens, rng.choice(["", "", "austin"])))
    items = spark.createDataFrame(rows, "id string, weight long, clicks long, page int, tokens array<string>, place string")
    by_id = {r[0]: r for r in rows}
    seeds = plain_clusters([(r[0], r[1], r[4], r[5]) for r in rows], most=4)
    found = spark.createDataFrame(list(seeds.items()), "id string, seed string")
    members = {}
    for i, s in seeds.items():
        members.setdefault(s, []).append(i)
    topic, first = {}, {}
    for s in sorted(members, key=lambda x: (-by_id[x][1], len(x), x)):
        weights = {}
        for i in members[s]:
            weights[by_id[i][3]] = weights.get(by_id[i][3], 0) + max(1, by_id[i][1])
        page, w = max(weights.items(), key=lambda e: (e[1], e[0]))
        topic[s] = s
        if w < 0.6 * sum(weights.values()):
            continue
        if page not in first:
            first[page] = (s, list(members[s]))
            continue
        head, kept = first[page]
        both = kept + members[s]
        if by_id[head][5] == by_id[s][5] and len(both) <= 30 and selection.cohesion([set(by_id[i][4]) for i in both]) >= 0.18:
            topic[s], first[page] = head, (head, both)
    want = {i: topic[s] for i, s in seeds.items()}
    topics = selection.merged_by_page(items, found)
    assert {r["id"]: r["topic"] for r in topics.collect()} == want and len(set(want.values())) < len(members)
    parts = selection.subtopics(items, topics).collect()
    for t in {r["topic"] for r in parts}:
        own = [by_id[i] for i, x in want.items() if x == t]
        sub = plain_clusters([(r[0], r[1], r[4], r[5]) for r in own], least=0.6, contained=0.9)
        groups = {}
        for i, s in sub.items():
            groups.setdefault(s, []).append(by_id[i])
        assert len(own) >= 12 and 2 <= len(groups) <= 0.7 * len(own)
        got = sorted((r["label"], r["phrases"], r["impressions"], r["clicks"]) for r in parts if r["topic"] == t)
        strongest = sorted(groups.items(), key=lambda g: (-sum(r[1] for r in g[1]), g[0]))[:8]
        assert got == sorted((s, len(g), sum(r[1] for r in g), sum(r[2] for r in g)) for s, g in strongest)
    assert parts


def test_capped_choice_matches_a_plain_pass(spark):
    rng = random.Random(5)
    edges = {(rng.randint(0, 20), rng.randint(0, 15)): rng.randint(0, 9) for _ in range(250)}
    table = spark.createDataFrame([(s, t, x) for (s, t), x in edges.items()], "source long, target long, score long")
    for a, b in ((3, 2), (1, 1), (20, 4)):
        used_s, used_t, want = {}, {}, set()
        for (s, t), _ in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
            if used_s.get(s, 0) < a and used_t.get(t, 0) < b:
                used_s[s], used_t[t] = used_s.get(s, 0) + 1, used_t.get(t, 0) + 1
                want.add((s, t))
        assert {(r["source"], r["target"]) for r in selection.capped(table, a, b).collect()} == want
    assert selection.capped(table.limit(0), 3, 2).count() == 0


LINKS = [(1, 2), (1, 3), (1, 4), (2, 1), (3, 1), (4, 5), (6, 7)]  # hub 1, pair 1-2, dangling 5, a part of its own


def test_page_rank_matches_plain_iteration(spark):
    nodes = sorted({n for e in LINKS for n in e})
    outs = {n: [b for a, b in LINKS if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(200):
        lost = sum(rank[n] for n in nodes if not outs[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / len(outs[a]) for a, b in LINKS if b == n) + lost / len(nodes)) for n in nodes}
    got = {r["node"]: r["rank"] for r in graph.page_rank(spark.createDataFrame(LINKS, "src long, dst long")).collect()}
    assert all(abs(got[n] - rank[n]) < 1e-8 for n in nodes) and len(got) == len(nodes)


def test_components_match_a_plain_walk(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)]
    low = {n: n for e in links for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == low


BAD = "<p>text</p><a href='/x' rel=\"nofollow\"></a><a href=\"http://other.example/\">o</a><h1>a</h1><h1>b</h1><title>one</title><title>two</title>"
GOOD = "<!doctype html><html><head><!-- noindex --><meta charset=\"utf-8\"><title>A title long enough</title><meta name=\"description\" content=\"d\"><meta name=\"viewport\" content=\"w\"><link rel=\"canonical\" href=\"/g\"></head><body><h1>One</h1>" + "<p>word and word</p>" * 90 + "</body></html>"


def test_audits_on_failing_and_sound_pages(spark):
    """Each check names the failing page and not the sound one, also those that the given pages all pass."""
    none = "<meta content='NOINDEX, follow' name=robots><div class=\"noindex\">" + "x" * 10 + "<i></i>" * 40 + "</div>"
    pages = spark.createDataFrame([(1, "https://a.example/1", BAD), (2, "https://a.example/2", GOOD), (3, "https://a.example/3", none), (4, None, None)], "page_id long, url string, html string")
    records = content.page_record(pages)
    failing = {k: {r["page_id"] for r in content.failing_pages(records, when).collect()} for k, (_, when, _) in content.AUDITS.items()}
    want = {
        "AUD10": {1, 3}, "AUD11": {1}, "AUD12": {3, 4}, "AUD13": {1, 3, 4}, "AUD14": {3, 4}, "AUD18": {1}, "AUD20": {1, 3, 4}, "AUD22": {1}, "AUD25": {1}, "AUD26": {1}, "AUD27": {1, 3, 4}, "AUD28": {1, 3, 4}, "AUD31": {3}, "AUD32": {1, 3, 4},
    }
    assert {k: failing[k] for k in want} == want


def test_hosts_with_and_without_prefix(spark):
    pages = spark.createDataFrame([(1, "https://www.a.example/"), (2, "http://a.example/x"), (3, "https://m.b.example/"), (4, None)], "page_id long, url string")
    assert [tuple(r) for r in site_audit._hosts(pages).collect()] == [("a.example", 2)]


def test_robots_rules(spark):
    """Grouped agents, the longest match, Allow on ties, an empty Disallow, wildcards and ends."""
    body = "User-agent: A\nUser-agent: B\nDisallow: /p\nAllow: /p/open\n\nUser-agent: *\nDisallow: /*.gif$\nDisallow: /t\nAllow: /t\nDisallow:\n"
    rules = documents.rules(spark.createDataFrame([(1, body)], "site long, body string"))
    ask = [("a", "/p/x"), ("b", "/p/open/y"), ("ab-bot", "/p"), ("c", "/i.gif"), ("c", "/i.gif?x"), ("c", "/t/1"), ("c", "/p"), ("a", "/i.gif")]
    got = documents.allowed(rules, spark.createDataFrame([(1, *x) for x in ask], "site long, agent string, path string")).collect()
    verdict = {(r["agent"], r["path"]): r["allowed"] for r in got}
    assert [verdict[x] for x in ask] == [False, True, False, False, True, True, True, True]


def test_page_reader_on_odd_html(spark):
    html = "<HTML><head><TITLE>T</TITLE><meta content='d' name='Description'></head><nav><a href='/n'>N</a></nav><a href=rel>x</a><a href=\"b#c\">b</a><a>none</a><img src='i'><img src='j' alt=''><script>var a = '<h1>no</h1>'</script>"
    rows = spark.createDataFrame([(1, "https://s.example/d/p", html), (2, "https://s.example/", None)], "page_id long, url string, html string")
    crawl = rows.withColumns({"location": F.lit(None).cast("string"), "status": F.lit(200), "elapsed_ms": F.lit(1), "hsts": F.lit(True)})
    one, two = documents.read(crawl).orderBy("page_id").collect()
    assert (one["title"], one["description"], [i["alt"] for i in one["images"]]) == ("T", "d", [None, ""])
    assert [(x["target"], x["nav"]) for x in one["links"]] == [("https://s.example/n", True), ("https://s.example/d/rel", False), ("https://s.example/d/b", False), (None, False)]
    assert (two["title"], two["links"], two["words"], two["headings"]) == (None, [], 0, [])
    assert site_checks.nodes(documents.read(crawl)).count() == 0


def test_sentiment_and_stems(spark):
    cases = {"not great": -0.5, "never ever great": -0.71, "it is so very useful": 0.75, "": 0.0, "plain words": 0.0, "great great great great great": 1.0}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", language.sentiment(F.col("t")).alias("s")).collect()
    assert all(abs(r["s"] - cases[r["t"]]) < 0.011 for r in got)
    words = {"runnings": "runn", "cities": "city", "bus": "bus", "testing": "test", "boxes": "boxe"}
    stems = spark.createDataFrame([(w,) for w in words], "w string").select("w", language.text_stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in stems} == words
