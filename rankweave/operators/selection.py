"""Greedy choices in a given order, as rounds of joins: what is sure in any order is decided at once, so the
result is that of one pass over the sorted whole, without a task that sees it all."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.graph import checkpointed


def capped(edges: DataFrame, per_source: int, per_target: int) -> DataFrame:
    """The rows of edges (source, target, score, with distinct pairs) that a pass by falling score, then source
    and target, takes under caps per source and per target. An edge among the best of what is left at both
    its ends, by as many places as these still have, will be taken whatever comes before it."""
    order = (F.desc("score"), F.col("source"), F.col("target"))
    left = checkpointed(edges.select("source", "target", "score").withColumn("s_room", F.lit(per_source)).withColumn("t_room", F.lit(per_target)))
    taken = None
    while left.limit(1).count():
        placed = left.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(*order))).withColumn("q", F.row_number().over(Window.partitionBy("target").orderBy(*order)))
        sure = checkpointed(placed.withColumn("sure", (F.col("r") <= F.col("s_room")) & (F.col("q") <= F.col("t_room"))))
        won = sure.where("sure").select("source", "target", "score")
        taken = won if taken is None else taken.unionByName(won)
        used = lambda end: won.groupBy(end).agg(F.count("*").cast("int").alias(f"{end}_used"))  # noqa: B023, E731
        rest = sure.where("NOT sure").join(used("source"), "source", "left").join(used("target"), "target", "left")
        rest = rest.withColumn("s_room", F.col("s_room") - F.coalesce("source_used", F.lit(0))).withColumn("t_room", F.col("t_room") - F.coalesce("target_used", F.lit(0)))
        left = checkpointed(rest.where("s_room > 0 AND t_room > 0").select("source", "target", "score", "s_room", "t_room"))
    return edges.select("source", "target", "score").limit(0) if taken is None else taken


def similar(items: DataFrame, least: float = 0.4, contained: float = 0.8, generic: float = 0.6) -> DataFrame:
    """a, b and sim of all ordered pairs of items (id, tokens, place) with one place, a shared token that at
    most `generic` of all items have (where both have such), and a Jaccard of `least` or `contained` of the
    smaller set shared. Pairs meet on one of the rarest tokens of one side, as many as a match must hit."""
    n = items.count()
    tokens = items.select("id", "place", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    df = tokens.groupBy("t").agg(F.count("*").alias("df"))
    ranked = tokens.join(df, "t").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("df", "t")))
    bound = min(least, contained)
    head = ranked.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * bound) + 1) & (F.col("df") > 1)).select("place", "t", F.col("id").alias("a"))
    met = head.join(tokens.select("place", "t", F.col("id").alias("b")), ["place", "t"]).where("a <> b").select("a", "b").distinct()
    both = met.union(met.select("b", "a")).distinct()
    common = df.where(F.col("df") > generic * n).agg(F.collect_list("t").alias("common"))  # fewer than tokens a set / generic
    named = items.crossJoin(F.broadcast(common)).select("id", "tokens", F.array_except("tokens", "common").alias("heads"))
    pairs = both.join(named.select(F.col("id").alias("a"), F.col("tokens").alias("x"), F.col("heads").alias("hx")), "a").join(named.select(F.col("id").alias("b"), F.col("tokens").alias("y"), F.col("heads").alias("hy")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    pairs = pairs.withColumn("sim", shared / F.size(F.array_union("x", "y"))).withColumn("part", shared / F.least(F.size("x"), F.size("y")))
    heads = (F.size("hx") == 0) | (F.size("hy") == 0) | F.arrays_overlap("hx", "hy")
    return pairs.where(((F.col("sim") >= least) | (F.col("part") >= contained)) & heads).select("a", "b", "sim")


def greedy_clusters(items: DataFrame, pairs: DataFrame, most: int = 30) -> DataFrame:
    """id and seed of each item (id, weight). In the order of falling weight, then shorter and lower id, each
    item without a seed becomes one and takes its most - 1 closest free neighbours (pairs a, b, sim; both
    directions). An item that comes first among all that are at most two steps away is a seed whatever
    else happens, and no other such seed can want its neighbours; so all of these go in one round."""
    key = F.struct((-F.col("weight")).alias("w"), F.length("id").alias("n"), "id")
    free = checkpointed(items.select(key.alias("k")))
    edges = checkpointed(pairs.join(items.select(key.alias("ka"), F.col("id").alias("a")), "a").join(items.select(key.alias("kb"), F.col("id").alias("b")), "b").select("ka", "kb", "sim"))
    done = None
    while True:
        near = edges.groupBy(F.col("ka").alias("k")).agg(F.min("kb").alias("m")).select("k", F.least("k", "m").alias("m"))
        far = edges.join(near.withColumnRenamed("k", "kb"), "kb").groupBy(F.col("ka").alias("k")).agg(F.min("m").alias("far"))
        seeds = checkpointed(free.join(far, "k", "left").where(F.col("far").isNull() | (F.col("k") <= F.col("far"))).select("k"))
        wanted = edges.join(seeds.withColumnRenamed("k", "ka"), "ka")
        closest = F.row_number().over(Window.partitionBy("ka").orderBy(F.desc("sim"), "kb"))
        won = wanted.withColumn("place", closest).where(F.col("place") < most).select(F.col("kb").alias("k"), F.col("ka").alias("seed"))
        round_ = checkpointed(seeds.select("k", F.col("k").alias("seed")).union(won))
        done = round_ if done is None else done.union(round_)
        free = checkpointed(free.join(round_.select("k"), "k", "left_anti"))
        if not free.limit(1).count():
            return done.select(F.col("k.id").alias("id"), F.col("seed.id").alias("seed"))
        gone = round_.select("k")
        edges = checkpointed(edges.join(gone.withColumnRenamed("k", "ka"), "ka", "left_anti").join(gone.withColumnRenamed("k", "kb"), "kb", "left_anti"))


def cohesion(members: list[set]) -> float:
    """Mean Jaccard of all pairs of token sets; 1 of fewer than two."""
    shares = [len(x & y) / len(x | y) if x | y else 0.0 for x, y in combinations(members, 2)]
    return sum(shares) / len(shares) if shares else 1.0


def merged_by_page(items: DataFrame, found: DataFrame, most: int = 30, share: float = 0.6, least: float = 0.18) -> DataFrame:
    """id and topic of items (id, weight, tokens, place, page) in clusters (id, seed): clusters whose weight lies
    by `share` on one page join the page's first cluster, in the order of their seeds, as long as it has
    its place, `most` members at most and a mean Jaccard of `least`. Each page's clusters pass by in order
    in one task that keeps the first cluster only, never the whole group."""
    rows = items.join(found, "id")
    weights = rows.groupBy("seed", "page").agg(F.sum(F.greatest(F.col("weight"), F.lit(1))).alias("w"))
    owner = weights.groupBy("seed").agg(F.max_by(F.struct("page", "w"), F.struct("w", "page")).alias("top"), F.sum("w").alias("all")).where(F.col("top.w") >= share * F.col("all")).select("seed", F.col("top.page").alias("page"))
    members = rows.groupBy("seed").agg(F.collect_list("tokens").alias("members"), F.max(F.when(F.col("id") == F.col("seed"), F.col("place"))).alias("place"), F.max(F.when(F.col("id") == F.col("seed"), F.col("weight"))).alias("weight"))
    owned = members.join(owner, "seed").select("page", (-F.col("weight")).alias("w"), F.length("seed").alias("n"), "seed", "place", "members")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, first, place, kept = None, None, None, []
        for batch in batches:
            topics = []
            for row in batch.itertuples(index=False):
                own = [set(m) for m in row.members]
                if first is None or row.page != page:
                    page, first, place, kept = row.page, row.seed, row.place, own
                elif row.place == place and len(kept) + len(own) <= most and cohesion(kept + own) >= least:
                    kept = kept + own
                    topics.append(first)
                    continue
                topics.append(row.seed)
            yield pd.DataFrame({"seed": batch["seed"], "topic": topics})

    joined = owned.repartition("page").sortWithinPartitions("page", "w", "n", "seed").mapInPandas(fold, "seed string, topic string")
    return found.join(joined, "seed", "left").select("id", F.coalesce("topic", "seed").alias("topic"))


def plain_greedy(rows: list[tuple], least: float, contained: float, generic: float = 0.6, most: int = 30) -> dict[str, str]:
    """The seed of each of a few items (id, weight, tokens, place): one pass, for groups of bounded size."""
    df: dict[str, int] = {}
    for _, _, tokens, _ in rows:
        for t in tokens:
            df[t] = df.get(t, 0) + 1
    heads = {r[0]: {t for t in r[2] if df[t] <= generic * len(rows)} for r in rows}
    order = sorted(rows, key=lambda r: (-r[1], len(r[0]), r[0]))
    seeds: dict[str, str] = {}
    for id_, _, tokens, place in order:
        if id_ in seeds:
            continue
        seeds[id_], near = id_, []
        for k, (other, _, theirs, where) in enumerate(order):
            shared, either = len(set(tokens) & set(theirs)), len(set(tokens) | set(theirs))
            close = shared >= least * either or shared >= contained * min(len(tokens), len(theirs))
            if other not in seeds and where == place and close and (not heads[id_] or not heads[other] or heads[id_] & heads[other]):
                near.append((-shared / either, k, other))
        seeds |= {other: id_ for _, _, other in sorted(near)[: most - 1]}
    return seeds


def subtopics(items: DataFrame, topics: DataFrame, least_size: int = 12, sections: int = 8) -> DataFrame:
    """topic, label, phrases, impressions and clicks of the parts of topics with `least_size` members or more:
    their members (thirty at most) clustered anew at a stricter bound; the `sections` strongest parts; none
    where that gives one part, or nearly one a member."""
    rows = items.join(topics, "id")
    large = rows.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select("topic")

    def split(group: pd.DataFrame) -> pd.DataFrame:
        seeds = plain_greedy(list(group[["id", "weight", "tokens", "place"]].itertuples(index=False, name=None)), 0.6, 0.9)
        parts = group.assign(label=group["id"].map(seeds)).groupby("label", as_index=False).agg(topic=("topic", "first"), phrases=("id", "count"), impressions=("weight", "sum"), clicks=("clicks", "sum"))
        if len(parts) < 2 or len(parts) > 0.7 * len(group):
            parts = parts[:0]
        return parts.sort_values(["impressions", "label"], ascending=[False, True])[:sections][["topic", "label", "phrases", "impressions", "clicks"]]

    return rows.join(large, "topic", "left_semi").groupBy("topic").applyInPandas(split, "topic string, label string, phrases long, impressions long, clicks long")
