"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source has a target in words; a document of it should be taken target / source_size times. The
whole part is certain. The fractions are rounded in pairs: of two documents one gives words of its
fraction to the other, in a direction drawn so that both keep their expectation, until one of them is
0 or 1. The words of a pair stay the same, so a source as a whole misses its target only by the one
fraction that is open in the end, which is drawn too: each document is taken as often as it should be
in expectation, a source's only one as well. A block of about FAN documents is folded pair by pair,
the longest first, so that mostly a short one is left, and hands this open fraction up; the open fractions of about FAN blocks meet in a block of the next level, and so on: a
reduction tree of depth log_FAN(rows) whose blocks are of even size whatever the sources' sizes.

Draws come from hashes of ids, so reruns agree. Rows that repeat (the same doc_id, source and size)
are one item of their joint size and share its decision. A null text has size 0; a null source is a
source of its own. Documents of size 0 are taken by a draw of their own and add no words. An empty
table gives an empty result. Other columns are not read, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import cut, materialised

FAN = 64
WORDS = r"[^\x20\x09-\x0D]+"
MOST_BROADCAST = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _unit(*parts: Column | str) -> Column:
    """A number in [0, 1) drawn by a hash."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


def source_targets(items: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, items and mean copies of each source. Targets share `share` of all
    words by weight; what exceeds `most` times a source's words goes to the others by weight, which
    ends at a level where a source gets least(most * size, level * weight)."""
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"), F.count("*").alias("n"))
    cycle = F.array(*map(F.lit, weights))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    filled = Window.orderBy(most * F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    cap = most * F.col("source_size")
    level = (share * F.sum("source_size").over(all_) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    steps = weighed.withColumn("level", level).withColumn("fits", F.when(F.col("level") * F.col("w") <= cap, F.col("level")))
    water = steps.withColumn("water", F.first("fits", ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(cap, F.coalesce(F.col("water") * F.col("w"), cap))
    return water.select("source", "source_size", target.alias("target"), "n", F.coalesce(F.try_divide(target, F.col("source_size").cast("double")), F.lit(0.0)).alias("mean"))


def _fold(members: Column) -> Column:
    """Rounds a block's fractions pair by pair: the open one so far (id, size, repeats, x) and `done`."""
    done_type = "array<struct<doc_id:bigint,size:bigint,repeats:bigint,extra:int>>"
    start = F.struct(*(members[0][c].alias(c) for c in ("doc_id", "size", "repeats", "x")), F.lit(None).cast("int").alias("none"), F.array().cast(done_type).alias("done"))

    def step(open_: Column, new: Column) -> Column:
        own, other = open_["size"] * open_["repeats"], new["size"] * new["repeats"]
        up = F.least((1 - open_["x"]) * own, new["x"] * other)
        down = F.least(open_["x"] * own, (1 - new["x"]) * other)
        rise = _unit(F.lit("pair"), open_["doc_id"], new["doc_id"]) * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        x, y = open_["x"] + moved / own, new["x"] - moved / other
        # What reached its end is 0 or 1 but for rounding in the last places.
        first_ends = (x < 1e-9) | (x > 1 - 1e-9)
        stays = lambda c, o: F.when(first_ends, new[c]).otherwise(open_[c]).alias(o)
        goes = lambda c, o: F.when(first_ends, open_[c]).otherwise(new[c]).alias(o)
        ended = F.struct(goes("doc_id", "doc_id"), goes("size", "size"), goes("repeats", "repeats"), F.round(F.when(first_ends, x).otherwise(y)).cast("int").alias("extra"))
        return F.struct(
            stays("doc_id", "doc_id"), stays("size", "size"), stays("repeats", "repeats"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(first_ends, y).otherwise(x))).alias("x"),
            F.lit(None).cast("int").alias("none"), F.concat(open_["done"], F.array(ended)).alias("done"),
        )

    return F.aggregate(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), start, step)


def _rounded(fractions: DataFrame, largest: int, fan: int) -> DataFrame:
    """source, doc_id, size, repeats, extra (0 or 1) of items with a fraction x and their source's n."""
    done = []
    level, blocks = fractions, largest
    depth = 0
    while True:
        depth += 1
        blocks = -(-blocks // fan)
        n_blocks = F.ceil(F.col("n") / fan).cast("long")
        dealt = level.select("source", n_blocks.alias("n"), F.pmod(F.xxhash64(F.lit(f"level {depth}"), "doc_id", "size"), n_blocks).alias("block"), F.struct((-F.col("size") * F.col("repeats")).alias("longest"), F.xxhash64(F.lit("order"), "doc_id").alias("at"), "doc_id", "size", "repeats", "x").alias("item"))
        folded = cut(dealt.groupBy("source", "block").agg(F.first("n").alias("n"), _fold(F.sort_array(F.collect_list("item"))).alias("f")))
        done.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.*"))
        level = folded.select("source", "n", "f.doc_id", "f.size", "f.repeats", "f.x")
        if blocks <= 1:
            last = (_unit(F.lit("last"), "doc_id", "size") < F.col("x")).cast("int")
            done.append(level.select("source", "doc_id", "size", "repeats", last.alias("extra")))
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, fan: int = FAN) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) of each row."""
    sized = materialised(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    items = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("repeats"))
    sources = cut(source_targets(items, weights, share, most))
    size = sources.agg(F.count("*").alias("k"), F.max("n").alias("largest")).first()
    known = F.broadcast(sources) if size["k"] <= MOST_BROADCAST else sources
    open_ = items.alias("i").join(known.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source"))).select("i.*", "source_size", "target", "n", F.floor("mean").alias("sure"), (F.col("mean") - F.floor("mean")).alias("x"))
    open_ = cut(open_)
    certain = (F.col("size") == 0) | (F.col("x") <= 0)
    drawn = (_unit(F.lit("empty"), "doc_id") < F.col("x")).cast("int")
    rounded = open_.where(certain).select("source", "doc_id", "size", "repeats", drawn.alias("extra"))
    if size["largest"]:
        rounded = rounded.unionByName(_rounded(open_.where(~certain).select("source", "n", "doc_id", "size", "repeats", "x"), size["largest"], fan))
    copies = (F.col("sure") + F.col("extra")).cast("long")
    decided = rounded.alias("r").join(known.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.doc_id", "r.source", "r.size", "s.source_size", "s.target", "r.repeats", F.floor("s.mean").alias("sure"), "r.extra")
    rows = decided.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("__k"))
    return rows.drop("__k").withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the rows of `docs`, all columns, as often as they are taken."""
    decided = mix(docs, weights, share, most).select("doc_id", "source", "size", "copies").distinct()
    keyed = docs.withColumn("__size", word_count(F.col("text")))
    same = keyed["doc_id"].eqNullSafe(decided["doc_id"]) & keyed["source"].eqNullSafe(decided["source"]) & (keyed["__size"] == decided["size"])
    taken = keyed.join(decided.where("copies > 0"), same).select(*(keyed[c] for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), decided["copies"])).alias("__copy"))
    return taken.drop("__copy")
