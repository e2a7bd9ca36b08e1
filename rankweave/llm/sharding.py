"""Shards of even row counts by balanced label propagation, in DataFrame functions only.

Documents of equal text are linked. They start in shards drawn by a hash. In each round every group's
documents move towards the shard that holds most of their neighbours. Quotas per pair of shards are
what the shards can exchange in cycles plus what free room takes, so full shards trade. Where no cycle
or room is left, groups move towards their fullest shard with room. Each move lowers the cut, and
rounds end when no such move is left; shards then trade whole groups of those that are still cut.
Documents of one group in one shard are alike, so a round joins and moves counts per (group, shard): a
group of any size is at most one row a shard, and no group meets in one task. In the end the counts are handed
out to the documents, and documents without links fill what room is left, so that row counts differ by
one at most and slots have no gaps.

Null texts count as empty ones (size 8, checksum 0, linked with each other). Repeated rows are linked
and get a slot each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import cut, materialised

BLOCK = 512
#: A group is ranked in blocks of about so many rows.
GROUP_BLOCK = 128
#: So many blocks' offsets are summed up in one task.
FAN = 1024
#: So many groups are broadcast at most.
HOT = 1 << 16


def _start(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("start"), "doc_id"), F.lit(shards)).cast("int")


def _text_key(text: Column) -> Column:
    """128 bits that name a text; equal texts only share it."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"))


def quotas(wanted: dict[tuple[int, int], int], free: dict[int, int], over: dict[int, int] | None = None) -> dict[tuple[int, int], int]:
    """Of the counts wanted per (from, to), those that cycles of shards can exchange or free room takes.
    Room is a node of its own, reached from shards that have some; it serves shards that hold too much first."""
    room = -1
    left = dict(wanted) | {(s, room): n for s, n in free.items() if n > 0}
    for out in ({(room, s): n for s, n in (over or {}).items() if n > 0}, {(room, s): sum(free.values()) for s in {a for a, _ in wanted}}):
        left = {e: n for e, n in left.items() if e[0] != room} | out
        to: dict[int, list[int]] = {}
        for a, b in sorted(left):
            to.setdefault(a, []).append(b)
        for a, b in sorted(wanted):
            while left[a, b] > 0:
                came, queue = {b: b}, deque([b])
                while queue and a not in came:
                    at = queue.popleft()
                    for x in to.get(at, ()):
                        if x not in came and left[at, x] > 0:
                            came[x] = at
                            queue.append(x)
                if a not in came:
                    break
                path, at = [(a, b)], a
                while at != b:
                    path.append((came[at], at))
                    at = came[at]
                take = min(left[e] for e in path)
                for e in path:
                    left[e] -= take
    return {e: n - left[e] for e, n in wanted.items() if n > left[e]}


def propagate(cells: DataFrame, shards: int, room: int) -> DataFrame:
    """Moves the counts c of (g, shard) towards each group's fullest shard, by quotas of (from, to)."""
    while True:
        load = {r["shard"]: r["load"] for r in cells.groupBy("shard").agg(F.sum("c").alias("load")).collect()}  # one number a shard
        free = {s: max(0, room - load.get(s, 0)) for s in range(shards)}
        everywhere, roomy = list(range(shards)), [s for s in range(shards) if free[s]]
        for targets, sign in ((everywhere, 0), (everywhere, -1), (roomy, 0)):
            tie = F.xxhash64("g", "shard").bitwiseXOR(F.lit(sign).cast("long"))
            best = cells.where(F.col("shard").isin(targets)).groupBy("g").agg(F.max(F.struct("c", tie.alias("tie"), "shard")).alias("best"))
            # A smaller part moves to the larger; of equal parts one side only, and the other if that is of no use.
            wants = cells.join(best, "g").where((F.col("best.shard") != F.col("shard")) & ((F.col("best.c") > F.col("c")) | ((F.col("best.c") == F.col("c")) & (F.col("best.tie") > tie))))
            wants = cut(wants.select("g", "shard", "c", F.col("best.shard").alias("to")))
            wanted = {(r["shard"], r["to"]): r["w"] for r in wants.groupBy("shard", "to").agg(F.sum("c").alias("w")).collect()}  # one number a pair of shards
            granted = quotas(wanted, free, {s: n - room for s, n in load.items()})
            if granted or not wanted and targets == everywhere:
                break
        if not granted:
            return cells
        most = F.array(*(F.lit(granted.get((a, b), 0)).cast("long") for a in range(shards) for b in range(shards)))
        wants = wants.withColumn("most", F.element_at(most, F.col("shard") * shards + F.col("to") + 1)).where("most > 0")
        before = Window.partitionBy("shard", "to").orderBy(F.xxhash64("g"), "g").rowsBetween(Window.unboundedPreceding, -1)
        moved = cut(wants.select("g", "shard", "to", F.least("c", F.col("most") - F.coalesce(F.sum("c").over(before), F.lit(0))).alias("m")).where("m > 0"))
        change = moved.select("g", "shard", (-F.col("m")).alias("c")).union(moved.select("g", F.col("to").alias("shard"), F.col("m").alias("c")))
        cells = cut(cells.select("g", "shard", "c").union(change).groupBy("g", "shard").agg(F.sum("c").alias("c")).where("c > 0"))


def _laid_out(groups: DataFrame) -> DataFrame:
    """groups (g, n) with lo, the sizes n of all groups before them in an order by hash: summed in blocks of
    about BLOCK groups, whose sums are added up in two levels."""
    blocks = max(1, -(-groups.count() // BLOCK))
    salted = groups.select("g", "n", F.pmod(F.xxhash64(F.lit("line"), "g"), F.lit(blocks)).alias("salt")).withColumn("part", F.floor(F.col("salt") / FAN))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(salted.groupBy("part", "salt").agg(F.sum("n").alias("k")))
    parts = sums.groupBy("part").agg(F.sum("k").alias("k")).withColumn("one", F.lit(1)).withColumn("above", F.sum("k").over(before("one", "part")))
    offsets = sums.withColumn("inside", F.sum("k").over(before("part", "salt"))).join(parts.select("part", "above"), "part")
    offsets = offsets.select("part", "salt", (F.coalesce("above", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("offset"))
    inside = F.coalesce(F.sum("n").over(before("part", "salt", "g")), F.lit(0))
    return salted.join(offsets, ["part", "salt"]).select("g", "n", (F.col("offset") + inside).alias("lo"))


def exchanged(cells: DataFrame, shards: int) -> DataFrame:
    """Where groups are still cut, shards trade them whole: the room that cut groups take in each shard is laid
    end to end, and so are the groups. A group that lies within one shard's stretch is whole, so fewer groups
    than shards are left cut. Loads stay as they are. Groups larger than the least stretch stay where they lie,
    and all do where the trade wouldn't lower the cut."""
    totals = cells.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    held = cut(cells.join(totals, "g").select("g", "shard", "c", "n"))
    most = held.agg(F.max("n")).first()[0]
    while most is not None:
        held = held.where(F.col("n") <= most)
        room = {r["shard"]: r["c"] for r in held.groupBy("shard").agg(F.sum("c").alias("c")).collect()}  # one number a shard
        least = min(room.values(), default=0)
        if least >= most:
            break
        most = held.where(F.col("n") <= least).agg(F.max("n")).first()[0]
    if most is None:
        return cells
    spans, at = [], 0
    for s, n in sorted(room.items()):
        spans.append(F.struct(F.lit(s).alias("shard"), F.lit(at).cast("long").alias("lo"), F.lit(at + n).cast("long").alias("hi")))
        at += n
    laid = _laid_out(held.select("g", "n").distinct())
    piece = lambda r: F.struct(r["shard"].alias("shard"), (F.least(r["hi"], F.col("lo") + F.col("n")) - F.greatest(r["lo"], F.col("lo"))).alias("c"))
    pieces = F.filter(F.transform(F.array(*spans), piece), lambda x: x["c"] > 0)
    dealt = cut(laid.select("g", F.explode(pieces).alias("x")).select("g", "x.shard", "x.c"))
    together = lambda df: df.agg(F.sum(F.col("c").cast("decimal(38,0)") * F.col("c"))).first()[0]
    if together(dealt) <= together(held):
        return cells
    return cut(cells.join(dealt.select("g").distinct(), "g", "left_anti").select("g", "shard", "c").unionByName(dealt))


def _ranked(rows: DataFrame, keys: list[str], blocks: Column, more: DataFrame | None = None) -> DataFrame:
    """rows with `rank`, from 0 without gaps within the keys: rows are dealt into blocks by a hash,
    the blocks' counts give offsets in two levels, and only a block is ever sorted in one task. `more`
    has columns to add by the keys."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit("rank"), "doc_id", "size", "text_crc32"), blocks))
    counts = cut(salted.groupBy(*keys, "salt").agg(F.count("*").alias("k")).withColumn("part", F.floor(F.col("salt") / FAN)))
    before = lambda *by: Window.partitionBy(*keys, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*keys, "part").agg(F.sum("k").alias("k"))
    parts = parts.select(*keys, "part", F.coalesce(F.sum("k").over(before("part")), F.lit(0)).alias("above"))
    offsets = counts.withColumn("inside", F.coalesce(F.sum("k").over(before("part", "salt")), F.lit(0))).join(parts, [*keys, "part"])
    offsets = offsets.select(*keys, "salt", (F.col("above") + F.col("inside")).alias("offset"))
    if more is not None:
        offsets = offsets.join(more, keys)
    inside = Window.partitionBy(*keys, "salt").orderBy("doc_id", "size", "text_crc32")
    return salted.join(offsets, [*keys, "salt"]).withColumn("rank", F.col("offset") + F.row_number().over(inside) - 1).drop("salt", "offset")


def _sized(base: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """base with the sizes n of its groups, null for none. Large groups, HOT at most, are broadcast, so that
    none of them meets in one task."""
    large = max(256, total // HOT)
    hot, others = F.broadcast(groups.where(F.col("n") >= large)), groups.where(F.col("n") < large)
    return base.join(hot, "g").unionByName(base.join(hot.select("g"), "g", "left_anti").join(others, "g", "left"))


def _place(position: Column, ranges: Column) -> Column:
    """The range (shard, lo, hi) that holds a position."""
    return F.filter(ranges, lambda r: (r["lo"] <= position) & (position < r["hi"]))[0]


def balanced_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; row counts of shards differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    base = materialised(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _text_key(text).alias("g")))
    total = base.count()
    least = total // shards
    quota = [least + (s < total % shards) for s in range(shards)]
    spread = base.groupBy("g", _start(shards).alias("shard")).agg(F.count("*").alias("c"))
    groups = materialised(spread.groupBy("g").agg(F.sum("c").alias("n")).where("n > 1"))
    cells = exchanged(propagate(cut(spread.join(groups.select("g"), "g")), shards, least), shards)
    before = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum("c").over(before), F.lit(0))
    ranges = cells.withColumn("lo", lo).groupBy("g").agg(F.sum("c").alias("n"), F.collect_list(F.struct("shard", "lo", (F.col("lo") + F.col("c")).alias("hi"))).alias("ranges"))
    sized = _sized(base, groups, total)
    linked = sized.where("n is not null").withColumn("blocks", F.ceil(F.col("n") / GROUP_BLOCK)).drop("n")
    in_group = _ranked(linked, ["g"], F.col("blocks"), ranges)
    placed = materialised(in_group.select("doc_id", "size", "text_crc32", _place(F.col("rank"), F.col("ranges"))["shard"].alias("shard")))
    in_shard = _ranked(placed, ["shard"], F.lit(max(1, -(-total // (shards * BLOCK)))))
    room = F.element_at(F.array(*map(F.lit, quota)), F.col("shard") + 1)
    in_shard = materialised(in_shard.select("doc_id", "size", "text_crc32", "shard", "rank", (F.col("rank") < room).alias("fits")))
    used = {r["shard"]: r["n"] for r in in_shard.where("fits").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    fixed = in_shard.where("fits").select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
    rest = sized.where("n is null").select("doc_id", "size", "text_crc32").union(in_shard.where("not fits").select("doc_id", "size", "text_crc32"))
    spans, at = [], 0
    for s in range(shards):
        left = quota[s] - used.get(s, 0)
        spans.append(F.struct(F.lit(s).alias("shard"), F.lit(at).cast("long").alias("lo"), F.lit(at + left).cast("long").alias("hi"), F.lit(used.get(s, 0)).cast("long").alias("used")))
        at += left
    loose = _ranked(rest.withColumn("one", F.lit(1)), ["one"], F.lit(max(1, -(-total // BLOCK))))
    loose = loose.withColumn("at", _place(F.col("rank"), F.array(*spans)))
    filled = loose.select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), (F.col("at.used") + F.col("rank") - F.col("at.lo")).alias("slot"))
    return fixed.union(filled)


def links_cut(placed: DataFrame) -> DataFrame:
    """links and cut: pairs of rows of equal text, and those of them that lie in different shards, of rows
    with text and shard. Counted by group and shard; no pair is formed."""
    cells = placed.groupBy(_text_key(F.coalesce("text", F.lit(""))).alias("g"), "shard").agg(F.count("*").cast("decimal(38,0)").alias("c"))
    groups = cells.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("inside"))
    links, inside = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)), F.coalesce(F.sum("inside"), F.lit(0))
    return groups.agg((links / 2).cast("long").alias("links"), ((links - inside) / 2).cast("long").alias("cut"))
