"""Similarity join of texts on word shingles by signature trees.

A document's set is its distinct word shingles; equal sets fall together first (a hash aggregation), so copies
by the thousand are one set. Each set has a bitmap of at least sixteen times as many bits as it has shingles. Sets
that may have a partner lie in a tree: leaves of similar sets (sorted by width of bitmap and two minima of
hashes) and parents of consecutive leaves. A node holds the OR of its bitmaps, its range of sizes and its
surplus: by how much a set's size exceeds its bits, at most. Two sets below two nodes share no more than the
surplus of either node and the bits that both nodes have, so a pair of nodes whose maximum possible overlap is
below what its sizes need is left out with all pairs below it.

The tree is traversed against itself by levels, as joins: parents, then leaves, then sets, which also have a
bitmap of parities (two sets differ in at least as many shingles as their parities do). Pairs of parents start
at keys they share; keys that lie below the same parents count once. For a range of sizes a set is cut into
as many parts (by hash) as a pair may differ in shingles, and a few more: two linked sets agree in some part
that isn't empty, so its digest is a key they share.

Sets of a leaf and of the leaf before it are compared while leaves are made. Keys whose sets are all
linked by then are done. In the others each component's first set is compared with a few leaders of the
key, and what is still open is traversed, where pairs of one component count as done: first for the likeliest
pair of each two components in a pair of leaves, then, where keys are open still, for all. Candidates are
confirmed on full sets. So no key is expanded into all its pairs of sets, and no pair over the bound is missed.

Nulls, empty texts and texts without words have an empty set and are linked with nothing. Texts with fewer words
than a shingle count as one shingle. Rows that repeat (the same doc_id twice) are one document and each come
back, also where their texts differ: then the document is linked by any of them. Rows with a null doc_id are
documents without a name: their class is named by its smallest doc_id, or by null. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm import near_dup
from rankweave.llm.memory import give_back
from rankweave.llm.shared import materialised, mix64

#: Sets of a leaf, and leaves of a parent, at most.
LEAF = 32
FAN = 32
#: A leaf is closed once it holds so many shingles, or its bitmap so many times the bits of its largest set.
LEAF_ITEMS = 1 << 18
SPREAD = 3
BITS_EACH = 16
#: Sizes of a range differ by this factor at most.
RANGE = 1.25
_MINIMA = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def size_ranges(percent: int) -> tuple[int, ...]:
    """The largest size of each range. In the first, only equal sets are linked."""
    ends = [max(1, -(-(100 + percent) // (2 * (100 - percent))) - 1) if percent < 100 else 1 << 40]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, int(ends[-1] * RANGE)))
    return tuple(ends)


def apart(a: int, b: int, percent: int) -> int:
    """In how many shingles two linked sets of these sizes may differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def keys(items: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set, for its own range of sizes and those above that may hold partners."""
    n, ends, found = len(items), size_ranges(percent), []
    at = bisect_left(ends, n)
    while at == bisect_left(ends, n) or n * 100 >= percent * (ends[at - 1] + 1):
        most = apart(ends[at], ends[at], percent)
        if most:
            spare = 2 + most // 64
            count = most + 1 + spare
            part = ((items >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            salt = np.uint64((at * 0xD6E8FEB86659FD93) & (2**64 - 1))
            found.append(mix64(mix64(np.add.reduceat(mix64(items), starts)) + mix64(part[starts] + salt)))
            if count - len(starts) > spare:
                # Empty parts only matter where two sets may share more of them than are spare.
                empty = np.setdiff1d(np.arange(count, dtype=np.uint64), part[starts])
                found.append(mix64(mix64(empty + salt) ^ np.uint64(1)))
        at += 1
    return np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)


def width_of(size: int) -> int:
    """Bits of a set's bitmap."""
    return max(512, 1 << (BITS_EACH * size - 1).bit_length())


def bitmap(items: np.ndarray, width: int) -> np.ndarray:
    flags = np.zeros(width, dtype=bool)
    flags[(items >> np.uint64(11)) & np.uint64(width - 1)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def parities(items: np.ndarray, width: int) -> np.ndarray:
    """Bits that say whether an odd number of items fall on them."""
    odd = np.bincount((items >> np.uint64(11)) & np.uint64(width - 1), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int, join=np.bitwise_or) -> np.ndarray:
    """Bitmaps (last axis) as they are at a smaller width; parities join by XOR."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = join(bits[..., :half], bits[..., half:])
    return bits


def may_link(odd_a: np.ndarray, sizes_a: np.ndarray, odd_b: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a (rows) and b (columns) aren't ruled out by sizes and parities."""
    return _reach(odd_a, sizes_a, odd_b, sizes_b, percent)[0]


def _reach(odd_a: np.ndarray, sizes_a: np.ndarray, odd_b: np.ndarray, sizes_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """may_link, and in how large a part of both sets the parities differ."""
    words = min(odd_a.shape[-1], odd_b.shape[-1])
    a, b = (folded(x, words, np.bitwise_xor) for x in (odd_a, odd_b))
    differ = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
    na, nb = sizes_a[:, None], sizes_b[None, :]
    return (np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)) & (differ * (100 + percent) <= (na + nb) * (100 - percent)), differ / (na + nb)


def overlap_bound(bits_a: np.ndarray, surplus_a: np.ndarray, bits_b: np.ndarray, surplus_b: np.ndarray) -> np.ndarray:
    """The most that sets with (below nodes with) these bitmaps and surpluses can share, for all of a
    (rows) and b (columns). The narrower side's surplus holds at its own width."""
    words = min(bits_a.shape[-1], bits_b.shape[-1])
    both = np.bitwise_count(folded(bits_a, words)[:, None, :] & folded(bits_b, words)[None, :, :]).sum(axis=2, dtype=np.int64)
    most = np.full(both.shape, np.iinfo(np.int64).max)
    if bits_a.shape[-1] == words:
        most = np.minimum(most, both + surplus_a[:, None])
    if bits_b.shape[-1] == words:
        most = np.minimum(most, both + surplus_b[None, :])
    return most


def needed(a, b, percent: int):
    """The least overlap of two linked sets of at least these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _keyed(width: int, percent: int):
    """Size, digest and keys of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in near_dup._parts(batches):
            rows, lists = [], []
            for text in batch.column(1):
                items = near_dup.shingle_set(text.as_py(), width)
                rows.append((len(items), *near_dup._digest(items)) if len(items) else (0, 0, 0))
                lists.append(keys(items, percent) if len(items) else np.empty(0, np.int64))
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            flat = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "n_shingles", "d1", "d2", "keys"])

    return run


def _placed_sets(width: int):
    """The full set of each text, with its name and where it belongs in the order of leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in near_dup._parts(batches):
            sets = [x for x in (near_dup.shingle_set(t.as_py(), width) for t in batch.column(0)) if len(x)]
            names = [(len(x), *near_dup._digest(x), width_of(len(x)), *(int(mix64(x ^ np.uint64(m)).min().view(np.int64)) for m in _MINIMA)) for x in sets]
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in sets], out=offsets[1:])
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64), pa.int64())
            columns = zip(*names, strict=True) if names else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["n_shingles", "d1", "d2", "wide", "m1", "m2", "items"])

    return run


class _Leaf:
    """Sets of one width of bitmap, with their bitmaps OR-combined."""

    def __init__(self, wide: int) -> None:
        self.wide, self.nodes, self.sets, self.bits, self.odd = wide, [], [], [], []
        self.heads: list[int] = []
        self.either, self.total, self.largest = np.zeros(wide // 64, np.uint64), 0, 0

    def takes(self, wide: int, bits: np.ndarray, most: int) -> bool:
        if wide != self.wide or len(self.nodes) >= most or self.total >= LEAF_ITEMS:
            return False
        own = int(np.bitwise_count(bits).sum())
        return not self.nodes or int(np.bitwise_count(self.either | bits).sum()) <= SPREAD * max(self.largest, own)

    def add(self, node: int, items: np.ndarray, bits: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(items)
        self.bits.append(bits)
        self.odd.append(parities(items, self.wide))
        self.either |= bits
        self.total += len(items)
        self.largest = max(self.largest, int(np.bitwise_count(bits).sum()))

    def sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.sets], dtype=np.int64)

    def surplus(self) -> np.ndarray:
        return self.sizes() - np.bitwise_count(np.stack(self.bits)).sum(axis=1, dtype=np.int64)


def _near_links(leaf: _Leaf, before: _Leaf | None, percent: int) -> list[dict]:
    """Links of a leaf's sets with each other and with the leaf before, without those that others imply."""
    parts = [x for x in (before, leaf) if x is not None]
    sets = [s for x in parts for s in x.sets]
    nodes = [n for x in parts for n in x.nodes]
    first = len(nodes) - len(leaf.nodes)
    own = np.stack(leaf.odd)
    may = np.concatenate([may_link(np.stack(x.odd), x.sizes(), own, leaf.sizes(), percent) for x in parts])
    root = list(range(len(nodes)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for j, i in zip(*np.nonzero(may.T), strict=True):
        i, j = int(i), int(j) + first
        if i < j and top(i) != top(j) and linked(sets[i], sets[j], percent):
            root[top(i)] = top(j)
    # Links as stars: each component's sets with the first set that is known of it, from leaf to leaf.
    heads, found = {}, []
    for k, node in enumerate(nodes):
        own = before.heads[k] if k < first else node
        head = heads.setdefault(top(k), own)
        if head != own:
            found.append({"a": head, "b": own})
    leaf.heads = [heads[top(k)] for k in range(first, len(nodes))]
    return found


_LEAF_FIELDS = pa.schema(
    [("id", pa.int64()), ("parent", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("surplus", pa.int64()), ("bits", pa.binary()), ("nodes", pa.list_(pa.int64()))]
    + [("sizes", pa.list_(pa.int64())), ("each", pa.binary()), ("links", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
)
_LEAF_SCHEMA = "id long, parent long, low long, high long, surplus long, bits binary, nodes array<long>, sizes array<long>, each binary, links array<struct<a: long, b: long>>"


def _leaves(percent: int, most: int, fan: int):
    """Leaves of a partition's sorted sets, with the links within them and between neighbours. So many leaves of one
    width in a row have one parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        leaf: _Leaf | None = None
        before: _Leaf | None = None
        number = parent = children = 0
        out: list[dict] = []

        def close() -> None:
            nonlocal number, parent, children, leaf, before
            if children >= fan or before is not None and before.wide != leaf.wide:
                parent, children = parent + 1, 0
            sizes = leaf.sizes()
            row = {"id": base + number, "parent": base + parent, "low": int(sizes.min()), "high": int(sizes.max()), "surplus": int(leaf.surplus().max()), "bits": leaf.either.tobytes()}
            out.append(row | {"nodes": leaf.nodes, "sizes": sizes.tolist(), "each": np.stack(leaf.odd).tobytes(), "links": _near_links(leaf, before, percent)})
            number, children = number + 1, children + 1
            before, leaf = leaf, None

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, _LEAF_FIELDS)
            out.clear()
            return batch

        for batch in near_dup._parts(batches):
            for node, wide, items in zip(batch.column("node").to_pylist(), batch.column("wide").to_pylist(), batch.column("items"), strict=True):
                own = np.asarray(items.values).view(np.uint64).copy()
                bits = bitmap(own, wide)
                if leaf is not None and not leaf.takes(wide, bits, most):
                    close()
                    if len(out) >= 256 or sum(len(x["each"]) for x in out) >= 1 << 21:
                        yield rows()
                if leaf is None:
                    leaf = _Leaf(wide)
                leaf.add(node, own, bits)
        if leaf is not None:
            close()
        if out:
            yield rows()
        give_back()

    return run


def _bits(value: bytes, rows: int = 1) -> np.ndarray:
    return np.frombuffer(value, np.uint64).reshape(rows, -1)


class _Nodes:
    """Some nodes of one width, as arrays."""

    def __init__(self, rows: list[dict]) -> None:
        self.ids, self.low, self.high, self.surplus = (np.array([r[k] for r in rows], np.int64) for k in ("id", "low", "high", "surplus"))
        self.bits = np.stack([_bits(r["bits"])[0] for r in rows])

    def above(self) -> _Nodes:
        """The node that has these below it."""
        bits = np.bitwise_or.reduce(self.bits)
        return _Nodes([{"id": -1, "low": self.low.min(), "high": self.high.max(), "surplus": self.surplus.max(), "bits": bits.tobytes()}])


def nodes_may(x: _Nodes, y: _Nodes, percent: int) -> np.ndarray:
    """Which nodes of x (rows) and y (columns) may have linked sets below them: by ranges of sizes, and by the maximum
    possible overlap."""
    lx, hx, ly, hy = x.low[:, None], x.high[:, None], y.low[None, :], y.high[None, :]
    fits = (hx * 100 >= percent * ly) & (hy * 100 >= percent * lx)
    least = needed(np.maximum(lx, -(-percent * ly // 100)), np.maximum(ly, -(-percent * lx // 100)), percent)
    most = np.minimum(overlap_bound(x.bits, x.surplus, y.bits, y.surplus), np.minimum(hx, hy))
    return fits & (most >= least)


_PAIR_FIELDS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _leaf_pairs(percent: int):
    """Of pairs of parents, given as lists of their leaves, the pairs of leaves that may have linked sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in near_dup._parts(batches, 32):
            found = [np.empty((2, 0), np.int64)]
            for r in batch.to_pylist():
                x, y = _Nodes(r["x"]["leaves"]), _Nodes(r["y"]["leaves"])
                if r["x"]["id"] != r["y"]["id"] and not nodes_may(x.above(), y.above(), percent)[0, 0]:
                    continue
                i, j = np.nonzero(nodes_may(x, y, percent))
                pairs = np.sort(np.stack([x.ids[i], y.ids[j]]), axis=0)
                found.append(np.unique(pairs[:, pairs[0] < pairs[1]], axis=1))
            pairs = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_PAIR_FIELDS)

    return run


def _candidates(percent: int, best: bool):
    """Pairs of sets of two leaves, of different components, that sizes and parities don't rule out; or of the
    pairs of each two components only the one whose parities differ least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in near_dup._parts(batches, 32):
            found = [np.empty((2, 0), np.int64)]
            for r in batch.to_pylist():
                (nodes_x, cx, nx, ox), (nodes_y, cy, ny, oy) = ((*(np.array(s[k], np.int64) for k in ("nodes", "components", "sizes")), _bits(s["each"], len(s["nodes"]))) for s in (r["x"], r["y"]))
                open_ = (cx[:, None] != cy[None, :]) & (cx[:, None] >= 0) & (cy[None, :] >= 0)
                if open_.any():
                    may, apart_ = _reach(ox, nx, oy, ny, percent)
                    i, j = np.nonzero(open_ & may)
                    if best:
                        order = np.argsort(apart_[i, j], kind="stable")
                        i, j = i[order], j[order]
                        first = np.unique(np.sort(np.stack([cx[i], cy[j]]), axis=0), axis=1, return_index=True)[1]
                        i, j = i[first], j[first]
                    found.append(np.sort(np.stack([nodes_x[i], nodes_y[j]]), axis=0))
            pairs = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_PAIR_FIELDS)

    return run


def _open(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members of the keys that hold several components."""
    placed = members.join(component.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return materialised(placed.join(mixed, "key"))


def _led(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between a key's components, one set of each, and a few leaders of the key."""
    firsts = open_.groupBy("key", "component").agg(F.min("node").alias("node"))
    flipped = lambda c, m: F.col(c).bitwiseXOR(F.lit(m))
    leaders = firsts.groupBy("key").agg(*(F.min(flipped("node", m)).alias(f"l{k}") for k, m in enumerate(near_dup.LEADERS)))
    each = F.array_distinct(F.array(*(flipped(f"l{k}", m) for k, m in enumerate(near_dup.LEADERS))))
    pairs = firsts.join(leaders, "key").select("node", F.explode(each).alias("leader")).where("node <> leader")
    pairs = materialised(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    return near_dup._confirmed(_sized_pairs(pairs, sets, percent), sets, percent)


def _sized_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    size = lambda c: sets.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"))
    met = pairs.join(size("a"), "a").join(size("b"), "b")
    return met.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")


def _both(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of node ids with what the nodes hold, as x and y."""
    side = lambda c, name: nodes.select(F.col("id").alias(c), F.struct(*nodes.columns).alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")


def _near_leaves(open_: DataFrame, leaves: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of leaves that may have links between the open keys' sets, by levels from parents on, and the leaves."""
    lies = leaves.select(F.explode("nodes").alias("node"), F.col("id").alias("leaf"), "parent")
    at = materialised(open_.join(lies, "node").select("key", "leaf", "parent").distinct())
    below = at.select("key", "parent").distinct()
    # Keys below the same parents lead to the same pairs: one of them is enough.
    names = below.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("parent").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64("parent", F.lit(1)).cast("decimal(38,0)")).alias("h2"))
    own = below.join(names.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "key")
    pairs = own.withColumnRenamed("parent", "a").join(own.withColumnRenamed("parent", "b"), "key").where("a <= b").select("a", "b").distinct()
    known = materialised(leaves.drop("links").join(at.select(F.col("leaf").alias("id")).distinct(), "id"))
    parents = known.groupBy(F.col("parent").alias("id")).agg(F.collect_list(F.struct("id", "low", "high", "surplus", "bits")).alias("leaves"))  # a parent's leaves, no more
    return materialised(_both(pairs, materialised(parents)).mapInArrow(_leaf_pairs(percent), "a long, b long")), known


def _traversed(near: tuple[DataFrame, DataFrame], open_: DataFrame, sets: DataFrame, percent: int, best: bool) -> DataFrame:
    """Links of the open keys' sets below pairs of leaves; of the pairs of two components that meet in a pair of
    leaves, all or the likeliest."""
    leaf_pairs, known = near
    placed = known.select("id", F.explode("nodes").alias("node")).join(open_.select("node", "component").distinct(), "node")
    held = placed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("node", "component"))).alias("of"))  # a leaf's sets, no more
    own = known.join(held, "id").select("id", "nodes", "sizes", "each", F.transform("nodes", lambda n: F.coalesce(F.element_at("of", n), F.lit(-1))).alias("components"))
    found = _both(leaf_pairs, materialised(own)).mapInArrow(_candidates(percent, best), "a long, b long")
    return near_dup._confirmed(materialised(found.distinct()), sets, percent)


def classes(texts: DataFrame, width: int, percent: int, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """id, n_shingles and component_id of each row of (id, text)."""
    keyed = materialised(texts.mapInArrow(_keyed(width, percent), "id long, n_shingles long, d1 long, d2 long, keys array<long>"))
    name = ["n_shingles", "d1", "d2"]
    alike = keyed.where("n_shingles > 0").groupBy(*name).agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    groups = materialised(alike.withColumn("node", F.monotonically_increasing_id()))
    rows = groups.select("node", "id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    members = materialised(rows.join(shared, "key"))
    met = materialised(members.select("node").distinct())
    full = near_dup._pick(texts, members).select("text").mapInArrow(_placed_sets(width), "n_shingles long, d1 long, d2 long, wide long, m1 long, m2 long, items array<long>")
    wanted = groups.join(met, "node", "left_semi").select(*name, "node")
    order = ["wide", "m1", "m2", "node"]
    sets = materialised(full.join(wanted, name).select("node", "n_shingles", "wide", "m1", "m2", "items").dropDuplicates(["node"]))
    leaves = materialised(sets.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "wide", "items").mapInArrow(_leaves(percent, leaf, fan), _LEAF_SCHEMA))
    links = leaves.select(F.explode("links").alias("l")).select("l.a", "l.b")
    if (same := near_dup._same_document(keyed, groups)) is not None:
        links = links.union(same)
    component = near_dup.connected_components(links)
    near = None
    for step in ("leaders", "likeliest", "all"):
        open_ = _open(members, component)
        if not open_.limit(1).count():
            break
        if step != "leaders" and near is None:
            near = _near_leaves(open_, leaves, percent)
        more = _led(open_, sets, percent) if step == "leaders" else _traversed(near, open_, sets, percent, step == "likeliest")
        if more.limit(1).count():
            links = links.union(more)
            component = near_dup.connected_components(links)
    placed = groups.join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")).select(*name, "id", "component")
    lowest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = placed.join(lowest, "component").select(*name, "component_id")
    return keyed.select("id", *name).join(named, name, "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def similar_documents(docs: DataFrame, width: int = 3, percent: int = 90, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row."""
    found = classes(near_dup._named(docs), width, percent, leaf, fan)
    own = lambda c: F.when(F.col(c) < near_dup.UNNAMED, F.col(c))
    return found.select(own("id").alias("doc_id"), "n_shingles", own("component_id").alias("component_id"))
