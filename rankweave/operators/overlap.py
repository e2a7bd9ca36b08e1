"""Joins and measures of texts by their terms: near copies, templates, cohesion. Candidates meet on terms they
share, and only on as many of them as a match must share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema, to_arrow_type

from rankweave.operators import graph
from rankweave.operators.content import all_matches

#: Buckets by which shingles are counted, to order them from rare to common: any order finds all pairs.
BUCKETS = 1 << 17
#: Rows and meetings that a task works off at a time.
ROWS = 256
MEETINGS = 1 << 16
#: Sets and shingles of a block in which pairs are compared, at most.
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
#: Candidates' names that go to all tasks; of more, the sets are shuffled.
MOST_BROADCAST = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values scrambled, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of the base and of its inverse, for texts of up to so many bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            of = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << n.bit_length()) - 1, base, np.uint64)]))
            self.up, self.down = of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _word_hashes(text: bytes, powers: _Powers) -> np.ndarray:
    """64 bits of each word, in order, from sums of its bytes times powers."""
    read = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], _IS_WORD[read], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers.reach(len(read) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[read] * powers.up[: len(read)], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))


def _shingles(text: bytes, width: int, powers: _Powers) -> np.ndarray:
    """The set of a text's shingles, 64 bits each, in order."""
    words = _word_hashes(text, powers)
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.int64)
    powers.reach(width + 1)
    runs = sum(words[k : n + k] * _mixed(powers.up[k : k + 1]) for k in range(width))
    held = np.sort(_mixed(runs).view(np.int64))
    return held[np.concatenate([[True], held[1:] != held[:-1]])]


def _shingled(width: int, schema: pa.Schema, made):
    """What `made` makes of the rows and sets of each batch; texts are in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays(made(part, [_shingles(t.as_py(), width, powers) for t in part.column("t")]), schema=schema)

    return run


def _name(set_: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(set_.tobytes(), digest_size=8).digest(), "little", signed=True) if len(set_) else None


def _named(part: pa.RecordBatch, sets: list[np.ndarray]) -> list[pa.Array]:
    """Each text's id and its set's name: 64 bits of the whole set; null without shingles."""
    return [part.column("id"), pa.array([_name(s) for s in sets], pa.int64())]


def _counted(width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts = _Powers(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("t"):
                np.add.at(counts, _shingles(text.as_py(), width, powers) & (BUCKETS - 1), 1)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], schema=schema)

    return run


def _first_lengths(n, percent: int) -> tuple:
    """How many of its first shingles a set of n looks with, and by how many it is found where it is not the larger
    one: a match shares percent / 100 of the larger set, and 2 * percent / (100 + percent) of the smaller."""
    return n - (n * percent + 99) // 100 + 1, n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


def _firsts(order, percent: int):
    """Each set's first shingles from rare to common, with their places from 1 on."""

    def made(part: pa.RecordBatch, sets: list[np.ndarray]) -> list[pa.Array]:
        out = []
        for set_ in sets:
            k = _first_lengths(len(set_), percent)[0] if len(set_) else 0
            # Hashes are in order, so a stable sort by counts orders equal counts by hash.
            first = set_[np.argsort(order.value[set_ & (BUCKETS - 1)], kind="stable")[:k]]
            out.append((first, np.full(k, _name(set_) or 0), np.full(k, len(set_), np.int32), np.arange(1, k + 1, dtype=np.int32)))
        return [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]

    return made


def _meetings(name: np.ndarray, n: np.ndarray, i: np.ndarray, percent: int) -> Iterator[list[np.ndarray]]:
    """Pairs of the sets that have a shingle, of which the smaller one (x) is found by it: x, y, nx, ny, i, j."""
    name, one = np.unique(name, return_index=True)
    order = np.lexsort((name, n[one]))
    name, n, i = name[order], n[one][order].astype(np.int64), i[one][order].astype(np.int64)
    finds = i <= _first_lengths(n, percent)[1]
    for lo in range(0, len(name), ROWS):
        x, y = np.nonzero(np.arange(len(name)) > np.arange(lo, min(lo + ROWS, len(name)))[:, None])
        x += lo
        near = finds[x] & (n[x] * 100 >= n[y] * percent)
        x, y = x[near], y[near]
        if len(x):
            yield [name[x], name[y], n[x], n[y], i[x], i[y]]


def _twos(held: list[np.ndarray], ends: np.ndarray, percent: int) -> list[list[np.ndarray]]:
    """The same for all shingles that two rows have."""
    at = ends[:-1][np.diff(ends) == 2]
    (xn, yn), (nx, ny), (i, j) = ([c[at].astype(np.int64), c[at + 1].astype(np.int64)] for c in held[1:])
    turn = (nx > ny) | ((nx == ny) & (xn > yn))
    xn, yn, nx, ny, i, j = (np.where(turn, b, a) for a, b in ((xn, yn), (yn, xn), (nx, ny), (ny, nx), (i, j), (j, i)))
    near = (xn != yn) & (i <= _first_lengths(nx, percent)[1]) & (nx * 100 >= ny * percent)
    return [[c[near] for c in (xn, yn, nx, ny, i, j)]] if near.any() else []


def _met(schema: pa.Schema, percent: int):
    """Meetings of rows in order of their shingles; a row of one shingle alone is passed by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            held = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "name", "n", "i")]
            held = held if kept is None else [np.concatenate(c) for c in zip(kept, held, strict=True)]
            ends = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            yield from between(held, [0, *ends.tolist()])
            # The last shingle's rows may go on in the next batch.
            kept = [c[ends[-1] if len(ends) else 0 :] for c in held]
        if kept is not None:
            yield from between(kept, [0, len(kept[0])])

    def between(held: list[np.ndarray], ends: list[int]) -> Iterator[pa.RecordBatch]:
        out, size = _twos(held, np.array(ends), percent), 0
        for lo, hi in zip(ends, ends[1:], strict=False):
            if hi - lo > 2:
                for pairs in _meetings(*(c[lo:hi] for c in held[1:]), percent):
                    out.append(pairs)
                    size += len(pairs[0])
                    if size >= MEETINGS:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def _candidates(firsts: DataFrame, percent: int) -> DataFrame:
    """x (not larger) and y: names of sets that may reach the Jaccard."""
    pairs = pa.schema([(c, pa.int64()) for c in ("x", "y", "nx", "ny", "i", "j")])
    met = firsts.repartition("m").sortWithinPartitions("m").mapInArrow(_met(pairs, percent), from_arrow_schema(pairs))
    near = met.groupBy("x", "y").agg(F.count("*").alias("met"), F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.max("i").alias("i"), F.max("j").alias("j"))
    # All that a pair shares up to its last meeting has met; behind it no more than the shorter rest.
    return near.where(f"(met + least(nx - i, ny - j)) * (100 + {percent}) >= (nx + ny) * {percent}").select("x", "y")


_BLOCK_FIELDS = pa.schema([("block", pa.int64()), ("names", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("sets", pa.binary())])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sets, in the order in which they come."""
    from pyspark import TaskContext

    number, names, sets, size = TaskContext.get().partitionId() << 32, [], [], 0

    def closed() -> pa.RecordBatch:
        starts = np.cumsum([0, *map(len, sets)]) // 8
        return pa.RecordBatch.from_pylist([{"block": number, "names": names, "starts": starts.tolist(), "sets": b"".join(sets)}], _BLOCK_FIELDS)

    for batch in batches:
        for name, s in zip(batch.column("name").to_pylist(), batch.column("s"), strict=True):
            names.append(name)
            sets.append(s.as_py())
            size += len(sets[-1]) // 8
            if len(names) >= BLOCK or size >= BLOCK_SHINGLES:
                yield closed()
                number, names, sets, size = number + 1, [], [], 0
    if names:
        yield closed()


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(block: dict) -> dict[int, np.ndarray]:
    sets, starts = np.frombuffer(block["sets"], np.int64), block["starts"]
    return {name: sets[lo:hi] for name, lo, hi in zip(block["names"], starts, starts[1:], strict=False)}


def _cut(schema: pa.Schema):
    """The block q that pairs go to, and of their own block only the sets that they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                asked, held = {p[c] for p in row["pairs"] for c in ("x", "y")}, _sets(row["u"])
                names = [name for name in held if name in asked]
                starts = np.cumsum([0, *(len(held[name]) for name in names)]).tolist()
                u = {"names": names, "starts": starts, "sets": b"".join(held[name].tobytes() for name in names)}
                yield pa.RecordBatch.from_pylist([{"q": row["q"], "pairs": row["pairs"], "u": u}], schema)

    return run


def _compared(percent: int):
    """The pairs of one or two blocks that reach the Jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                held, found = _sets(row["v"]) | (_sets(row["u"]) if row["u"] else {}), []
                for pair in row["pairs"]:
                    x, y = held[pair["x"]], held[pair["y"]]
                    where = np.searchsorted(y, x)
                    where[where == len(y)] = 0
                    shared = int(np.count_nonzero(y[where] == x))
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        found.append(pair)
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.int64()) for c in ("x", "y")], schema=_PAIR)

    return run


def _near_sets(texts: DataFrame, reps: DataFrame, percent: int, width: int) -> DataFrame:
    """a, b: names of all pairs of different sets that reach a Jaccard of `percent`. Only sets that may are kept, in
    blocks by the least name that they meet, so most pairs stay within a block; the others take along the sets
    that they need."""
    counted = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
    counts = np.zeros(BUCKETS, np.int64)
    for row in texts.select("t").mapInArrow(_counted(width, counted), from_arrow_schema(counted)).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    order = texts.sparkSession.sparkContext.broadcast(counts)
    first = pa.schema([("m", pa.int64()), ("name", pa.int64()), ("n", pa.int32()), ("i", pa.int32())])
    firsts = texts.select("t").mapInArrow(_shingled(width, first, _firsts(order, percent)), from_arrow_schema(first))
    pairs = graph.checkpointed(_candidates(firsts, percent))
    ends = pairs.selectExpr("x AS name", "y AS other").union(pairs.selectExpr("y", "x"))
    nodes = graph.checkpointed(ends.groupBy("name").agg(F.least("name", F.min("other")).alias("near")).join(reps, "name").withColumnRenamed("rep", "id"))
    kept = pa.schema([("near", pa.int64()), ("name", pa.int64()), ("s", pa.binary())])
    made = lambda part, sets: [part.column("near"), pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
    may = texts.join(F.broadcast(nodes) if nodes.count() <= MOST_BROADCAST else nodes, "id").select("near", "t")
    held = may.mapInArrow(_shingled(width, kept, made), from_arrow_schema(kept))
    blocks = graph.checkpointed(held.repartitionByRange("near", "name").sortWithinPartitions("near", "name").mapInArrow(_blocked, from_arrow_schema(_BLOCK_FIELDS)))
    place = blocks.select("block", F.explode("names").alias("name"))
    placed = pairs.join(place.selectExpr("name AS x", "block AS p"), "x").join(place.selectExpr("name AS y", "block AS q"), "y")
    asked = graph.checkpointed(placed.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.collect_list(F.struct("x", "y")).alias("pairs")))
    side = lambda key, name: blocks.select(F.col("block").alias(key), F.struct("names", "starts", "sets").alias(name))
    two = asked.where("p <> q").join(side("p", "u"), "p").select("q", "pairs", "u")
    two = two.mapInArrow(_cut(to_arrow_schema(two.schema)), two.schema)
    one = asked.where("p = q").select("q", "pairs", F.lit(None).cast(two.schema["u"].dataType).alias("u"))
    return one.union(two).join(side("q", "v"), "q").select("u", "v", "pairs").mapInArrow(_compared(percent), from_arrow_schema(_PAIR))


def near_copies(docs: DataFrame, id_: str, text: str, percent: int = 85, width: int = 5) -> DataFrame:
    """id, class_id (the smallest id that links reach) and links (other distinct texts it is linked with) of
    each text whose word shingles reach a Jaccard of `percent`. Equal sets count once; texts below a
    shingle's words have no set and stand alone. Sets are made anew for each pass, as that takes less than
    keeping them."""
    texts = docs.select(F.col(id_).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("t"))
    named = pa.schema([("id", to_arrow_type(texts.schema["id"].dataType)), ("name", pa.int64())])
    names = graph.checkpointed(texts.mapInArrow(_shingled(width, named, _named), from_arrow_schema(named)))
    reps = graph.checkpointed(names.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("rep")))
    pairs = graph.checkpointed(_near_sets(texts, reps, percent, width))
    both = pairs.union(pairs.select("b", "a")).groupBy("a").agg(F.count("*").alias("links"))
    found = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).join(both, F.col("node") == F.col("a")).join(reps, F.col("node") == F.col("name"))
    lowest = found.groupBy("component").agg(F.min("rep").alias("class_id"))
    linked = found.join(lowest, "component").select("name", "class_id", "links")
    classes = reps.join(linked, "name", "left").select("name", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return names.join(classes, "name", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def template_blocks(pages: DataFrame, share: float, least: int = 3) -> DataFrame:
    """block and pages: paragraph-like texts that stand on at least `share` of all pages, and on `least`."""
    raw = pages.select("page_id", F.explode(all_matches(F.coalesce("html", F.lit("")), r"(?is)<(?:p|li|h1|h2|div)[^>]*>([^<]+)", 1)).alias("raw"))
    blocks = raw.select("page_id", F.trim(F.regexp_replace(F.lower("raw"), r"\s+", " ")).alias("block")).where("block <> ''").distinct()
    many = pages.agg(F.greatest(F.lit(least), F.ceil(F.count("*") * F.lit(share))).alias("bound"))
    return blocks.groupBy("block").agg(F.count("*").alias("pages")).join(F.broadcast(many), F.col("pages") >= F.col("bound")).select("block", "pages")


def mean_jaccard(members: DataFrame, most: int = 40) -> DataFrame:
    """group, members and the mean Jaccard of its members' pairs, over at most `most` of them, taken at even
    steps: members (group, id, tokens). A limit that belongs to the measure, which is a sample's."""
    order = Window.partitionBy("group").orderBy("id")
    numbered = members.withColumn("at", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("group")))
    step = F.ceil(F.col("n") / most)
    taken = numbered.where(F.col("at") % step == 0).select("group", "n", "id", "tokens")
    left, right = taken.select("group", "n", F.col("id").alias("a"), F.col("tokens").alias("x")), taken.select("group", F.col("id").alias("b"), F.col("tokens").alias("y"))
    shared, all_ = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    pairs = left.join(right, "group").where("a < b").groupBy("group").agg(F.max("n").alias("members"), F.round(F.avg(F.coalesce(F.try_divide(shared.cast("double"), all_.cast("double")), F.lit(0.0))), 6).alias("cohesion"))
    return pairs
