"""Pairs of sparse vectors by cosine, exactly, over blocks of similar vectors.

A vector is one row: the hashes of its terms (64 bits; whole numbers are their own) and how often it has each.
Vectors with the same leading terms lie together in blocks, which name each term once, and blocks in tiles. All
pairs of tiles meet in a Cartesian product: a task reads two parts of the checkpointed tiles, so nothing is written
for a pair, and what is held is two tiles. The vectors are shuffled once, to be sorted.

Pairs of blocks are ruled out where their greatest weights by term don't reach the bound; in the others, terms that
many of both sides have make a dense product, and what is left of the norms rules out most pairs before the rare
terms are added. Products are sums of whole counts, so they are those of the SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from rankweave.operators import graph

#: A block's vectors and terms, and a tile's blocks and bytes, at most.
BLOCK = 512
BLOCK_TERMS = 1 << 18
TILE = 8
TILE_BYTES = 1 << 24
#: Bytes of tiles in a part of the product; parts, at least.
PART_BYTES = 1 << 24
PARTS = 12
#: Terms that one in so many of a block's vectors has count as common there.
COMMON = 12
#: Columns of a dense product at a time.
COLUMNS = 2048
_SLACK = 1e-9


def hashed(column: Column, kind: T.DataType) -> Column:
    """A term's 64 bits."""
    return column.cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.xxhash64(column)


def _packed(values: np.ndarray) -> bytes:
    """An array in its smallest kind, which is named first."""
    if len(values) and (values.min() < 0 or (values != np.floor(values)).any()):
        small = values.astype(np.float64)
    else:
        most = values.max() if len(values) else 0
        small = values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.float64)
    return small.dtype.char.encode() + small.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, chr(packed[0]), offset=1)


def _sparse(schema: pa.Schema):
    """Each vector's terms in order, their counts, and the three heaviest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("id", "terms", "counts", "own")]
            for id_, given, counts, own in zip(*columns, strict=True):
                terms, where = np.unique(np.asarray(given.values), return_inverse=True)
                n = np.bincount(where, None if not counts.is_valid else np.asarray(counts.values), len(terms))
                lead = terms[np.argsort(-n, kind="stable")[:3]].tolist() + [None] * 3
                rows.append({"lead0": lead[0], "lead1": lead[1], "lead2": lead[2], "id": id_.as_py(), "terms": terms.tobytes(), "counts": _packed(n), "own": own.as_py()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _block_type(id_type: pa.DataType) -> pa.DataType:
    return pa.struct([("block", pa.int64()), ("ids", pa.list_(id_type)), *((n, pa.binary()) for n in ("starts", "places", "counts", "distinct", "own"))])


def _tiles(schema: pa.Schema, most: int):
    """Tiles of blocks of sorted vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size, tile, bytes_ = TaskContext.get().partitionId() << 32, [], 0, [], 0

        def close() -> None:
            nonlocal number, held, size, bytes_
            distinct, places = np.unique(np.concatenate([t for _, t, _, _ in held]), return_inverse=True)
            starts = np.cumsum([0, *(len(t) for _, t, _, _ in held)])
            parts = {"starts": _packed(starts), "places": _packed(places), "counts": _packed(np.concatenate([n for _, _, n, _ in held])), "distinct": distinct.tobytes(), "own": _packed(np.array([o for *_, o in held]))}
            tile.append({"block": number, "ids": [i for i, *_ in held]} | parts)
            number, held, size, bytes_ = number + 1, [], 0, bytes_ + sum(map(len, parts.values()))

        def closed() -> pa.RecordBatch:
            nonlocal tile, bytes_
            out = pa.RecordBatch.from_pylist([{"tile": tile[0]["block"], "bytes": bytes_, "blocks": tile}], schema)
            tile, bytes_ = [], 0
            return out

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "terms", "counts", "own")]
            for id_, terms, counts, own in zip(*columns, strict=True):
                held.append((id_.as_py(), np.frombuffer(terms.as_py(), np.int64), _unpacked(counts.as_py()), own.as_py()))
                size += len(held[-1][1])
                if len(held) >= most or size >= BLOCK_TERMS:
                    close()
                    if len(tile) >= TILE or bytes_ >= TILE_BYTES:
                        yield closed()
        if held:
            close()
        if tile:
            yield closed()

    return run


class _Block:
    def __init__(self, row: dict) -> None:
        self.number, self.ids = row["block"], row["ids"]
        starts, self.place, self.n = (_unpacked(row[n]).astype(np.int64 if n != "counts" else np.float64) for n in ("starts", "places", "counts"))
        self.distinct = np.frombuffer(row["distinct"], np.int64)
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(starts))
        self.squares = np.bincount(self.owner, self.n**2, len(self.ids)) + _unpacked(row["own"])
        self.norms = np.sqrt(self.squares)
        self.weights = self.n / self.norms[self.owner]
        self.most = np.zeros(len(self.distinct))
        np.maximum.at(self.most, self.place, self.weights)
        self.often = np.bincount(self.place, minlength=len(self.distinct)) * COMMON >= len(self.ids)


def _shared_terms(x: _Block, y: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Where both blocks' terms stand among their distinct ones."""
    at = np.searchsorted(y.distinct, x.distinct)
    at[at == len(y.distinct)] = 0
    at_x = np.flatnonzero(y.distinct[at] == x.distinct)
    return at_x, at[at_x]


def _columns(block: _Block, places: np.ndarray) -> np.ndarray:
    """Column (among the given places, else -1) of each of a block's terms."""
    column = np.full(len(block.distinct), -1)
    column[places] = np.arange(len(places))
    return column[block.place]


def block_products(x: _Block, y: _Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and products of the pairs whose cosine is at or over the bound."""
    none = (np.empty(0, int), np.empty(0, int), np.empty(0))
    at_x, at_y = _shared_terms(x, y)
    if x.most[at_x] @ y.most[at_y] < least - _SLACK:
        return none
    often = x.often[at_x] | y.often[at_y]
    product, left = np.zeros((len(x.ids), len(y.ids))), []
    sides = [(x, _columns(x, at_x[often])), (y, _columns(y, at_y[often]))]
    for block, column in sides:
        left.append(np.sqrt(np.bincount(block.owner, np.where(column < 0, block.weights**2, 0.0), len(block.ids))))
    for first in range(0, int(often.sum()), COLUMNS):
        dense = []
        for block, column in sides:
            here = (column >= first) & (column < first + COLUMNS)
            table = np.zeros((len(block.ids), min(COLUMNS, int(often.sum()) - first)))
            table[block.owner[here], column[here] - first] = block.n[here]
            dense.append(table)
        product += dense[0] @ dense[1].T
    bound = np.outer(x.norms, y.norms)
    may = product + np.outer(left[0] * x.norms, left[1] * y.norms) >= bound * (least - _SLACK)
    if x.number == y.number:
        may &= np.triu(np.ones(may.shape, bool), 1)
    if not may.any():
        return none
    cx, cy = _columns(x, at_x[~often]), _columns(y, at_y[~often])
    # Rare terms of vectors that may still reach the bound with any of the other side.
    rest_x, rest_y = np.flatnonzero((cx >= 0) & may.any(axis=1)[x.owner]), np.flatnonzero((cy >= 0) & may.any(axis=0)[y.owner])
    rest_y = rest_y[np.argsort(cy[rest_y], kind="stable")]
    cx, cy = cx[rest_x], cy[rest_y]
    # Each posting of x with all postings of y of the same term.
    lo, hi = np.searchsorted(cy, cx, "left"), np.searchsorted(cy, cx, "right")
    each = hi - lo
    mine = np.repeat(np.arange(len(cx)), each)
    theirs = rest_y[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + lo[mine]]
    mine = rest_x[mine]
    np.add.at(product, (x.owner[mine], y.owner[theirs]), x.n[mine] * y.n[theirs])
    i, j = np.nonzero(may & (product / bound >= least - _SLACK))
    return i, j, product[i, j]


def _pairs(schema: pa.Schema, least: float):
    id_type = schema.field("a").type

    def pairs(x: _Block, y: _Block) -> pa.RecordBatch:
        i, j, product = block_products(x, y, least)
        both = x.ids + y.ids
        rank = np.empty(len(both), int)
        rank[sorted(range(len(both)), key=both.__getitem__)] = np.arange(len(both))
        j = j + len(x.ids)
        turn = rank[i] > rank[j]
        a, b = np.where(turn, j, i), np.where(turn, i, j)
        ids, squares = pa.array(both, id_type), np.concatenate([x.squares, y.squares])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(product), pa.array(squares[a]), pa.array(squares[b])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                xs, ys = ([_Block(b) for b in row.column(c)[0].as_py()] for c in ("x", "y"))
                for x in xs:
                    for y in ys:
                        if x.number <= y.number:
                            found = pairs(x, y)
                            if found.num_rows:
                                yield found

    return run


def products(vectors: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """a, b, product and both sums of squares (sa, sb) of all pairs of vectors whose cosine is at or over `least`,
    which is over 0. A vector is a row of id, terms (64 bits; a term may stand there more often), counts (of each, or
    null: one) and own: what its sum of squares has besides."""
    id_type = to_arrow_type(vectors.schema["id"].dataType)
    sparse = pa.schema([*((f"lead{k}", pa.int64()) for k in range(3)), ("id", id_type), ("terms", pa.binary()), ("counts", pa.binary()), ("own", pa.float64())])
    tiled = pa.schema([("tile", pa.int64()), ("bytes", pa.int64()), ("blocks", pa.list_(_block_type(id_type)))])
    found = pa.schema([("a", id_type), ("b", id_type), *((n, pa.float64()) for n in ("product", "sa", "sb"))])
    read = vectors.where("id IS NOT NULL AND size(terms) > 0").select("id", "terms", "counts", "own").mapInArrow(_sparse(sparse), from_arrow_schema(sparse))
    order = ["lead0", "lead1", "lead2", "id"]
    tiles = graph.checkpointed(read.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tiles(tiled, block), from_arrow_schema(tiled)))
    held = tiles.agg(F.sum("bytes")).first()[0] or 0
    tiles = tiles.coalesce(max(PARTS, -(-held // PART_BYTES)))
    x, y = tiles.select(F.col("tile").alias("t"), F.col("blocks").alias("x")), tiles.select(F.col("tile").alias("u"), F.col("blocks").alias("y"))
    return x.hint("shuffle_replicate_nl").join(y, F.col("t") <= F.col("u")).select("x", "y").mapInArrow(_pairs(found, least), from_arrow_schema(found))


def _cosines(found: DataFrame) -> DataFrame:
    return found.select("a", "b", F.round(F.col("product") / (F.sqrt("sa") * F.sqrt("sb")), 6).alias("cosine"))


def cosine_pairs(terms: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """a, b, cosine of all pairs of texts (id, term, n) at or over `least`, which is over 0. Null ids and terms
    belong to no text."""
    known = terms.where("id IS NOT NULL AND term IS NOT NULL AND n > 0").select("id", hashed(F.col("term"), terms.schema["term"].dataType).alias("t"), F.col("n").cast("double").alias("n"))
    both = known.groupBy("id").agg(F.collect_list(F.struct("t", "n")).alias("v"))
    return _cosines(products(both.select("id", F.col("v.t").alias("terms"), F.col("v.n").alias("counts"), F.lit(0.0).alias("own")), least, block))


def text_cosines(texts: DataFrame, least: float, words: int, block: int = BLOCK) -> DataFrame:
    """a, b, cosine of all pairs of texts (id, tokens) of so many tokens or more. Rows of one id are one text; what
    no other row has the id of is never shuffled by it."""
    lists = texts.where("id IS NOT NULL").select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("terms"))
    twice = texts.groupBy("id").agg(F.count("*").alias("rows")).where("id IS NOT NULL AND rows > 1").select("id")
    if not twice.isEmpty():
        together = lists.join(twice, "id", "left_semi").groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
        lists = lists.join(twice, "id", "left_anti").unionByName(together)
    long = lists.where(F.size("terms") >= words)
    return _cosines(products(long.select("id", "terms", F.lit(None).cast("array<double>").alias("counts"), F.lit(0.0).alias("own")), least, block))
