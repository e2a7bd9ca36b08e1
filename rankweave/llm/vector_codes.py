"""Product codes of vectors, with codebooks from rounds over Hilbert-sorted flat blocks.

A vector's components become integers floor(scale * x), and the vector is cut into equal consecutive
parts. For each part position a codebook of integer entries starts as that part of the vectors with the
smallest ids; a round assigns every part to its nearest entry (ties to the lower index) and replaces
each used entry by the floored mean of its parts. In the end parts are assigned once more.

The vectors are written once as chunks. Within a chunk each part position's points are sorted along a
Hilbert curve and laid out flat in blocks of BLOCK points, each with its min/max box and its sum. A round
first measures boxes against entries: an entry that is farther than another one all over a box can't win in
that block. What is left is the block's shortlist. A shortlist of one entry
takes the block by its stored sum, without a look at its points; others are evaluated by integer kernels
over the block's points and the shortlist. All arithmetic is exact.

A chunk holds whole vectors, so codes need no shuffle; a round's result is one sum for each part
position and entry, at most parts * entries rows from each task and to the driver.

Rows whose vector is null or holds a null or non-finite component are dropped. Scaled components beyond
+-2^24 count as +-2^24, so that distances stay exact. Vectors of another length than the first kept one
by id have no code: code, error null, and they add nothing to label_error. A length that the number of parts
doesn't divide is cut at floor(k * length / parts); a vector without components has error 0. Rows that
repeat are coded each, and count each. Null ids come after all others. With fewer vectors than entries the
codebooks are shorter. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.memory import give_back
from rankweave.llm.shared import materialised

#: Vectors of a chunk at most, and components about.
CHUNK = 1 << 16
CHUNK_VALUES = 1 << 22
BLOCK = 32
BOUND = 1 << 24
#: So many label sums are broadcast at most; labels of fewer rows are joined by a shuffle.
HOT = 1 << 16
_STORED = ("places", "flat", "low", "high", "sums")


@dataclass(frozen=True)
class Codebooks:
    """Entries by part position: books[p] is an integer array of shape (entries, width of part p)."""

    length: int
    books: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Digest of all entries' decimal components, by part, entry and position within the part."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def cuts(length: int, parts: int) -> list[int]:
    """Where parts begin and end."""
    return [k * length // parts for k in range(parts + 1)]


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """The order of integer points (n, width) along a Hilbert curve over their own range. Skilling's
    transform, on whole columns at a time."""
    n, width = points.shape
    if n < 2 or not width:
        return np.arange(n)
    x = points[:, :62].astype(np.int64)
    x -= x.min(axis=0)
    dims = x.shape[1]
    bits = max(1, min(10, 62 // dims))
    x >>= max(0, int(x.max()).bit_length() - bits)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for k in range(dims):
            high = (x[:, k] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, k]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, k] ^= swap
        q >>= 1
    for k in range(1, dims):
        x[:, k] ^= x[:, k - 1]
    turn = np.zeros(n, dtype=np.int64)
    q = top
    while q > 1:
        turn ^= np.where(x[:, dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(dims):
            key = key << 1 | (x[:, k] >> bit & 1)
    return np.argsort(key, kind="stable")


def flat_blocks(points: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, sorted points, and each block's least and greatest components and sums."""
    order = hilbert_order(points)
    flat = points[order]
    starts = np.arange(0, len(flat), size)
    reduce = lambda f, kind: f.reduceat(flat.astype(kind), starts, axis=0)
    return order, flat, reduce(np.minimum, np.int32), reduce(np.maximum, np.int32), reduce(np.add, np.int64)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(block, entry) truth: an entry may be the nearest of some point in the block's box. The entry whose
    greatest distance to the box is least rules out those that are farther than it all over the box: the difference
    of two squared distances is linear, so its greatest value lies in a corner."""
    low, high = low[:, None, :].astype(np.int64), high[:, None, :].astype(np.int64)
    most = (np.maximum(np.abs(low - book), np.abs(high - book)) ** 2).sum(axis=2)
    best = book[most.argmin(axis=1)][:, None, :]
    apart = book - best
    lead = (best**2).sum(axis=2) - (book**2).sum(axis=1) + 2 * np.maximum(low * apart, high * apart).sum(axis=2)
    return lead >= 0


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The first nearest of some entries, for each point."""
    # |p - e|^2 without |p|^2, which is the same for all entries.
    return (((entries**2).sum(axis=1)) - 2 * (points @ entries.T)).argmin(axis=1)


def assign_blocks(flat: np.ndarray, low: np.ndarray, high: np.ndarray, book: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The block's entry, or -1 where several are left; and the entry of each point."""
    listed = shortlists(low, high, book)
    alone = np.where(listed.sum(axis=1) == 1, listed.argmax(axis=1), -1)
    entry = np.repeat(alone, size)[: len(flat)]
    for block in np.flatnonzero(alone < 0):
        few = np.flatnonzero(listed[block])
        at = slice(block * size, (block + 1) * size)
        entry[at] = few[nearest(flat[at].astype(np.int64), book[few])]
    return alone, entry


def _kept(vectors: DataFrame, id_: str, vector: str, label: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    picked = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    return picked.where(F.coalesce(F.forall("v", finite), F.lit(False)))


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values * scale), -BOUND, BOUND).astype(np.int32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a chunk's size: the more points lie along a curve, the tighter the boxes."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK or sum(len(b.column(1).flatten()) for b in held) >= CHUNK_VALUES:
            yield joined()
            held.clear()
    if held:
        yield joined()


def _chunks(parts: int, scale: int):
    """Chunks of whole vectors of one length each, laid out as flat blocks by part position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            lists = batch.column(1)
            lengths = np.asarray(lists.value_lengths())
            starts = np.asarray(lists.offsets)[:-1]
            values = np.asarray(lists.values)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                for at in range(0, len(rows), CHUNK):
                    own = rows[at : at + CHUNK]
                    numbers = _scaled(values[starts[own][:, None] + np.arange(length)], scale)
                    edges = cuts(int(length), parts)
                    laid = [flat_blocks(numbers[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                    stored = zip(*((order.astype(np.uint16).tobytes(), *(x.tobytes() for x in rest)) for order, *rest in laid), strict=True)
                    carried = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), batch.column(c).take(pa.array(own))) for c in (0, 2)]
                    binary = [pa.array([list(x)], pa.list_(pa.binary())) for x in stored]
                    yield pa.RecordBatch.from_arrays([*carried, pa.array([length], pa.int32()), *binary], names=["ids", "labels", "length", *_STORED])
        give_back()

    return run


class _Part:
    """One part position of a stored chunk."""

    def __init__(self, batch: pa.RecordBatch, row: int, part: int, width: int) -> None:
        read = lambda name, kind: np.frombuffer(batch.column(name)[row][part].as_py(), kind)
        self.order = read("places", np.uint16)
        self.flat = read("flat", np.int32).reshape(len(self.order), width)
        blocks = -(-len(self.order) // BLOCK)
        self.low, self.high = (read(name, np.int32).reshape(blocks, width) for name in ("low", "high"))
        self.sums = read("sums", np.int64).reshape(blocks, width)


def _parts_of(batch: pa.RecordBatch, row: int, books: Codebooks) -> Iterator[tuple[int, _Part, np.ndarray]]:
    for p, book in enumerate(books.books):
        yield p, _Part(batch, row, p, book.shape[1]), book


def _round_sums(books: Codebooks):
    """Sums and counts for each part position and entry, over all of a task's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(b) for b in books.books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books.books]
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("length")[row].as_py() != books.length:
                    continue
                for p, part, book in _parts_of(batch, row, books):
                    alone, entry = assign_blocks(part.flat, part.low, part.high, book)
                    sizes = np.full(len(alone), BLOCK)
                    sizes[-1] = len(part.flat) - BLOCK * (len(alone) - 1)
                    whole = alone >= 0
                    np.add.at(sums[p], alone[whole], part.sums[whole])
                    np.add.at(counts[p], alone[whole], sizes[whole])
                    rest = ~np.repeat(whole, BLOCK)[: len(part.flat)]
                    np.add.at(sums[p], entry[rest], part.flat[rest])
                    counts[p] += np.bincount(entry[rest], minlength=len(book))
        found = [(p, int(e), sums[p][e].tolist(), int(counts[p][e])) for p in range(len(counts)) for e in np.flatnonzero(counts[p])]
        if found:
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["part", "entry", "total", "n"])
        give_back()

    return run


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                if batch.column("length")[row].as_py() != books.length:
                    codes, errors = pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())
                else:
                    code, error = np.empty((len(ids), len(books.books)), np.uint8), np.zeros(len(ids), np.int64)
                    for p, part, book in _parts_of(batch, row, books):
                        _, entry = assign_blocks(part.flat, part.low, part.high, book)
                        code[part.order, p] = entry
                        error[part.order] += ((part.flat - book[entry]) ** 2).sum(axis=1)
                    codes, errors = pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)
                yield pa.RecordBatch.from_arrays([ids, codes, errors, labels], names=["id", "code", "error", "label"])
        give_back()

    return run


def _chunked(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, length int, " + ", ".join(f"{c} array<binary>" for c in _STORED)
    return materialised(vectors.mapInArrow(_chunks(parts, scale), schema))


def _first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks of the first vectors by id."""
    rows = [np.array(r["v"], dtype=np.float64) for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    length = len(rows[0]) if rows else 0
    first = [_scaled(x, scale).astype(np.int64) for x in rows if len(x) == length]
    edges = cuts(length, parts)
    table = np.array(first, dtype=np.int64).reshape(len(first), length)
    return Codebooks(length, tuple(table[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)))


def refined(chunks: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one more round."""
    found = chunks.mapInArrow(_round_sums(books), "part int, entry int, total array<long>, n long")
    width = max((b.shape[1] for b in books.books), default=0)
    summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(width)))
    after = [b.copy() for b in books.books]
    for r in summed.collect():  # parts * entries rows at most
        book = after[r["part"]]
        book[r["entry"]] = [r[f"t{k}"] // r["n"] for k in range(book.shape[1])]
    return Codebooks(books.length, tuple(after))


def _with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: sums of frequent labels are broadcast, so that none of them meets in one task."""
    sums = materialised(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    least = max(256, (sums.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot, rare = sums.where(F.col("n") >= least).drop("n"), sums.where(F.col("n") < least).drop("n")
    names = lambda s: s.withColumnRenamed("label", "__label")
    same = F.col("label").eqNullSafe(F.col("__label"))
    often = coded.join(F.broadcast(names(hot)), same).drop("__label")
    others = coded.join(F.broadcast(names(hot)), same, "left_anti").join(names(rare), same).drop("__label")
    return often.unionByName(others)


def compress(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """Codes (id, code of two hex digits a part, error, label, label_error) of all kept vectors, and the
    codebooks that they refer to."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = _kept(vectors, id_, vector, label)
    books = _first_books(kept, parts, entries, scale)
    chunks = _chunked(kept, parts, scale)
    if len(books.books[0]):
        for _ in range(rounds):
            books = refined(chunks, books)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = materialised(chunks.mapInArrow(_coded(books), f"id {kinds['id']}, code string, error long, label {kinds['label']}"))
    return _with_label_error(coded), books


def decoded(codes: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """codes with `vector`: the entries that a code names, scaled back; null without a code."""
    names = [F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in book)) for book in books.books]
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(F.get(name, at(p)) for p, name in enumerate(names))))
