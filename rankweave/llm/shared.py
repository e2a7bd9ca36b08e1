"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z, as a table for bytes.translate.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Longer texts are hashed in blocks of about so many bytes, cut between words.
TEXT_BLOCK = 1 << 20
_scopes: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees."""
    ensure_checkpoints(spark)
    above = _scopes[-1] if _scopes else spark.sparkContext.getCheckpointDir().rstrip("/")
    return f"{above}/{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Steps that are materialised inside go below one folder, which is deleted at the end: for work whose
    result has been written elsewhere by then."""
    folder = shared_folder(spark)
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in the cluster's store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Takes the checkpoint folder that the cluster names. A local session without one gets its own; on a
    cluster a folder of one machine would lose data, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="spark-ckpt-")
        context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint: lineage ends and lost executors don't matter."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> DataFrame:
    """The same rows written once as Parquet in the shared folder and read back (compressed and
    columnar, where checkpoint() would keep whole rows)."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(column: str, folds: int):
    """crc32 of an id's decimal text, modulo folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that every input bit reaches every output bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for texts of one block, made anew for longer words."""
    if len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    size = 1 << max(12, int(n - 1).bit_length())
    tables = {}
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
        table_ = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        table_[0] = 1
        tables[name] = np.multiply.accumulate(table_)
    if size <= 2 * TEXT_BLOCK:
        _powers.update(tables)
    return tables["up"], tables["down"]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a whole UTF-8 text, in order, without a Python
    loop over words. Memory beyond the text and its hashes is bounded by a block or the longest word."""
    if len(text) <= TEXT_BLOCK:
        return _block_hashes(text)
    parts, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, at + TEXT_BLOCK)
        end = space.start() if space else len(text)
        parts.append(_block_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


def _block_hashes(text: bytes) -> np.ndarray:
    """A polynomial prefix sum over bytes gives any word's hash from its two ends."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, repeats included; a shorter text is one run; no words, none."""
    if not len(words):
        return words
    count = max(1, len(words) - width + 1)
    acc = np.full(count, np.uint64(min(width, len(words))), dtype=np.uint64)
    for k in range(min(width, len(words))):
        acc = mix64(acc * np.uint64(_BASE) + words[k : k + count])
    return acc
