"""Streams whose files come late and out of order against the batch answer."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from rankweave.streaming import counters

SCHEMA = "key long, seen timestamp, id long, status string, value long"


def written(spark, folder, rows, files, seed):
    """The rows in so many files, which a stream reads one after the other."""
    rng = random.Random(seed)
    rng.shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def plain(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r[1], r[2], r[3], r[4]) for r in rows if r[0] == key)
        changes = sum(a[2] != b[2] for a, b in zip(own, own[1:], strict=False))
        ok = [r[3] for r in own if r[2] != "error"][::-1][:3]
        out[key] = (len(own), changes, own[0][1], own[-1][1], max(r[3] for r in own), own[-1][2], own[-2][2] if len(own) > 1 else None, *(ok + [None] * 3)[:3], len(ok))
    return out


@pytest.mark.parametrize("files", [1, 7])
def test_monitors_of_shuffled_files(spark, tmp_path, files):
    rng = random.Random(files)
    start = datetime(2024, 1, 1)
    rows = [(rng.randint(0, 6), start + timedelta(minutes=rng.randint(0, 30 * 1440)), k, rng.choice(["view", "error", "click"]), rng.randint(1, 999)) for k in range(400)]
    stream = written(spark, str(tmp_path), list(rows), files, 3)
    got = counters.drained(counters.monitored(stream, "40 days"), "update", ("key",)).collect()
    assert {r["key"]: tuple(r)[1:] for r in got} == plain(rows)


def test_rows_are_released_by_the_watermark_and_late_ones_dropped(spark, tmp_path):
    start = datetime(2024, 1, 1)
    first = [(1, start + timedelta(days=d), d, "error" if d % 2 else "view", d) for d in range(20)]
    late = [(1, start + timedelta(days=3, hours=1), 99, "click", 7), (1, start + timedelta(days=19, hours=-5), 100, "view", 8)]
    for k, rows in enumerate([first, [(2, start + timedelta(days=19), 50, "view", 1)], late]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = {r["key"]: tuple(r)[1:] for r in counters.drained(counters.monitored(stream, "2 days"), "update", ("key",)).collect()}
    assert got == plain(first + late[1:] + [(2, start, 50, "view", 1)])
