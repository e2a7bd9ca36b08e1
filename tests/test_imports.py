"""Delimited files with quoted line breaks against the standard library's reader, and forms of dates."""

from __future__ import annotations

import csv
import datetime
import io
import random

import pytest
from pyspark.sql import functions as F

from rankweave.operators import imports


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_quoted_line_breaks(spark, block):
    """Each file is written with one of four delimiters and read back; records go over many lines and blocks."""
    rng = random.Random(block)
    lines, want = [], {}
    for file, delimiter in enumerate([",", ";", "\t", "|"]):
        rows = [["Keyword", "Rank", "Note"]]
        for _ in range(60):
            rows.append(["".join(rng.choices(["a", " b", '"', "\n", delimiter, "\n\n", ""], k=rng.randint(1, 6))) + "z" for _ in range(3)])
        out = io.StringIO()
        csv.writer(out, delimiter=delimiter, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows(rows)
        lines += [(file, 3 * at, line) for at, line in enumerate(out.getvalue().split("\n"))]
        want[file] = [[c.strip() for c in r] for r in rows]
    rng.shuffle(lines)
    frame = spark.createDataFrame(lines, "file long, at long, line string")
    joined = imports.records(frame, block)
    got = {}
    for r in imports.delimited(frame).orderBy("file", "at").collect():
        got.setdefault(r["file"], []).append([c.strip() for c in r["cells"]])
    assert got == want
    assert joined.where("trim(line) <> ''").count() == sum(map(len, want.values()))


def test_forms_of_dates(spark):
    march = datetime.date(2024, 3, 4)
    cases = {"2024-03-04": march, "2024-03-04T10:00:00Z": march, "2024/3/4": march, " 4 Mar 2024 ": march, "4 march 2024": march, "MAR 4, 2024": march, "March 4 2024": march, "03/04/2024": None, "": None, "soon": None, "2024-13-01": None, "31 Feb 2024": None}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", imports.as_date(F.col("c")).alias("d")).collect()
    assert {r["c"]: r["d"] for r in got} == cases


def test_ranks_by_place_and_device(spark):
    text = ["Keyword,Position,Date,Device,Location", "a,3,2024-01-05,Mobile,Leeds", "a,4,2024-01-05,Mobile,", "a,5,2024-01-05,mobile,Leeds"]
    rows = imports.delimited(spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "file long, at long, line string"))
    got = sorted((r["location"], r["device"], r["position"]) for r in imports.ranks(rows).collect())
    assert got == [("Leeds", "mobile", 5.0), ("default", "mobile", 4.0)]


def test_upserts_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    """Two loads that overlap and a rerun; keys with nulls; several rows of a key in one load."""
    folder = f"{tmp_path}/table"
    frame = lambda rows: spark.createDataFrame(rows, "k string, day int, v long, at int")
    first = [(f"k{i}", i % 3, i, 1) for i in range(60)] + [(None, 1, 7, 1), ("k1", 1, 1000, 0)]
    table = imports.Upserts(frame(first).schema, ["k", "day"], ["at"], folder, 8).load(frame(first))
    rows = lambda: {(r["k"], r["day"]): r["v"] for r in table.read(spark).collect()}
    want = {(k, d): v for k, d, v, at in first if at}
    assert rows() == want and table.read(spark).count() == len(want)
    files = lambda: {p.relative_to(folder): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before, second = files(), [("k5", 2, 555, 2), (None, 1, 8, 2), ("new", None, 9, 2), ("k5", 2, 556, 3)]
    table.load(frame(second))
    want |= {("k5", 2): 556, (None, 1): 8, ("new", None): 9}
    assert rows() == want
    changed = {p.parts[0] for p in set(before.items()) ^ set(files().items()) for p in [p[0]]}
    assert len(changed) <= 3 and len({p.parts[0] for p in before}) > 3
    table.load(frame(second))
    assert rows() == want and table.read(spark).count() == len(want)
    assert table.load(frame([])) is table and rows() == want
