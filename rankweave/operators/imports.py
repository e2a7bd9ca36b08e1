"""Delimited exports, JSON and feeds read into rows, and sinks that can be written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rankweave.operators import graph
from rankweave.operators.content import all_matches
from rankweave.sources import shared

DELIMITERS = [",", "\t", ";", "|"]
#: Header names of each field, without case, spaces, underscores, hyphens and dots.
FIELDS = {
    "keyword": ["keyword", "keywords", "query", "searchterm", "term", "phrase", "kw"],
    "position": ["position", "rank", "ranking", "pos", "currentposition", "currentrank", "googleposition", "rankgoogle"],
    "url": ["url", "landingpage", "rankingurl", "page", "resulturl"],
    "location": ["location", "locale", "city", "region", "geo", "country", "market", "searchlocation"],
    "device": ["device", "devicetype", "platform"],
    "engine": ["engine", "searchengine", "se"],
    "search_volume": ["searchvolume", "volume", "sv", "avgmonthlysearches", "monthlysearches"],
    "captured_on": ["date", "captureddate", "capturedon", "checkdate", "checked", "checkedat", "day", "timestamp", "datetime"],
}
UNRANKED = ["", "-", "n/a", "na", "null", "not ranked", "not found", "nr"]


def sniffed(line: Column) -> Column:
    """The delimiter that a header line holds most often; a comma where it holds none."""
    counts = [F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(-k).alias("first"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)]
    return F.array_max(F.array(*counts))["d"]


def fields(line: Column, delimiter: Column) -> Column:
    """A line's fields; quoted ones may hold the delimiter, and quotes as doubled quotes."""

    def split(d: str) -> Column:
        quoted = F.transform(all_matches(F.concat(F.lit(d), line), rf'\Q{d}\E("(?:[^"]|"")*"|[^\Q{d}\E]*)', 1), lambda f: F.trim(f))
        return F.transform(quoted, lambda f: F.when(f.rlike(r'^"[\s\S]*"$'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))

    return F.coalesce(*(F.when(delimiter == d, split(d)) for d in DELIMITERS))


def records(lines: DataFrame, block: int = 4096) -> DataFrame:
    """file, at and line of each record of (file, at, line): physical lines of which those that begin inside quotes
    go on with the line before. Whether a line does is the parity of the quotes before it in its file, a prefix
    sum in blocks of `block` places: blocks' sums are added up over a file, and lines within a block only, so
    blocks are worked off apart. `at` is the first line's."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    placed = lines.select("file", "at", "line", quotes.alias("q"), F.floor(F.col("at") / block).alias("block"))
    over = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("file", "block").agg(F.sum("q").alias("q"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("q").over(over("file", "block")), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum("q").over(over("file", "block", "at")), F.lit(0))
    opened = placed.join(blocks, ["file", "block"]).withColumn("starts", (F.col("above") + inside) % 2 == 0)
    firsts = opened.groupBy("file", "block").agg(F.max(F.when(F.col("starts"), F.col("at"))).alias("last"))
    firsts = firsts.select("file", "block", F.max("last").over(over("file", "block")).alias("begun"))
    own = F.max(F.when(F.col("starts"), F.col("at"))).over(Window.partitionBy("file", "block").orderBy("at"))
    whole = opened.join(firsts, ["file", "block"]).withColumn("first", F.coalesce(own, F.col("begun"), F.col("at")))
    joined = whole.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts"))
    return joined.select("file", F.col("first").alias("at"), F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("line"))


def delimited(lines: DataFrame) -> DataFrame:
    """file, at and cells of each record of (file, at, line); quoted cells may hold line breaks. A file's first record
    with text names its delimiter. A byte-order mark before it goes."""
    clean = records(lines).withColumn("line", F.regexp_replace("line", "^﻿", "")).where("trim(line) <> ''")
    heads = clean.groupBy("file").agg(F.min_by("line", "at").alias("head"), F.min("at").alias("first"))
    placed = clean.join(heads.select("file", "first", sniffed(F.col("head")).alias("d")), "file")
    return placed.select("file", "at", (F.col("at") == F.col("first")).alias("header"), fields(F.col("line"), F.col("d")).alias("cells"))


#: Forms of dates that can't be misread; day and month by numbers alone are turned away.
DATES = ["yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy"]


def as_date(cell: Column) -> Column:
    """A date in one of the forms of DATES, or in ISO's, whatever follows it."""
    text = F.initcap(F.regexp_replace(F.trim(cell), r"\s+", " "))
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))
    return F.coalesce(iso, *(F.try_to_timestamp(text, F.lit(form)) for form in DATES)).cast("date")


def as_position(cell: Column) -> Column:
    """A rank from 1 to 100; null for all the ways of saying that there is none."""
    text = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    number = F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")
    return F.when(~text.isin(UNRANKED) & ~text.rlike(r"^[><]\s*[0-9]+$") & ~text.rlike(r"^[0-9]+\s*\+$") & (number > 0) & (number <= 100), number)


def field_of(header: Column) -> Column:
    """The field that a header names; null if none."""
    norm = F.regexp_replace(F.lower(F.trim(header)), r"[\s_.-]+", "")
    return F.coalesce(*(F.when(norm.isin(names), field) for field, names in FIELDS.items()))


def headers(rows: DataFrame) -> DataFrame:
    """file, at (place), name, field and day of each header cell; a field goes to the first cell that names it."""
    cells = rows.where("header").select("file", F.posexplode("cells").alias("k", "name")).select("file", "k", "name", as_date(F.col("name")).alias("day"), field_of(F.col("name")).alias("field"))
    first = F.row_number().over(Window.partitionBy("file", "field").orderBy("k")) == 1
    return cells.withColumn("field", F.when(F.col("day").isNull() & first, F.col("field")))


def ranks(rows: DataFrame) -> DataFrame:
    """file, keyword, captured_on, location, device, engine and position: long files as they are, wide ones (two
    or more headers that are dates) a row a date; of several rows of one key the last one of the file counts."""
    place = lambda field: F.max(F.when(F.col("field") == field, F.col("k")))
    keyed = {"keyword": "kw", "position": "pos", "captured_on": "on", "location": "at_location", "device": "at_device", "engine": "at_engine"}
    heads = headers(rows).groupBy("file").agg(
        F.count("day").alias("days"), *(place(f).alias(c) for f, c in keyed.items()), F.collect_list(F.when(F.col("day").isNotNull(), F.struct("k", "day"))).alias("dated")
    )
    cell = lambda c: F.get("cells", F.col(c))
    given = lambda c, other: F.coalesce(F.when(F.trim(cell(c)) != "", F.trim(cell(c))), F.lit(other))
    key = [cell("kw").alias("keyword"), given("at_location", "default").alias("location"), F.lower(given("at_device", "")).alias("device"), F.lower(given("at_engine", "")).alias("engine")]
    body = rows.where("NOT header").join(heads, "file")
    wide = body.where("days >= 2").select("file", "at", *key, "cells", F.explode("dated").alias("c")).select("file", "at", "keyword", "location", "device", "engine", F.col("c.day").alias("captured_on"), cell("c.k").alias("cell"))
    long_ = body.where("days < 2").select("file", "at", *key, as_date(cell("on")).alias("captured_on"), cell("pos").alias("cell"))
    both = wide.unionByName(long_).where("keyword <> '' AND captured_on IS NOT NULL")
    return both.groupBy("file", "keyword", "captured_on", "location", "device", "engine").agg(as_position(F.max_by("cell", "at")).alias("position"))


def facets(rows: DataFrame, columns: list[str], least: int = 2, most: int = 12) -> DataFrame:
    """name, value and rows of the columns that have `least` to `most` distinct values."""
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("c")).select("c.*")
    counted = cells.groupBy("name", "value").agg(F.count("*").alias("rows"))
    kinds = counted.groupBy("name").agg(F.count("*").alias("k")).where(F.col("k").between(least, most)).select("name")
    return counted.join(F.broadcast(kinds), "name")


def replaced(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """A table written by partitions of the keys, in which those that `after` has are then written anew; read back."""
    spark = before.sparkSession
    path = shared.folder(spark)
    before.write.partitionBy(*keys).parquet(path)
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return spark.read.parquet(path)


def written_csv(rows: DataFrame) -> DataFrame:
    """The rows through CSV files with a header, in the shared folder."""
    spark = rows.sparkSession
    path = shared.folder(spark)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


class Upserts:
    """A table of rows by key in the shared folder, in hash buckets of the key. A load replaces the rows of its keys
    and adds new ones: the buckets that it touches are read, merged and written over, the others stay as they
    are. A load that is run again leaves the same rows. Of a load's rows of one key the last by `order` counts."""

    def __init__(self, schema: StructType, keys: list[str], order: list[str], folder: str, buckets: int = 16) -> None:
        self.schema, self.keys, self.order, self.folder, self.buckets = schema, keys, order, folder, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket"))

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        whole = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        if not shared.exists(spark, self.folder):
            return spark.createDataFrame([], whole)
        rows = spark.read.schema(whole).parquet(self.folder)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def load(self, rows: DataFrame) -> Upserts:
        spark = rows.sparkSession
        news = graph.checkpointed(newest(self._placed(rows), self.keys, self.order))
        touched = [r["bucket"] for r in news.select("bucket").distinct().collect()]  # self.buckets at most
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        kept = self.read(spark, touched).alias("o").join(news.alias("n"), [F.col("o.bucket") == F.col("n.bucket"), *same], "left_anti")
        # Merged rows are complete before any bucket is written over.
        merged = graph.checkpointed(kept.unionByName(news))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)
        return self


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert in which the last write wins."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n")
