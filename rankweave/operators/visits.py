"""Session measures and their changes, newest measurements, and range joins by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.safe import drop_pct, ratio0
from rankweave.operators.performance import anchored, in_window

_SUMS = ("sessions", "engaged", "conversions")


def rates(visits: DataFrame, by: str) -> DataFrame:
    """Means weighted by sessions; 0 without sessions."""
    sums = visits.groupBy(by).agg(*(F.sum(c).alias(c) for c in (*_SUMS, "seconds")))
    s = F.col("sessions")
    return sums.select(by, "sessions", ratio0(F.col("seconds"), s).alias("avg_duration"), ratio0(F.col("engaged"), s).alias("engagement_rate"), ratio0(s - F.col("engaged"), s).alias("bounce_rate"), ratio0(F.col("conversions"), s).alias("conversion_rate"))


def change(visits: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Sums of the recent and the prior window (r_, p_), falls in percent and rates, from one scan."""
    rows = anchored(visits).where(F.col("date") > F.date_sub("anchor", 2 * days))
    windows = (("r", in_window(days)), ("p", in_window(days, days)))
    sums = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).alias(f"{p}_{c}") for p, w in windows for c in _SUMS))
    falls = (drop_pct(F.col(f"r_{c}"), F.col(f"p_{c}")).alias(f"{c}_drop") for c in ("sessions", "conversions"))
    shares = (ratio0(F.col(f"{p}_{c}") * 100, F.col(f"{p}_sessions")).alias(f"{p}_{c}_rate") for p in "rp" for c in ("engaged", "conversions"))
    return sums.select("*", *falls, *shares)


def stalled(daily: DataFrame, by: list[str], days: int) -> DataFrame:
    """Keys whose newest date is more than `days` older than the newest of all; a key without rows is silent."""
    newest = daily.groupBy(*by).agg(F.max("date").alias("newest"))
    now = newest.agg(F.max("newest").alias("now"))  # one row
    return newest.crossJoin(F.broadcast(now)).select(*by, "newest", F.date_diff("now", "newest").alias("age")).where(F.col("age") > days)


def last_two(rows: DataFrame, by: list[str], value: Column, *order: str) -> DataFrame:
    """The newest value of each key and the one before (null if there is none). The two newest rows are kept
    by partial aggregates, so a key of any size needs no sort of its rows."""
    pair = F.struct(*order, value.alias("v"))
    newest = rows.groupBy(*by).agg(F.max(pair).alias("a"))
    rest = rows.join(newest.select(*by, "a"), by).where(pair < F.col("a")).groupBy(*by).agg(F.max(pair).alias("b"))
    return newest.join(rest, by, "left").select(*by, F.col("a.v").alias("latest"), F.col("b.v").alias("previous"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The value at place floor(n / 2) from 0 of each key's sorted values, never between two of them. Equal
    values are counted first, so that only distinct values are sorted."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    placed = counted.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    return placed.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(by).agg(F.min(value).alias("median"), F.max("all").alias("samples"))


def in_intervals(notes: DataFrame, daily: DataFrame, days: int = 8) -> DataFrame:
    """Rows of daily (brand, date) within the notes' intervals (brand, starts, ends; an open end is one day).
    Intervals are cut into pieces of `days` days that meet the dates' pieces in an equi-join."""
    piece = lambda d: F.floor(F.unix_date(d) / days)
    cut = notes.withColumn("ends", F.coalesce("ends", "starts")).where("ends >= starts").withColumn("piece", F.explode(F.sequence(piece(F.col("starts")), piece(F.col("ends")))))
    return daily.withColumn("piece", piece(F.col("date"))).join(cut, ["brand", "piece"]).where("date BETWEEN starts AND ends").drop("piece")
