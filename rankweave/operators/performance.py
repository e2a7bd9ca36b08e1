"""Anchored windows, weighted roll-ups and period comparisons.

Windows end at the newest date a brand has, never at today. Averages are weighted by their denominators.
Comparisons take one scan: sums under a condition for the recent and the prior window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.safe import drop_pct, pct_change, ratio0, ratio_null


def anchors(daily: DataFrame, by: str = "brand", date: str = "date") -> DataFrame:
    """The newest date of each brand."""
    return daily.groupBy(by).agg(F.max(date).alias("anchor"))


def anchored(daily: DataFrame, by: str = "brand", date: str = "date") -> DataFrame:
    """Rows with their brand's anchor. The anchor comes by an aggregation that is joined back (one row a
    brand), so rows of a large brand stay spread."""
    return daily.join(anchors(daily, by, date), by)


def in_window(days: int, offset: int = 0, date: str = "date") -> Column:
    """Inclusive window of `days` that ends `offset` days before the anchor."""
    return F.col(date).between(F.date_sub("anchor", offset + days - 1), F.date_sub("anchor", offset))


def compare(daily: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Recent and prior sums of clicks, impressions and weighted position, and derived measures, per key."""
    rows = anchored(daily).where(F.col("date") > F.date_sub("anchor", 2 * days))
    recent, prior = in_window(days), in_window(days, days)
    sums = rows.groupBy(*keys).agg(
        *(F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).alias(f"{p}{c[0]}") for p, w in (("r", recent), ("p", prior)) for c in ("clicks", "impressions")),
        *(F.coalesce(F.sum(F.when(w, F.col("pos"))), F.lit(0)).alias(f"{p}w") for p, w in (("r", recent), ("p", prior))),
        *(F.count_distinct(F.when(w, F.col("date"))).alias(f"{p}days") for p, w in (("r", recent), ("p", prior))),
    )
    c = F.col
    return sums.select(
        *keys, "rc", "pc", "ri", "pi", "rdays", "pdays",
        ratio0(c("rc"), c("ri")).alias("rctr"), ratio0(c("pc"), c("pi")).alias("pctr"), ratio_null(c("rw"), c("ri")).alias("rpos"), ratio_null(c("pw"), c("pi")).alias("ppos"),
        drop_pct(c("rc"), c("pc")).alias("click_drop"), drop_pct(c("ri"), c("pi")).alias("imp_drop"), pct_change(c("rc"), c("pc")).alias("click_change"),
    )


def totals(daily: DataFrame, days: int) -> DataFrame:
    """Sums and weighted means of each brand's newest window; zero denominators give 0."""
    rows = anchored(daily).where(in_window(days))
    sums = rows.groupBy("brand").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum("pos").alias("w"), F.count("*").alias("rows"))
    return sums.select("brand", "clicks", "impressions", "rows", ratio0(F.col("clicks"), F.col("impressions")).alias("ctr"), ratio0(F.col("w"), F.col("impressions")).alias("position"))


def roll_up(daily: DataFrame, keys: list[str], least_impressions: int = 0) -> DataFrame:
    """Sums per key with a weighted position that is null without impressions."""
    sums = daily.groupBy(*keys).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum("pos").alias("w"))
    kept = sums.where(F.col("impressions") >= least_impressions) if least_impressions else sums
    return kept.select(*keys, "clicks", "impressions", ratio_null(F.col("clicks"), F.col("impressions")).alias("ctr"), ratio_null(F.col("w"), F.col("impressions")).alias("position"))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a total order."""
    return rows.orderBy(*order).limit(k)


def top_per(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, by a total order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def cannibalised(results: DataFrame, least_row: int, least_pages: int, least_impressions: int) -> DataFrame:
    """Queries that several pages answer: page count, weighted and best position, owning page."""
    rows = results.where(F.col("impressions") >= least_row)
    pages = rows.groupBy("query", "page").agg(F.sum("impressions").alias("i"), F.sum(F.col("position") * F.col("impressions")).alias("w"), F.min("position").alias("best"))
    out = pages.groupBy("query").agg(F.count("*").alias("pages"), F.sum("i").alias("impressions"), F.sum("w").alias("w"), F.min("best").alias("best_position"), F.max(F.struct("i", (-F.col("page")).alias("p"))).alias("own"))
    kept = out.where((F.col("pages") >= least_pages) & (F.col("impressions") >= least_impressions))
    return kept.select("query", "pages", "impressions", ratio_null(F.col("w"), F.col("impressions")).alias("position"), "best_position", (-F.col("own.p")).alias("page"))


def distinct_in_windows(daily: DataFrame, days: int) -> DataFrame:
    """Entities with impressions in the recent and in the prior window of each brand."""
    seen = F.col("impressions") > 0
    rows = anchored(daily).where(F.col("date") > F.date_sub("anchor", 2 * days))
    return rows.groupBy("brand").agg(F.count_distinct(F.when(in_window(days) & seen, F.col("entity"))).alias("recent"), F.count_distinct(F.when(in_window(days, days) & seen, F.col("entity"))).alias("prior"))


def last_week(daily: DataFrame) -> DataFrame:
    """Sums of the last whole Monday-to-Sunday week on or before each anchor, and of the week before."""
    sunday = F.date_sub("anchor", F.dayofweek("anchor") - 1)
    rows = anchored(daily).withColumn("end", sunday)
    recent, prior = F.col("date").between(F.date_sub("end", 6), F.col("end")), F.col("date").between(F.date_sub("end", 13), F.date_sub("end", 7))
    return rows.groupBy("brand", "end").agg(*(F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).alias(f"{n}_{c}") for n, w in (("week", recent), ("prior", prior)) for c in ("clicks", "impressions")))


def split_half_trend(daily: DataFrame, least: int = 4) -> DataFrame:
    """Clicks of the first half of the days present against the rest; null with fewer than `least` days."""
    days = daily.groupBy("brand", "date").agg(F.sum("clicks").alias("clicks"))
    w = Window.partitionBy("brand")
    placed = days.withColumn("k", F.row_number().over(w.orderBy("date"))).withColumn("n", F.count("*").over(w))
    first = F.col("k") <= F.floor(F.col("n") / 2)
    sums = placed.groupBy("brand").agg(F.max("n").alias("days"), F.sum(F.when(first, F.col("clicks")).otherwise(0)).alias("first_half"), F.sum(F.when(~first, F.col("clicks")).otherwise(0)).alias("second_half"))
    return sums.withColumn("change", F.when(F.col("days") >= least, F.col("second_half") - F.col("first_half")))


def monthly_change(daily: DataFrame) -> DataFrame:
    """Mean of the newest three months present against the mean of the first three."""
    months = daily.groupBy("brand", F.trunc("date", "month").alias("month")).agg(F.sum("clicks").alias("clicks"))
    w = Window.partitionBy("brand")
    placed = months.withColumn("k", F.row_number().over(w.orderBy("month"))).withColumn("n", F.count("*").over(w))
    mean = lambda cond: ratio_null(F.sum(F.when(cond, F.col("clicks")).otherwise(0)), F.count_if(cond))
    return placed.groupBy("brand").agg(F.max("n").alias("months"), mean(F.col("k") <= 3).alias("first"), mean(F.col("k") > F.col("n") - 3).alias("last"))


def moving_means(daily: DataFrame, width: int = 3) -> DataFrame:
    """Mean clicks of each month and the `width` - 1 months before; null until so many are there."""
    months = daily.groupBy("brand", F.trunc("date", "month").alias("month")).agg(F.sum("clicks").alias("clicks"))
    w = Window.partitionBy("brand").orderBy("month").rowsBetween(1 - width, 0)
    return months.select("brand", "month", "clicks", F.when(F.count("*").over(w) == width, ratio_null(F.sum("clicks").over(w), F.lit(width))).alias("mean"))


def click_curve(results: DataFrame, least: int = 200, prior: int = 1000) -> DataFrame:
    """Click rate by position bucket, shrunk to the overall rate and made non-increasing."""
    bucket = F.when(F.col("position") <= 10, F.col("position")).when(F.col("position") <= 15, 15).otherwise(20)
    sums = results.groupBy(bucket.cast("long").alias("bucket")).agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i")).where(F.col("i") >= least)
    all_ = results.agg(F.sum("clicks").alias("ac"), F.sum("impressions").alias("ai"))
    shrunk = sums.crossJoin(F.broadcast(all_)).withColumn("rate", (F.col("c") + prior * ratio0(F.col("ac"), F.col("ai"))) / (F.col("i") + prior))
    return shrunk.select("bucket", "c", "i", F.min("rate").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("rate"))


def divergence(daily: DataFrame, days: int) -> DataFrame:
    """Jensen-Shannon divergence, in bits, of each brand's clicks over entities between two windows."""
    sums = compare(daily, ["brand", "entity"], days).select("brand", "entity", "rc", "pc")
    all_ = sums.groupBy("brand").agg(F.sum("rc").alias("r"), F.sum("pc").alias("p"))
    shares = sums.join(all_, "brand").select("brand", "r", "p", ratio_null(F.col("rc"), F.col("r")).alias("a"), ratio_null(F.col("pc"), F.col("p")).alias("b"))
    middle = (F.col("a") + F.col("b")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / middle)).otherwise(0.0)
    out = shares.groupBy("brand").agg(((F.sum(part("a")) + F.sum(part("b"))) / 2).alias("d"), F.max("r").alias("r"), F.max("p").alias("p"))
    return out.select("brand", F.when((F.col("r") > 0) & (F.col("p") > 0), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("d"))), 6)).alias("divergence"))
