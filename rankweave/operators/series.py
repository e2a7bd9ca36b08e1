"""Latest, previous and changed values of measurement series, lead roll-ups and rank captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.safe import ratio_null

BAD = "error"


def _newest_first():
    return Window.partitionBy("key").orderBy(F.desc("seen"), F.desc("id"))


def newest(series: DataFrame, k: int = 1) -> DataFrame:
    """The k newest measurements of each key, numbered from 1."""
    return series.withColumn("k", F.row_number().over(_newest_first())).where(F.col("k") <= k)


def latest(series: DataFrame) -> DataFrame:
    """The newest measurement of each key."""
    return series.groupBy("key").agg(F.max_by(F.struct("id", "status", "value"), F.struct("seen", "id")).alias("m")).select("key", "m.id", "m.status", "m.value")


def second_latest(series: DataFrame) -> DataFrame:
    """The measurement before the newest."""
    return newest(series, 2).where("k = 2").select("key", "id", "status", "value")


def turned_bad(series: DataFrame) -> DataFrame:
    """Keys whose newest status is bad and whose one before was not."""
    two = newest(series, 2).groupBy("key").agg(F.max(F.when(F.col("k") == 1, F.col("status"))).alias("now"), F.max(F.when(F.col("k") == 2, F.col("status"))).alias("before"))
    return two.where((F.col("now") == BAD) & (F.col("before") != BAD))


def failing_run(series: DataFrame, k: int = 2) -> DataFrame:
    """Keys whose last k measurements all failed."""
    return newest(series, k).groupBy("key").agg(F.count("*").alias("checks"), F.count_if(F.col("status") == BAD).alias("failed")).where((F.col("checks") == k) & (F.col("failed") == k))


def slow_lately(series: DataFrame, k: int = 3, over: int = 6000) -> DataFrame:
    """Keys whose last k good measurements are above a bound on average."""
    means = newest(series.where(F.col("status") != BAD), k).groupBy("key").agg(F.count("*").alias("checks"), ratio_null(F.sum("value"), F.count("*")).alias("mean"))
    return means.where(F.col("mean") > over)


def changes(series: DataFrame) -> DataFrame:
    """Status changes of each key from one measurement to the next."""
    w = Window.partitionBy("key").orderBy("seen", "id")
    return series.withColumn("before", F.lag("status").over(w)).groupBy("key").agg(F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("status"))).alias("changes"), F.count("*").alias("rows"))


def first_and_last(series: DataFrame) -> DataFrame:
    """First and newest id, largest value and last status of each key."""
    return series.groupBy("key").agg(F.min_by("id", F.struct("seen", "id")).alias("first_id"), F.max_by("id", F.struct("seen", "id")).alias("last_id"), F.max("value").alias("most"), F.max_by("status", F.struct("seen", "id")).alias("status"))


def lead_summary(leads: DataFrame, by: list[str]) -> DataFrame:
    """Counts and values of leads under conditions."""
    won = F.col("status") == "F"
    return leads.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(won).alias("won"), F.count_if(F.col("status") == "O").alias("open"), F.count_if(F.col("status") == "P").alias("qualified"),
        F.sum("value").alias("value"), F.sum(F.when(won, F.col("value")).otherwise(0)).alias("won_value"), F.count_distinct("person").alias("people"),
    )


def lead_days(leads: DataFrame) -> DataFrame:
    """Leads of each day from the first to the last; days without any count 0."""
    days = leads.groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return span.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0)).alias("value"))


def rank_moves(ranks: DataFrame) -> DataFrame:
    """Each keyword of the newest capture against the capture before: absent (new), unranked and ranked
    are three different things."""
    dates = ranks.select("captured_on").distinct().orderBy(F.desc("captured_on")).limit(2)
    ends = dates.agg(F.max("captured_on").alias("hi"), F.min("captured_on").alias("lo")).where("lo < hi")
    now = ranks.join(F.broadcast(ends), F.col("captured_on") == F.col("hi")).select("keyword", F.col("position").alias("now"))
    before = ranks.join(F.broadcast(ends), F.col("captured_on") == F.col("lo")).select("keyword", F.col("position").alias("before"), F.lit(True).alias("present"))
    move = (
        F.when(F.col("present").isNull(), "new").when(F.col("before").isNull() & F.col("now").isNull(), "unranked").when(F.col("before").isNull(), "entered").when(F.col("now").isNull(), "lost")
        .when(F.col("now") < F.col("before"), "improved").when(F.col("now") > F.col("before"), "declined").otherwise("flat")
    )
    return now.join(before, "keyword", "left").select("keyword", "now", "before", move.alias("move"), (F.col("before") - F.col("now")).alias("delta"))


def rank_spread(ranks: DataFrame) -> DataFrame:
    """Tracked, ranked, top 3, 10 and 20 and mean position of each capture."""
    p = F.col("position")
    return ranks.groupBy("captured_on").agg(
        F.count("*").alias("tracked"), F.count("position").alias("ranked"), *(F.count_if(p <= k).alias(f"top{k}") for k in (3, 10, 20)), ratio_null(F.sum("position"), F.count("position")).alias("mean"),
        ratio_null(F.count_if(p <= 10), F.count("*")).alias("top10_share"),
    )


def tie_averaged_rank(rows: DataFrame, value: str) -> DataFrame:
    """Share of rows above each value, ties counted half: the top row gets the lowest share."""
    counts = rows.groupBy(value).agg(F.count("*").alias("ties"))
    above = F.coalesce(F.sum("ties").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("ties").over(Window.partitionBy())
    return counts.select(value, "ties", ratio_null(above + F.col("ties") / 2, n).alias("percentile"))


def gini(counts: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of a column of counts, from how often each count comes."""
    each = counts.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The ranks before + 1 .. before + m all have value x.
    placed = each.withColumn("ranks", F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2)
    sums = placed.agg(F.sum(F.col("ranks") * F.col("x")).alias("ix"), F.sum(F.col("m") * F.col("x")).alias("x"), F.sum("m").alias("n"))
    value_: Column = ratio_null(2 * F.col("ix"), F.col("n") * F.col("x")) - ratio_null(F.col("n") + 1, F.col("n"))
    return sums.select("n", F.round(value_, 3).alias("gini"))


def places(rows: DataFrame, by: str, value: str, shares: tuple[float, ...], least: int) -> DataFrame:
    """The values at the places floor(share * (n - 1)) of each key's sorted values, of keys with `least` or
    more. Equal values are counted first, so only distinct values are sorted and no list is collected."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    placed = counted.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w)).where(F.col("all") >= least)
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.lit(share) * (F.col("all") - 1)), F.col(value)))
    return placed.groupBy(by).agg(*(at(share).alias(f"p{int(share * 100)}") for share in shares))
