"""Weighted scores in which unknown counts on neither side, and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.safe import ratio_null


def weighted_pass_score(checks: DataFrame, by: list[str]) -> DataFrame:
    """100 * sum w (1 - sqrt(failed / total)) / sum w over checks (weight, failed, total); checks without
    anything to fail leave both sums."""
    measured = checks.where((F.col("total") > 0) & (F.col("weight") > 0))
    part = F.col("weight") * (1 - F.sqrt(F.least(F.lit(1.0), ratio_null(F.col("failed"), F.col("total")))))
    return measured.groupBy(*by).agg(F.round(100 * F.sum(part) / F.sum("weight"), 4).alias("score"), F.count("*").alias("checks"))


def board_score(statuses: DataFrame, by: list[str]) -> DataFrame:
    """Share of good among measured statuses (good, warn, fail); unknown leaves both; worst status."""
    known = F.col("status").isin("good", "warn", "fail")
    rank = F.when(F.col("status") == "fail", 0).when(F.col("status") == "warn", 1).when(F.col("status") == "good", 2).otherwise(3)
    sums = statuses.groupBy(*by).agg(F.count_if(known).alias("measured"), F.count_if(F.col("status") == "good").alias("good"), F.min(rank).alias("worst"))
    return sums.select(*by, "measured", "good", ratio_null(F.col("good"), F.col("measured")).alias("score"), F.element_at(F.array(*map(F.lit, ("fail", "warn", "good", "unknown"))), F.col("worst") + 1).alias("worst"))


def priority(impact: Column, severity: Column, failed: Column, total: Column) -> Column:
    """round(20 * impact * severity * (.35 + .65 * share)), share the root of failed / total, .6 where the
    total is unknown but something failed."""
    weight = F.when(severity == "high", 1.0).when(severity == "medium", 0.62).otherwise(0.3)
    share = F.when(total > 0, F.sqrt(F.least(F.lit(1.0), ratio_null(failed, total)))).otherwise(F.when(failed > 0, 0.6).otherwise(0.0))
    return F.floor(impact * 20 * weight * (0.35 + 0.65 * share) + 0.5).cast("long")


def band(value: Column, good: float, poor: float) -> Column:
    """good up to one bound, poor beyond the other, average between; null stays unknown."""
    return F.when(value.isNull(), "unknown").when(value <= good, "good").when(value <= poor, "average").otherwise("poor")
