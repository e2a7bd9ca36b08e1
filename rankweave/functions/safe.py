"""Ratios and changes that never divide by zero. The four change measures differ in what a zero prior means,
and must not be mixed up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_null(top: Column, bottom: Column) -> Column:
    """top / bottom; null without a denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio0(top: Column, bottom: Column) -> Column:
    """top / bottom; 0 without a denominator."""
    return F.coalesce(ratio_null(top, bottom), F.lit(0.0))


def pct_change(recent: Column, prior: Column) -> Column:
    """Change in percent of the prior value; from zero it is infinite, or 0 if nothing came."""
    grown = F.when(recent > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(prior == 0, grown).otherwise(ratio_null((recent - prior) * 100, prior))


def drop_pct(recent: Column, prior: Column) -> Column:
    """Fall in percent of the prior value, at least 0; 0 where there was nothing to lose."""
    return F.when(prior <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), ratio_null((prior - recent) * 100, prior)))


def delta_pct(recent: Column, prior: Column) -> Column:
    """Change in percent; unknown (null) from zero."""
    return F.when(prior > 0, ratio_null((recent - prior) * 100, prior))


def lead_pct(recent: Column, prior: Column) -> Column:
    """Change in percent; from zero it counts as 100, or 0 if nothing came."""
    return F.when(prior > 0, ratio_null((recent - prior) * 100, prior)).otherwise(F.when(recent > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
