"""Alert rules as data: a rule names the level it looks at, its window and the condition on a comparison's
columns. Every rule runs as one filter on one comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.performance import compare


@dataclass(frozen=True)
class Rule:
    """level: site or entity; when: a condition over the columns of compare()."""

    key: str
    level: str
    days: int
    when: str
    severity: str

    @property
    def keys(self) -> list[str]:
        return ["brand"] if self.level == "site" else ["brand", "entity"]


#: Thresholds are the catalogue's defaults, scaled to what the views hold where they would never be met.
RULES = {
    "ALR1": Rule("clicks_drop", "site", 7, "pc >= 20 AND click_drop >= 5", "high"),
    "ALR2": Rule("impressions_drop", "site", 7, "pi >= 500 AND imp_drop >= 5", "high"),
    "ALR3": Rule("ctr_drop", "site", 7, "pi >= 1000 AND pctr - rctr >= 0.00001", "medium"),
    "ALR4": Rule("position_worsen", "site", 7, "pi >= 500 AND rpos - ppos >= 1", "medium"),
    "ALR5": Rule("clicks_floor", "site", 7, "rdays > 0 AND rc < 500", "high"),
    "ALR6": Rule("clicks_spike", "site", 7, "pi >= 200 AND pc > 0 AND click_change >= 5", "low"),
    "ALR8": Rule("rank_drop", "entity", 7, "pi >= 100 AND rpos - ppos >= 5", "high"),
    "ALR9": Rule("lost_top10", "entity", 7, "ppos <= 25 AND (rpos IS NULL OR rpos > 25)", "high"),
    "ALR10": Rule("lost_top3", "entity", 7, "ppos <= 10 AND (rpos IS NULL OR rpos > 10)", "high"),
    "ALR11": Rule("entered_top10", "entity", 7, "rpos <= 25 AND (ppos IS NULL OR ppos > 25)", "info"),
    "ALR13": Rule("striking_distance", "entity", 14, "ri >= 100 AND rpos >= 4 AND rpos <= 20", "low"),
    "ALR15": Rule("page_clicks_drop", "entity", 7, "pc >= 3 AND click_drop >= 30", "high"),
    "ALR16": Rule("page_impressions_drop", "entity", 7, "pi >= 1000 AND imp_drop >= 40", "medium"),
    "ALR17": Rule("page_lost", "entity", 7, "pc >= 2 AND rc = 0", "critical"),
    "ALR18": Rule("page_rising", "entity", 7, "pc > 0 AND click_change >= 50", "info"),
    "ALR19": Rule("page_ctr_drop", "entity", 7, "pi >= 1000 AND ri >= 500 AND pctr - rctr >= 0.0001", "medium"),
    "ALR23": Rule("collapse", "site", 7, "pi >= 200 AND imp_drop >= 8", "critical"),
}


def evaluate(daily: DataFrame, rule: Rule) -> DataFrame:
    """The keys for which a rule fires, with both windows' figures."""
    return compare(daily, rule.keys, rule.days).where(F.expr(rule.when)).select(*rule.keys, "rc", "pc", "ri", "pi", F.lit(rule.severity).alias("severity"))
