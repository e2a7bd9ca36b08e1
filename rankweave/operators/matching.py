"""Joins by set overlap, intervals, ranges and containment, snapshot differences and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.safe import ratio_null
from rankweave.operators import cosines


def shared_members(members: DataFrame, entity: str, member: str, percent: int) -> DataFrame:
    """a, b, shared, jaccard of all entities whose sets of members reach a Jaccard of `percent`. At that Jaccard
    the sets' cosine is 2 * percent / (100 + percent) or more, so they meet as vectors of ones, in blocks (see
    operators.cosines); a null member counts in a set's size only."""
    kind = members.schema[member].dataType
    rows = members.select(F.col(entity).alias("id"), cosines.hashed(F.col(member), kind).alias("m"), F.col(member).isNull().alias("none"))
    known = F.collect_set(F.when(~F.col("none"), F.col("m")))
    sets = rows.groupBy("id").agg(known.alias("terms"), F.max("none").cast("double").alias("own"))
    found = cosines.products(sets.select("id", "terms", F.lit(None).cast("array<double>").alias("counts"), "own"), 2 * percent / (100 + percent))
    shared, na, nb = (F.col(c).cast("long") for c in ("product", "sa", "sb"))
    jaccard = ratio_null(shared, na + nb - shared)
    return found.where(shared * (100 + percent) >= (na + nb) * percent).select("a", "b", shared.alias("shared"), jaccard.alias("jaccard"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that came, went or stayed."""
    a, b = before.select(key).distinct().withColumn("was", F.lit(True)), after.select(key).distinct().withColumn("is", F.lit(True))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def in_ranges(points: DataFrame, ranges: DataFrame, point: str, step: int) -> DataFrame:
    """Points (with all columns) and the ranges (lo, hi, name) that hold them. Ranges are cut at multiples
    of `step`, so that points and ranges meet in an equi-join on the piece."""
    pieces = ranges.select("name", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))).alias("piece"))
    placed = points.withColumn("piece", F.floor(F.col(point) / step))
    return placed.join(pieces, "piece").where((F.col("lo") <= F.col(point)) & (F.col(point) <= F.col("hi"))).drop("piece", "lo", "hi")


#: Widths of the pieces by which texts meet that contain each other.
_WIDTHS = [0, 1, 2, 4, 8, 16, 32, 64]


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """needle, hay of all different texts (column t, none twice) of which the first occurs in the second, within
    words as well. A needle has one width, the largest of `_WIDTHS` that it holds, and looks for hays by its piece
    of that width that the fewest of them have; the whole needle is compared after that."""
    pieces = "explode(array_distinct(transform(sequence(1, length(t) - w + 1), i -> xxhash64(w, substring(t, i, w))))) AS piece"
    widest = F.array_max(F.filter(F.array(*map(F.lit, _WIDTHS)), lambda w: w <= F.length("t")))
    sized = needles.where("t is not null").select("t", widest.alias("w"))
    held = hays.join(F.broadcast(sized.select("w").distinct()), F.expr("w <= length(t)")).selectExpr("t AS hay", pieces)
    often = held.groupBy("piece").agg(F.count("*").alias("df"))
    keys = sized.selectExpr("t AS needle", pieces).join(often, "piece").groupBy("needle").agg(F.min(F.struct("df", "piece"))["piece"].alias("piece"))
    return keys.join(held, "piece").where(F.contains("hay", "needle") & (F.col("hay") != F.col("needle"))).select("needle", "hay")


def first_of(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key by a total order; letter case of the key doesn't matter."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lower(F.col(key))).orderBy(*order)))
    return placed.where("place = 1").drop("place")


def shingle_overlap(docs: DataFrame, width: int = 5, least_words: int = 8) -> DataFrame:
    """doc_id and the number of distinct word shingles; none below `least_words` words."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")

    def count(w):
        shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, F.lit(width)), " ")))
        return F.when(F.size(w) >= least_words, F.size(shingles)).otherwise(0)

    # Bound once by the lambda: inlined, the words would be cut anew for each shingle.
    return docs.select("doc_id", F.get(F.transform(F.array(words), count), F.lit(0)).cast("long").alias("shingles"))
