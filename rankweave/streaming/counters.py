"""Structured Streaming forms: counters and their policies on late rows, emit-once events, and monitors with state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankweave.sources import shared


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counters(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and value (cents) of each type and day; rows later than `late` behind the newest are dropped."""
    w = F.window("ts", "1 day")
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("hits"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value")).select(F.to_date("window.start").alias("day"), "event_type", "hits", "value")


def emit_once(stream: DataFrame, late: str = "40 days") -> DataFrame:
    """The first event of each user, type and day."""
    keyed = stream.withWatermark("ts", late).select("ts", "user_id", "event_type", F.to_date("ts").alias("day"))
    return keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def drained(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what there is now and returns its result, which executors write as Parquet to
    the shared folder. In complete mode each batch writes the whole result and the newest one counts; in
    update mode each batch's rows are written and the newest row of each key counts."""
    spark = stream.sparkSession
    folder = shared.folder(spark)
    newest = [f"{folder}/rows"]

    def whole(rows: DataFrame, batch: int) -> None:
        newest[0] = f"{folder}/rows-{batch}"
        rows.write.mode("overwrite").parquet(newest[0])

    def updates(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", newest[0])
    else:
        writer = writer.foreachBatch(whole if mode == "complete" else updates)
    writer.start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(newest[0])
    rows = spark.read.option("basePath", newest[0]).parquet(newest[0])
    last = F.max_by(F.struct(*(c for c in stream.columns)), "batch").alias("r")
    return rows.groupBy(*keys).agg(last).select("r.*")


_SEEN = "key long, rows long, changes long, first_id long, last_id long, most long, status string, before string, ok1 long, ok2 long, ok3 long, oks long"
_KEPT = "rows long, changes long, first_id long, last_id long, most long, status string, before string, ok1 long, ok2 long, ok3 long"
_PENDING = "seens array<long>, ids array<long>, statuses array<string>, cents array<long>"
_NOTHING = (0, 0, None, None, None, None, None, None, None, None)


def _folded(known: tuple, rows: list[tuple]) -> tuple:
    """What is known after some more measurements (seen, id, status, value) in order."""
    n, changes, first_id, last_id, most, status, before, *ok = known
    for _, id_, now, value in rows:
        n, changes = n + 1, changes + (n > 0 and now != status)
        first_id, last_id = (id_ if first_id is None else first_id), id_
        most = value if most is None else max(most, value)
        before, status = status, now
        if now != "error":
            ok = [value, *ok[:2]]
    return (n, changes, first_id, last_id, most, status, before, *ok)


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Measurements wait until the watermark has passed them, and are then taken in the order of their times, so that
    files may come in any order within the bound on lateness. What is told includes those that wait."""
    known, waiting = (tuple(state.get[:10]), list(zip(*state.get[10:], strict=True))) if state.exists else (_NOTHING, [])
    mark = state.getCurrentWatermarkMs()
    if not state.hasTimedOut:
        for news in batches:
            seen = news["seen"].astype("datetime64[us]").astype("int64")
            rows = zip(seen.tolist(), news["id"].tolist(), news["status"].tolist(), news["value"].tolist(), strict=True)
            waiting += [r for r in rows if r[0] >= mark * 1000]
    waiting.sort()
    ready = bisect_left(waiting, (mark * 1000,))
    known, waiting = _folded(known, waiting[:ready]), waiting[ready:]
    state.update((*known, *(list(c) for c in zip(*waiting, strict=True))) if waiting else (*known, [], [], [], []))
    if waiting:
        state.setTimeoutTimestamp(max(mark + 1, waiting[0][0] // 1000 + 1))
    rows, changes, first_id, last_id, most, status, before, *ok = _folded(known, waiting)
    if not rows:
        return
    found = {"key": key[0], "rows": rows, "changes": changes, "first_id": first_id, "last_id": last_id, "most": most, "status": status, "before": before, "ok1": ok[0], "ok2": ok[1], "ok3": ok[2], "oks": sum(x is not None for x in ok)}
    yield pd.DataFrame({k: pd.array([v], dtype="string" if k in ("status", "before") else "Int64") for k, v in found.items()})


def monitored(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """What is known of each key of measurements (key, seen, id, status, value): counts, the last two states and the
    last three values that are no errors, in the order of times. A key's state holds its measurements of the
    time that the watermark leaves open; those that come later than `late` are dropped."""
    timed = stream.withWatermark("seen", late)
    return timed.groupBy("key").applyInPandasWithState(_follow, _SEEN, f"{_KEPT}, {_PENDING}", "update", GroupStateTimeout.EventTimeTimeout)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seen, id, status and value (cents) of the events, as a stream."""
    events = events_stream(spark, sf_dir)
    return events.select(F.col("user_id").alias("key"), F.col("ts").alias("seen"), F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.round(F.col("value") * 100).cast("long").alias("value"))


def recounted_days(stream: DataFrame, lag: int = 2) -> DataFrame:
    """Events and value (cents) of each type and day, however late rows come: each batch adds its rows, and the
    days that it touches are counted anew, from their own partitions, and written over. Days newer than `lag` before the newest one are
    held back, as they may still grow. A batch that is run again writes the same."""
    spark = stream.sparkSession
    folder = shared.folder(spark)
    rows = stream.select(F.to_date("ts").alias("day"), "event_type", F.round(F.col("value") * 100).cast("long").alias("value"))

    def recount(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("batch", F.lit(number))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{folder}/raw")
        touched = [r["day"] for r in batch.select("day").distinct().collect()]  # the days of one batch
        every = spark.read.schema("event_type string, value long, day date, batch int").parquet(f"{folder}/raw").where(F.col("day").isin(touched))
        counted = every.groupBy("day", "event_type").agg(F.count("*").alias("hits"), F.sum("value").alias("value"))
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/days")

    rows.writeStream.foreachBatch(recount).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    days = spark.read.schema("event_type string, hits long, value long, day date").parquet(f"{folder}/days")
    newest = days.agg(F.max("day").alias("newest"))
    return days.join(F.broadcast(newest), F.col("day") <= F.date_sub("newest", lag)).select("day", "event_type", "hits", "value")
