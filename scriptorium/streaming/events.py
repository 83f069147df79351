"""Streams: daily counts with a watermark, dedupe by id, schedules, keyed upserts of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the event files in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, event_type, n, total) per day; on a stream days close once the watermark passes them."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, length: str = "1 day", step: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per window, a window every step; late rows are dropped on a stream."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): a user's rows no further apart than the gap; end is the last row's time plus the gap."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    counted = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_records(records: DataFrame, key: str = "id", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once; on a stream with a time, keys are remembered until the watermark passes them."""
    if records.isStreaming and time:
        return records.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return records.dropDuplicates([key])


def cron_matches(schedule: str, ts: Column) -> Column:
    """Whether a five-field schedule is due in a timestamp's minute; fields are *, numbers and lists.

    Anything else never matches.
    """
    fields = schedule.split()
    parts = [F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1]
    if len(fields) != 5:
        return F.lit(False)
    out = F.lit(True)
    for field, part in zip(fields, parts, strict=True):
        if field == "*":
            continue
        numbers = [int(x) for x in field.split(",") if x.strip().isdigit()]
        out = out & (part.isin(numbers) if numbers else F.lit(False))
    return out


def upsert_batches(stream: DataFrame, keys: list[str], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a stream to its present end; write gets each batch with its keys distinct, so replays change nothing."""
    return stream.writeStream.foreachBatch(lambda df, n: write(df.dropDuplicates(keys), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
