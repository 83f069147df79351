"""Streams over what arrives in steps: late rows, dedupe by two keys, and a keyed table merged from batches.

A table is replayed as it arrived: each step's rows are appended to a folder, and a stream with one checkpoint
runs to the folder's present end. What a step leaves behind is in the checkpoint and in written tables in the
shared folder, so a run that is lost goes on from its last finished batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import slug
from ..operators.records import dedupe
from ..session import scratch

#: Steps of a replay; each starts the stream anew.
MAX_STEPS = 1000


def replayed(rows: DataFrame, step: str, start: Callable[[DataFrame, str], StreamingQuery], again: int | None = None) -> None:
    """Runs a stream over rows in the order of their integer step; start gets the stream and a checkpoint folder.

    again: a step whose rows arrive a second time at the end, as from a source that sends at least once.
    """
    spark = rows.sparkSession
    staged, inbox, checkpoint = (scratch(spark, x) for x in ("staged", "inbox", "checkpoint"))
    rows.write.partitionBy(step).parquet(staged)
    found = spark.read.parquet(staged)
    steps = [r[0] for r in found.select(step).distinct().orderBy(step).limit(MAX_STEPS + 1).collect()]
    if len(steps) > MAX_STEPS:
        raise ValueError(f"over {MAX_STEPS} steps; use longer ones")
    body = rows.drop(step)
    for s in [*steps, *([again] if again is not None else [])]:
        found.where(F.col(step) == s).select(body.columns).write.mode("append").parquet(inbox)  # reads one partition
        start(spark.readStream.schema(body.schema).parquet(inbox), checkpoint).awaitTermination()


def closed_windows(counts: Callable[[DataFrame], DataFrame], rows: DataFrame, step: str) -> DataFrame:
    """What a windowed aggregation with a watermark has closed when all steps have arrived.

    Append mode: a window leaves once the watermark passes its end and never changes. A row whose window has
    ended at or before the watermark of the steps before its own is late and dropped; windows that are still
    open at the end don't appear.
    """
    spark = rows.sparkSession
    out = scratch(spark, "closed")
    shape = counts(rows.drop(step)).schema

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return counts(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    replayed(rows, step, start)
    return spark.read.schema(shape).parquet(out)


class Numbered:
    """A folder with a table for each finished batch. Writing a batch again replaces it, so replays change nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files, self._at = at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def write(self, df: DataFrame, number: int, name: str = "batch") -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}={number}")

    def numbers(self, name: str = "batch") -> list[int]:
        """The finished ones, in order; what a lost run has begun has no mark of success."""
        if not self._files.exists(self._at):
            return []
        paths = [s.getPath() for s in self._files.listStatus(self._at)]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().partition("=")[2]) for p in paths if p.getName().startswith(f"{name}=") and self._files.exists(mark(p, "_SUCCESS")))

    def read(self, numbers: list[int], name: str = "batch") -> DataFrame | None:
        """The rows of these batches with their number in column batch_no."""
        out = None
        for n in numbers:
            one = self.spark.read.parquet(f"{self.path}/{name}={n}").withColumn("batch_no", F.lit(n).cast("bigint"))
            out = one if out is None else out.unionByName(one)
        return out

    def drop(self, number: int, name: str = "batch") -> None:
        self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}={number}"), True)


class KeptRecords(Numbered):
    """Ordered dedupe over micro-batches: a record falls if a kept one has its id or its title's slug.

    Whether a key counts as seen hangs on whether its record was kept, which the other key decides, so a state
    store under one key can't tell. Here the kept records of the batches before are the state: of their keys
    only those that the batch has are looked up (a semi-join that broadcasts the batch if it is small), and
    what is left is settled by dedupe() in rounds of joins. The kept set is that of dedupe() over all batches
    joined in order.
    """

    def admit(self, batch: DataFrame, number: int) -> None:
        """batch(pos, id, title, ...): keeps its new records, in order of pos, under a number."""
        fresh = batch.withColumn("_slug", slug("title"))
        before = self.read([n for n in self.numbers() if n < number])
        if before is not None:
            for key in ("id", "_slug"):
                asked = fresh.where(F.col(key) != "").select(key).distinct()
                fresh = fresh.join(before.select(key).join(asked, key, "left_semi").distinct(), key, "left_anti")
        self.write(dedupe(fresh.select(batch.columns)).withColumn("_slug", slug("title")), number)

    def records(self) -> DataFrame:
        return self.read(self.numbers()).drop("_slug", "batch_no")


class MergedTable(Numbered):
    """A keyed table out of batches of changes: the change of the latest batch counts, in it the last by order.

    A batch is written as it is, one row a key, so that merging costs what the batch has; compact() folds
    finished batches into a base from time to time. A batch that is not newer than the base was merged
    before and is left alone.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        super().__init__(spark, path)
        self.keys, self.order = keys, order

    def _last(self, rows: DataFrame, order: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        latest = rows.groupBy(self.keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        return latest.select(*self.keys, "_row.*")

    def merge(self, changes: DataFrame, number: int) -> None:
        if number > self._base():
            self.write(self._last(changes, self.order), number)

    def _base(self) -> int:
        return max(self.numbers("base"), default=-1)

    def rows(self) -> DataFrame:
        """The table as of the last finished batch."""
        base = self._base()
        parts = [x for x in (self.read([base], "base") if base >= 0 else None, self.read([n for n in self.numbers() if n > base])) if x is not None]
        if not parts:
            raise ValueError("nothing was merged yet")
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self._last(every, ["batch_no"]).drop("batch_no")

    def compact(self) -> None:
        """Folds all finished batches into a new base; what it replaces goes once the base is whole."""
        old, done = self._base(), [n for n in self.numbers() if n > self._base()]
        if done:
            self.write(self.rows(), done[-1], "base")
            for n in done:
                self.drop(n)
            if old >= 0:
                self.drop(old, "base")


def merged(rows: DataFrame, step: str, table: MergedTable, again: int | None = None) -> DataFrame:
    """The table after all steps of a stream of changes have arrived."""

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    replayed(rows, step, start, again)
    return table.rows()


def deduped(rows: DataFrame, step: str, kept: KeptRecords, again: int | None = None) -> DataFrame:
    """The records(pos, id, title, ...) that a stream keeps when all steps have arrived."""

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(kept.admit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    replayed(rows, step, start, again)
    return kept.records()
