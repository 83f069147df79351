"""What iteration and repeated reading need of a session: written tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine a temporary folder if it is unset, elsewhere an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    if not held.isDefined():
        context.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder, as a step of an iteration."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes with release() or when the driver ends."""
    root = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS[root] = spark
        atexit.register(_drop, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df written as Parquet to the shared folder and read again, for what several plans read.

    It goes with release() or when the driver ends. options are the writer's.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(compression="lz4_raw", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes all stored tables; results that read them must have been written or collected."""
    for root in list(_ROOTS):
        _drop(root)


def _drop(root: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        context = _ROOTS.pop(root).sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
