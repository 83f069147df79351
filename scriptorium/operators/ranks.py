"""Row numbers over many rows: ranges are numbered side by side, and each starts where the ranges before it end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task numbers; ranges of all rows at most.
ROWS, RANGES = 200_000, 512


def ranges_for(n: int) -> int:
    return max(1, min(RANGES, -(-n // ROWS)))


def quantile_range(rows: DataFrame, column: str, ranges: int) -> Column:
    """The number, from 0, of the range of about equal size that a bigint column lies in.

    The driver gets ranges - 1 quantiles, which become constants, so that a value lies in one range
    however often it is computed.
    """
    if ranges <= 1:
        return F.lit(0)
    found = rows.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = sorted(set(found))
    return F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in cuts]), lambda x: x < F.col(column))) if cuts else F.lit(0)


def numbered(rows: DataFrame, name: str, groups: list[str], part: Column, order: list) -> DataFrame:
    """rows with their number from 1 on, within groups and in order, in a column of that name.

    part numbers ranges that follow the order: all rows of a range come before those of the next. No task
    sorts more than a range of one group; the offsets are a running sum over the ranges' counts.
    """
    split = rows.withColumn("_part", part)
    sizes = split.groupBy(*groups, "_part").agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_size")).drop("_size")
    inside = split.withColumn("_row", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)))
    return inside.join(offsets, [*groups, "_part"]).withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")
