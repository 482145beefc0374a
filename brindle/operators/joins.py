"""Joins that Spark has no operator for: as-of, and range joins on bucketed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, name: str) -> DataFrame:
    """left's columns and the latest value of right with the same keys at or before ``on`` (null if none).

    One shuffle of the union of both sides and one running last-value window; never a pair of rows.
    Of equal moments right's rows come first, and of those the greatest value counts.
    """
    rows = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    marks = right.select(*[F.col(c) if c in by or c == on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), F.col(value).alias("_v"))
    order = Window.partitionBy(*by).orderBy(on, "_side", F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionByName(marks).withColumn(name, F.last("_v", ignorenulls=True).over(order)).filter("_side = 1").drop("_side", "_v")


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """All columns of both, where low <= point < high, by equal buckets of ``width`` instead of a cross join.

    A range is repeated for each bucket that it touches, so width should be near the usual length of a range.
    """
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.filter(F.col(low) < F.col(high)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_b").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")
