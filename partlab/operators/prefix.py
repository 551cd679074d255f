"""Prefix sums and ranks over tables of any size.

A window without partitions puts all rows into one task. Here rows are dealt into ranges of
the sort key first, totals of the ranges (a small table) give each range's offset, and the
running sum is taken inside a range. Small tables are one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared

#: Rows of a range, about; ranges at most.
RANGE_ROWS, MOST_RANGES = 500_000, 4_000


def range_of(df: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, int]:
    """``df`` with ``__range``, which grows with the (not null) keys in their order. Spark's own
    range partitioning finds a row's range; the table is written with it, since several passes
    read it, which would compute ``df`` and search the cuts again."""
    ranges = min(MOST_RANGES, rows // RANGE_ROWS + 1)
    if ranges == 1:
        return df.withColumn("__range", F.lit(0)), 1
    dealt = df.repartitionByRange(ranges, *keys).withColumn("__range", F.spark_partition_id())
    return shared.checkpoint(dealt), ranges


def prefix_sum(df: DataFrame, weight: Column, order: list[str], by: list[str] | None = None, out: str = "cum", rows: int | None = None) -> DataFrame:
    """``df`` with ``out``, the sum of ``weight`` over the rows up to this one, in the order of
    ``order`` (which must tell rows apart) within each group of ``by``."""
    by = by or []
    df = df.withColumn("__w", weight)
    rows = df.count() if rows is None else rows
    ranged, ranges = range_of(df, [*by, *order], rows)
    window = W.partitionBy("__range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    if ranges == 1:
        window = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return ranged.withColumn(out, F.sum("__w").over(window)).drop("__w", "__range")
    # as many rows as ranges and groups
    totals = ranged.groupBy(*by, "__range").agg(F.sum("__w").alias("__t"))
    before = F.sum("__t").over((W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__t")
    joined = ranged.join(offsets, [*by, "__range"])
    return joined.withColumn(out, F.sum("__w").over(window) + F.col("__before")).drop("__w", "__range", "__before")


def rank(df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "rank", rows: int | None = None) -> DataFrame:
    """``df`` with the row's 0-based place in the order."""
    ranked = prefix_sum(df, F.lit(1).cast("bigint"), order, by, out, rows)
    return ranked.withColumn(out, F.col(out) - 1)


def tile(place: Column, rows: Column, parts: int) -> Column:
    """Part of a 0-based place when rows are cut into ``parts`` runs whose lengths differ by one
    at most, the longer ones first (the rule of ntile)."""
    each, longer = F.floor(rows / parts), rows % parts
    head = longer * (each + 1)
    return F.when(place < head, F.floor(place / (each + 1))).otherwise(longer + F.floor((place - head) / F.greatest(each, F.lit(1)))).cast("int")
