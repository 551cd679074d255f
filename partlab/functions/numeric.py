"""Number helpers: overflow-safe means, integer roots, compensated scaling of weights."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

nextafter = math.nextafter


def mean_of(a: Column, b: Column) -> Column:
    """The floor of the mean of two integers, without overflow."""
    return a.bitwiseAND(b) + F.shiftright(a.bitwiseXOR(b), 1)


def root_ceil(n: int, k: int) -> int:
    """The least r with r**k >= n, in exact integer arithmetic."""
    if k <= 0:
        return n
    r = max(1, round(n ** (1 / k)))
    while r**k >= n and r > 1:
        r -= 1
    while r**k < n:
        r += 1
    return r


def work_share(total: int, workers: int) -> tuple[int, int]:
    """(items each, workers needed): equal shares with the least number of workers."""
    each = -(-total // max(workers, 1)) if total else 0
    return each, -(-total // each) if each else 0


def scale_factor(width: float, order: int) -> float:
    """The largest factor that maps [0, width] into [0, 2**order); 0 for an empty interval."""
    if width <= 0:
        return 0.0
    n = float(1 << order)
    f = n / width
    while n <= width * f:
        f = math.nextafter(f, 0.0)
    return f


def zoom_in(weights: DataFrame, most: int = 2**31 - 1, column: str = "w") -> DataFrame | None:
    """(id, w): weights spread affinely over integers from 1 on, so that their sum stays within
    ``most`` (of the heaviest criterion, if the column is an array). None where there is
    nothing to spread: no rows, weights that are all about equal, or sums that aren't finite.
    """
    many = isinstance(weights.schema[column].dataType, T.ArrayType)
    each = weights.select(F.posexplode(column).alias("criterion", "v")) if many else weights.select(F.lit(0).alias("criterion"), F.col(column).alias("v"))
    per = each.groupBy("criterion").agg(F.sum(F.col("v").cast("double")).alias("s"), F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    if not per or not all(math.isfinite(r["s"]) for r in per):
        return None
    total, n = max(r["s"] for r in per), per[0]["n"]
    lo, hi = min(r["lo"] for r in per), max(r["hi"] for r in per)
    if hi - lo < sys.float_info.min:
        return None
    lo = min(lo, 0.0)
    top = ((hi - lo) * most + total - hi * n) / (total - lo * n)
    slope, start = (top - 1) / (hi - lo), (hi - top * lo) / (hi - lo)
    put = lambda v: (v.cast("double") * F.lit(slope) + F.lit(start)).cast("bigint")
    out = weights.select("id", (F.transform(column, put) if many else put(F.col(column))).alias(column))
    ends = out.select(F.explode(column).alias(column)) if many else out
    a, b = ends.agg(F.min(column), F.max(column)).first()
    return None if a == b else out
