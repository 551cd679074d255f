"""Cartesian grids: implicit adjacency and recursive bisection along rows and columns.

A grid's items are numbered in row-major order with axis 0 the fastest: index = x + nx * y
(+ nx * ny * z).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAND = 0.01


def position(index: Column, sizes: list[int]) -> list[Column]:
    out, stride = [], 1
    for n in sizes:
        out.append(F.floor(index / stride).cast("bigint") % n)
        stride *= n
    return out


def index_of(pos: list[Column], sizes: list[int]) -> Column:
    out, stride = F.lit(0).cast("bigint"), 1
    for p, n in zip(pos, sizes):
        out = out + p * stride
        stride *= n
    return out


def cells(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """(id, x0, x1, ...)."""
    total = 1
    for n in sizes:
        total *= n
    base = spark.range(total)
    return base.select("id", *[p.alias(f"x{i}") for i, p in enumerate(position(F.col("id"), sizes))])


def edges(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """(src, dst, w = 1), both directions, made from row numbers alone: no join, no shuffle."""
    c = cells(spark, sizes)
    near, stride = [], 1
    for i, n in enumerate(sizes):
        x = F.col(f"x{i}")
        near += [F.when(x > 0, F.col("id") - stride), F.when(x < n - 1, F.col("id") + stride)]
        stride *= n
    return c.select(F.col("id").alias("src"), F.explode(F.filter(F.array(*near), lambda v: v.isNotNull())).alias("dst"), F.lit(1).cast("bigint").alias("w"))


def median_cut(marginals: list, total) -> tuple[int, float]:
    """(position, weight left of it): the first position whose prefix lies within one percent of
    half the total, else the last whose prefix is below that band."""
    kind = type(total)
    low, high = kind(total / 2 * (1 - BAND)), kind(total / 2 * (1 + BAND))
    prefix, last = kind(0), (0, kind(0))
    for p, w in enumerate(marginals):
        if low <= prefix <= high:
            return p, prefix
        if prefix > high:
            break
        last = (p, prefix)
        prefix += w
    return last


def rcb(weights: DataFrame, sizes: list[int], iterations: int) -> DataFrame:
    """(id, part) for (id, w) on a grid of two or three axes; the first cut is along axis 1.

    A level takes one aggregation: weights by (part of the level, position on its axis), of
    which there are as many as positions on the axes, come to the driver, which finds the cuts.
    """
    d = len(sizes)
    data = weights.select("id", "w", *[p.alias(f"x{i}") for i, p in enumerate(position(F.col("id"), sizes))])
    seg: Column = F.lit(0).cast("bigint")
    whole = {0: ([0] * d, list(sizes))}
    integral = data.schema["w"].dataType.simpleString() in ("bigint", "int")
    for level in range(iterations):
        axis = (1 + level) % d
        sums = data.groupBy(seg.alias("seg"), F.col(f"x{axis}").alias("x")).agg(F.sum("w").alias("w")).collect()
        own: dict[int, dict[int, float]] = {}
        for r in sums:
            own.setdefault(r["seg"], {})[r["x"]] = r["w"]
        cuts, nxt = {}, {}
        for s, (start, size) in whole.items():
            zero = 0 if integral else 0.0
            row = [own.get(s, {}).get(start[axis] + i, zero) for i in range(size[axis])]
            cut = start[axis] + (median_cut(row, sum(row, zero))[0] if row else 0)
            cuts[s] = cut
            left, right = list(size), list(size)
            left[axis], right[axis] = cut - start[axis], size[axis] - (cut - start[axis])
            at = list(start)
            at[axis] = cut
            nxt |= {2 * s: (start, left), 2 * s + 1: (at, right)}
        table = F.from_json(F.lit(json.dumps([cuts[s] for s in sorted(cuts)])), "array<bigint>")
        data = data.withColumn("__seg", seg).withColumn("__cut", F.element_at(table, (F.col("__seg") + 1).cast("int")))
        data = data.select("id", "w", *[f"x{i}" for i in range(d)], (F.col("__seg") * 2 + (F.col(f"x{axis}") >= F.col("__cut")).cast("bigint")).alias("seg"))
        seg = F.col("seg")
        whole = nxt
    return data.select("id", seg.cast("int").alias("part"))
