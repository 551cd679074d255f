"""Weight generation: constant, linear and spike distributions, and random sampling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import coord


def constant(points: DataFrame, value: float) -> DataFrame:
    return points.select("id", F.lit(float(value)).alias("w"))


def linear(points: DataFrame, axis: int, start: float, end: float) -> DataFrame:
    """Affine along an axis: ``start`` at the lowest coordinate, ``end`` at the highest, never
    beyond; ``start`` everywhere if the axis is flat."""
    lo, hi = points.agg(F.min(coord(axis)), F.max(coord(axis))).first()
    if lo is None or lo == hi:
        return constant(points, start)
    slope = (end - start) / (hi - lo)
    while abs(slope * (hi - lo)) > abs(end - start):
        slope = math.nextafter(slope, 0.0)
    return points.select("id", (F.lit(slope) * (coord(axis) - F.lit(lo)) + F.lit(float(start))).alias("w"))


def spike(points: DataFrame, spikes: list[tuple[float, list[float]]]) -> DataFrame:
    """Sum over (height, position) of exp(ln height - distance); heights over 0."""
    total: Column = F.lit(0.0)
    for height, position in spikes:
        if height <= 0:
            raise ValueError("a spike's height must be over 0")
        squares: Column = F.lit(0.0)
        for i, x in enumerate(position):
            squares = squares + (coord(i) - F.lit(float(x))) * (coord(i) - F.lit(float(x)))
        total = total + F.exp(F.lit(math.log(height)) - F.sqrt(squares))
    return points.select("id", total.alias("w"))


def combine(criteria: list[DataFrame], integers: bool = False) -> DataFrame:
    """(id, w ARRAY) of several criteria; with ``integers`` values are truncated."""
    out = criteria[0].select("id", F.col("w").alias("w0"))
    for i, c in enumerate(criteria[1:], 1):
        out = out.join(c.select("id", F.col("w").alias(f"w{i}")), "id")
    kind = "bigint" if integers else "double"
    return out.select("id", F.array(*[F.col(f"w{i}").cast(kind) for i in range(len(criteria))]).alias("w"))


def parse(spec: str, points: DataFrame) -> DataFrame:
    """A distribution from text: ``constant,v``, ``linear,axis,from,to``,
    ``spike,height,x,y[,height,x,y...]``."""
    name, *args = spec.split(",")
    if name == "constant":
        return constant(points, float(args[0]))
    if name == "linear":
        axis = {"x": 0, "y": 1, "z": 2}.get(args[0].lower())
        return linear(points, int(args[0]) if axis is None else axis, float(args[1]), float(args[2]))
    if name == "spike":
        d = points.select(F.max(F.size("coords"))).first()[0]
        numbers = [float(a) for a in args]
        if len(numbers) % (d + 1):
            raise ValueError(f"a spike has a height and {d} coordinates")
        return spike(points, [(numbers[i], numbers[i + 1 : i + 1 + d]) for i in range(0, len(numbers), d + 1)])
    raise ValueError(f"unknown distribution {name!r}")


def sample(spark: SparkSession, n: int, iterations: int, distribution: str, seed: int) -> DataFrame:
    """(iteration, id, w): random weights, the same for the same seed.

    ``uniform,low,high``, ``normal,mean,deviation``, ``exp,lambda``, ``pareto,scale,shape``,
    ``beta,alpha,beta,scale``. Uniform numbers come from a hash of (seed, iteration, id), so a
    retried task draws the same; other distributions invert their distribution function.
    """
    name, *args = distribution.split(",")
    a = [float(x) for x in args]
    base = spark.range(n * iterations).select((F.col("id") / n).cast("bigint").alias("iteration"), (F.col("id") % n).alias("id"))
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "iteration", "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    if name == "uniform":
        w = a[0] + u(0) * (a[1] - a[0])
    elif name == "normal":
        w = a[0] + a[1] * F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * math.pi * u(1))
    elif name == "exp":
        w = -F.ln(u(0)) / a[0]
    elif name == "pareto":
        w = a[0] / F.pow(u(0), F.lit(1 / a[1]))
    elif name == "beta":
        w = _beta(u(0), u(1), F.xxhash64(F.lit(seed), "iteration", "id"), a[0], a[1]) * a[2]
    else:
        raise ValueError(f"unknown distribution {name!r}")
    return base.withColumn("w", w)


def _beta(u: Column, v: Column, key: Column, alpha: float, beta: float) -> Column:
    """Beta numbers by numpy, seeded for each row."""
    import numpy as np

    @F.pandas_udf("double")
    def run(k: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(int(x) & (2**63 - 1)).beta(alpha, beta) for x in k])

    del u, v
    return run(key)
