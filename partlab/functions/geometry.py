"""Boxes, centroids, inertia and rotations of point sets.

Sums over points are DataFrame aggregations; only D x D matrices come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 10 * np.finfo(float).eps


def coord(i: int, column: str = "coords") -> Column:
    return F.col(column)[i]


def dimension(points: DataFrame) -> int:
    """D, the same for all points; 0 without points."""
    lo, hi = points.agg(F.min(F.size("coords")), F.max(F.size("coords"))).first()
    if lo != hi:
        raise ValueError("all points must have the same dimension")
    return lo or 0


def bounding_box(points: DataFrame, d: int) -> DataFrame:
    """One row (p_min, p_max); both null without points."""
    corner = lambda f: F.when(F.count(F.lit(1)) > 0, F.array(*[f(coord(i)) for i in range(d)]))
    return points.agg(corner(F.min).alias("p_min"), corner(F.max).alias("p_max"))


def center(p_min: Column, p_max: Column) -> Column:
    return F.zip_with(p_min, p_max, lambda a, b: (a + b) / 2)


def contains(p_min: Column, p_max: Column, p: Column) -> Column:
    """Whether p is in the box, with a tolerance of ten ulps of 1."""
    low = F.zip_with(p, p_min, lambda x, a: x >= a - EPS)
    high = F.zip_with(p, p_max, lambda x, b: x <= b + EPS)
    return F.forall(F.concat(low, high), lambda ok: ok)


def region(p_min: Column, p_max: Column, p: Column) -> Column:
    """Bit i is set iff coordinate i is over the centre."""
    over = F.zip_with(p, center(p_min, p_max), lambda x, c: x > c)
    bits = F.transform(over, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b)


def sub_box(p_min: Column, p_max: Column, octant: Column) -> Column:
    """STRUCT<p_min, p_max> of the part of a box that a region number names."""
    mid = center(p_min, p_max)
    on = lambda i: F.call_function("shiftright", octant, i).bitwiseAND(F.lit(1)) == 1
    low = F.transform(F.arrays_zip(p_min.alias("a"), mid.alias("m")), lambda x, i: F.when(on(i), x["m"]).otherwise(x["a"]))
    high = F.transform(F.arrays_zip(p_max.alias("a"), mid.alias("m")), lambda x, i: F.when(on(i), x["a"]).otherwise(x["m"]))
    return F.struct(low.alias("p_min"), high.alias("p_max"))


def distance_to_box(p_min: Column, p_max: Column, p: Column) -> Column:
    """Distance of a point outside to the box; of a point inside to its nearest face."""
    out = F.transform(F.arrays_zip(p.alias("x"), p_min.alias("a"), p_max.alias("b")), lambda t: F.greatest(t["a"] - t["x"], t["x"] - t["b"], F.lit(0.0)))
    inner = F.transform(F.arrays_zip(p.alias("x"), p_min.alias("a"), p_max.alias("b")), lambda t: F.least(t["x"] - t["a"], t["b"] - t["x"]))
    outside = F.sqrt(F.aggregate(out, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(outside > 0, outside).otherwise(F.array_min(inner))


def centroid(points: DataFrame, d: int) -> DataFrame:
    """One row: c0, c1, ..."""
    return points.agg(*[F.avg(coord(i)).alias(f"c{i}") for i in range(d)])


def inertia_matrix(points: DataFrame, d: int) -> np.ndarray:
    """Sum of (p - c)(p - c)^T over all points, unweighted, in two passes."""
    c = [x or 0.0 for x in centroid(points, d).first()]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = points.agg(*[F.sum((coord(i) - F.lit(c[i])) * (coord(j) - F.lit(c[j]))) for i, j in pairs]).first()
    out = np.zeros((d, d))
    for (i, j), v in zip(pairs, sums):
        out[i, j] = out[j, i] = v or 0.0
    return out


def inertia_vector(matrix: np.ndarray) -> np.ndarray:
    """The dominant eigenvector; its first component that isn't zero is positive."""
    values, vectors = np.linalg.eigh(matrix)
    v = vectors[:, int(np.argmax(values))]
    lead = next((x for x in v if abs(x) > 1e-12), 1.0)
    return v if lead > 0 else -v


def householder(v: np.ndarray) -> np.ndarray:
    """The reflection that takes v's direction to the first axis (identity if it is there)."""
    e0 = np.zeros(len(v))
    e0[0] = np.linalg.norm(v)
    w = v - e0
    n = w @ w
    return np.eye(len(v)) if n < 1e-24 else np.eye(len(v)) - 2 * np.outer(w, w) / n


def rotated(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(id, coords) with the matrix applied to every point, as column expressions."""
    row = lambda r: reduce(lambda a, b: a + b, [coord(j) * F.lit(float(x)) for j, x in enumerate(r)])
    return points.withColumn("coords", F.array(*[row(r) for r in matrix]))


@dataclass
class OrientedBox:
    """A box whose first axis is the points' principal axis."""

    rotation: np.ndarray
    p_min: list[float]
    p_max: list[float]

    @staticmethod
    def of(points: DataFrame, d: int) -> OrientedBox | None:
        matrix = householder(inertia_vector(inertia_matrix(points, d)))
        row = bounding_box(rotated(points, matrix), d).first()
        return None if row["p_min"] is None else OrientedBox(matrix, row["p_min"], row["p_max"])

    def aligned(self, points: DataFrame) -> DataFrame:
        return rotated(points, self.rotation)

    @property
    def center(self) -> np.ndarray:
        return np.linalg.inv(self.rotation) @ ((np.array(self.p_min) + np.array(self.p_max)) / 2)

    def contains(self, p: list[float]) -> bool:
        q = self.rotation @ np.array(p, float)
        return bool(np.all(q >= np.array(self.p_min) - EPS) and np.all(q <= np.array(self.p_max) + EPS))
