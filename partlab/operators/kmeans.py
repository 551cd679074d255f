"""Balanced k-means: nearest centre by distance times influence; influences and centres are
adapted until loads are balanced and centres stay."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import coord, dimension
from ..model import PartitionError, Result

#: The largest change of an influence in a round.
CHANGE = 0.05


def erosion(moved: float, diameter: float) -> float:
    """How much of an influence a centre loses that moved so far, 0 to 1."""
    return 2 / (1 + math.exp(min(-moved / diameter, 0))) - 1 if diameter else 0.0


def kmeans(points: DataFrame, weights: DataFrame, partition: DataFrame, imbalance_tol: float = 5.0, delta_threshold: float = 0.01, max_iter: int = 500, max_balance_iter: int = 20, erode: bool = False) -> Result:
    """Improves a partition; its parts 0 ... k - 1 must all occur. Fewer than two parts stay.

    Each round is one pass: every point looks up its nearest centre among k (an array in the
    expression, so nothing is joined), and loads and unweighted centroids are sums by part.
    ``imbalance_tol`` bounds the largest minus the smallest load. With ``erode`` the influence of
    a centre that moves returns towards 1, by how far it moved against the mean diameter of the
    clusters; the diagonal of a cluster's box stands for its diameter, which needs no pairs.
    """
    d = dimension(points)
    data = points.select("id", "coords").join(weights.select("id", "w"), "id").join(partition.select("id", "part"), "id").persist()
    k = (data.agg(F.max("part")).first()[0] or 0) + 1
    if k < 2:
        return Result(partition, {"rounds": 0})
    means = [F.avg(coord(i)).alias(f"c{i}") for i in range(d)]
    box = [f(coord(i)).alias(f"{n}{i}") for i in range(d) for n, f in (("l", F.min), ("h", F.max))] if erode else []
    start = {r["part"]: [r[f"c{i}"] for i in range(d)] for r in data.groupBy("part").agg(*means).collect()}
    if sorted(start) != list(range(k)):
        raise PartitionError("every part from 0 on must have an item")
    centers = [start[p] for p in range(k)]
    influence = [1.0] * k
    target = float(data.agg(F.sum("w")).first()[0]) / k
    rounds = 0

    def assigned() -> DataFrame:
        table = F.from_json(F.lit(json.dumps([{"c": c, "f": f} for c, f in zip(centers, influence)])), "array<struct<c:array<double>,f:double>>")
        far = F.transform(table, lambda t, p: F.struct((F.sqrt(F.aggregate(F.zip_with(t["c"], F.col("coords"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) * t["f"]).alias("d"), p.alias("p")))
        return data.select("id", "w", "coords", F.array_min(far)["p"].cast("int").alias("part"))

    for rounds in range(1, max_iter + 1):
        for _ in range(max(1, max_balance_iter)):
            now = {r["part"]: r for r in assigned().groupBy("part").agg(F.sum("w").alias("load"), *means, *box).collect()}
            loads = [float(now[p]["load"]) if p in now else 0.0 for p in range(k)]
            if max(loads) - min(loads) <= imbalance_tol:
                break
            for p in range(k):
                ratio = (loads[p] / target) ** (1 / d) if loads[p] > 0 else 1 - CHANGE
                influence[p] *= min(1 + CHANGE, max(1 - CHANGE, ratio))
        fresh = [[now[p][f"c{i}"] for i in range(d)] if p in now else centers[p] for p in range(k)]
        moved = max(sum((a - b) ** 2 for a, b in zip(c, f)) ** 0.5 for c, f in zip(centers, fresh))
        if erode and rounds < max_iter:
            across = sum(sum((r[f"h{i}"] - r[f"l{i}"]) ** 2 for i in range(d)) ** 0.5 for r in now.values()) / k
            influence = [f ** (1 - erosion(sum((a - b) ** 2 for a, b in zip(c, new)) ** 0.5, across)) for f, c, new in zip(influence, centers, fresh)]
        balanced = max(loads) - min(loads) <= imbalance_tol
        if moved <= delta_threshold and (balanced or rounds > 1) or rounds == max_iter:
            break  # the last assignment is the one whose loads were balanced
        centers = fresh
    return Result(assigned().select("id", "part"), {"rounds": rounds, "spread": max(loads) - min(loads)})
