"""Reports: everything about one partition in a row, and quality matrices over chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..model import NotFound, Problem
from ..operators import metrics, weights
from . import registry


def part_info(partition: DataFrame, w: DataFrame, edges: DataFrame | None, part_count: int | None = None, mode: str = "linear") -> DataFrame:
    """One row: parts, empty parts, load statistics of the first criterion, edge and lambda cut.
    One lazy plan; without edges the cuts are null."""
    k = metrics.part_count(partition) if part_count is None else part_count
    many = w if w.schema["w"].dataType.simpleString().startswith("array") else w.select("id", F.array("w").alias("w"))
    row = metrics.weight_stats(partition, many, k).where("criterion = 0").drop("criterion")
    row = row.join(metrics.empty_parts(partition, k), how="cross").withColumn("parts", F.lit(k))
    if edges is None:
        return row.withColumns({"edge_cut": F.lit(None).cast("double"), "lambda_cut": F.lit(None).cast("double")})
    vertex = many.select("id", metrics.vertex_weight(F.col("w"), mode).alias("w"))
    return row.join(metrics.edge_cut(edges, partition), how="cross").join(metrics.lambda_cut(edges, partition, vertex), how="cross")


def quality(points: DataFrame, edges: DataFrame, chains: list[list[str]], distributions: list[str]) -> DataFrame:
    """(chain, weights, imbalance, edge_cut) of every chain on every weight distribution; null
    where a chain finds nothing. Weights are spread over whole numbers for algorithms that need
    them."""
    spark = points.sparkSession
    out = []
    for d in distributions:
        w = weights.parse(d, points).select("id", F.round("w").cast("bigint").alias("w")).persist()
        problem = Problem(weights=w, points=points, edges=edges)
        for chain in chains:
            try:
                p = registry.run_chain(problem, chain).partition
                k = metrics.part_count(p)
                off = metrics.imbalance(metrics.part_loads(p, w, k)).first()[0]
                cut = metrics.edge_cut(edges, p).first()[0]
            except NotFound:
                off = cut = None
            out.append((" ".join(chain), d, off, None if cut is None else float(cut)))
        w.unpersist()
    return spark.createDataFrame(out, "chain string, weights string, imbalance double, edge_cut double")


def spread_of(centers: list[list[float]]) -> float:
    """The largest distance between two centres, of which there are as many as parts."""
    return max((sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5 for p in centers for q in centers), default=0.0)


def within(points: DataFrame, box: geometry.OrientedBox) -> DataFrame:
    """(id, region, inside): octant and membership of points in an oriented box."""
    lo, hi = (F.array(*[F.lit(float(x)) for x in v]) for v in (box.p_min, box.p_max))
    p = box.aligned(points)
    return p.select("id", geometry.region(lo, hi, F.col("coords")).cast("int").alias("region"), geometry.contains(lo, hi, F.col("coords")).alias("inside"))
