"""Quality of a partition: loads, imbalance, cuts. Aggregations only; each result is a small
DataFrame, so metrics compose with any query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_loads(partition: DataFrame, weights: DataFrame, part_count: int) -> DataFrame:
    """(part, load) of parts 0 ... part_count - 1; empty parts have 0."""
    spark = partition.sparkSession
    sums = partition.join(weights, "id").groupBy("part").agg(F.sum("w").alias("load"))
    parts = spark.range(part_count).select(F.col("id").cast("int").alias("part"))
    zero = F.lit(0).cast(sums.schema["load"].dataType)
    return parts.join(sums, "part", "left").select("part", F.coalesce("load", zero).alias("load"))


def part_count(partition: DataFrame) -> int:
    """1 + the largest part id; 0 without items."""
    top = partition.agg(F.max("part")).first()[0]
    return 0 if top is None else top + 1


def imbalance(loads: DataFrame) -> DataFrame:
    """One row (imbalance): the largest relative excess of a load over the mean load, negative
    never; 0 without parts or load."""
    ideal = F.sum("load") / F.count(F.lit(1))
    value = F.when((F.count(F.lit(1)) > 0) & (ideal != 0), (F.max("load") - ideal) / ideal).otherwise(0.0)
    return loads.agg(F.coalesce(value, F.lit(0.0)).alias("imbalance"))


def imbalance_target(loads: DataFrame, targets: DataFrame) -> DataFrame:
    """One row (excess): the largest of load - target over (part, target)."""
    return loads.join(targets, "part").agg(F.max(F.col("load") - F.col("target")).alias("excess"))


def max_imbalance(loads: DataFrame) -> DataFrame:
    """One row (spread): largest load minus smallest, 0 without parts."""
    zero = F.lit(0).cast(loads.schema["load"].dataType)
    return loads.agg(F.coalesce(F.max("load") - F.min("load"), zero).alias("spread"))


def _ends(edges: DataFrame, partition: DataFrame) -> DataFrame:
    a = partition.select(F.col("id").alias("src"), F.col("part").alias("src_part"))
    b = partition.select(F.col("id").alias("dst"), F.col("part").alias("dst_part"))
    return edges.join(a, "src").join(b, "dst")


def edge_cut(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row (edge_cut): weights of edges between parts; of both directions one counts."""
    cut = _ends(edges.where("dst < src"), partition).where("src_part != dst_part")
    zero = F.lit(0).cast(edges.schema["w"].dataType)
    return cut.agg(F.coalesce(F.sum("w"), zero).alias("edge_cut"))


def lambda_cut(edges: DataFrame, partition: DataFrame, vertex_weights: DataFrame) -> DataFrame:
    """One row (lambda_cut): for each vertex its weight times the number of parts among itself
    and its neighbours, less one. Neighbour parts are made distinct before they are counted,
    so a hub's edges are combined where they are read."""
    own = partition.select(F.col("id").alias("src"), F.col("part").alias("p"))
    near = edges.join(partition.select(F.col("id").alias("dst"), F.col("part").alias("p")), "dst").select("src", "p")
    spread = own.unionAll(near).distinct().groupBy("src").agg((F.count(F.lit(1)) - 1).alias("extra"))
    w = vertex_weights.select(F.col("id").alias("src"), "w")
    zero = F.lit(0).cast(vertex_weights.schema["w"].dataType)
    return spread.where("extra > 0").join(w, "src").agg(F.coalesce(F.sum(F.col("w") * F.col("extra")), zero).alias("lambda_cut"))


def vertex_weight(criteria: Column, mode: str) -> Column:
    """Weight of a vertex from its ARRAY of criteria: uniform, linear or sqrt."""
    if mode == "uniform":
        return F.size(criteria).cast("bigint")
    if mode == "linear":
        return F.aggregate(criteria, F.lit(0.0), lambda s, v: s + v)
    if mode == "sqrt":
        return F.aggregate(criteria, F.lit(0.0), lambda s, v: s + F.sqrt(v))
    raise ValueError(f"edge weights are uniform, linear or sqrt, not {mode!r}")


def weight_stats(partition: DataFrame, weights: DataFrame, part_count: int) -> DataFrame:
    """For each criterion of ``w ARRAY``: total, imbalance (0 at least), the lightest and the
    heaviest part's weight and how many parts have it."""
    spark = partition.sparkSession
    each = partition.join(weights, "id").select("part", F.posexplode("w").alias("criterion", "v"))
    sums = each.groupBy("criterion", "part").agg(F.sum("v").alias("load"))
    grid = spark.range(part_count).select(F.col("id").cast("int").alias("part")).join(each.select("criterion").distinct(), how="cross")
    loads = grid.join(sums, ["criterion", "part"], "left").select("criterion", F.coalesce("load", F.lit(0).cast(sums.schema["load"].dataType)).alias("load"))
    per_load = loads.groupBy("criterion", "load").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.sum(F.col("load") * F.col("n")) / F.lit(part_count)
    over = F.when(ideal != 0, F.greatest(F.lit(0.0), (F.max("load") - ideal) / ideal)).otherwise(0.0)
    return per_load.groupBy("criterion").agg(
        F.sum(F.col("load") * F.col("n")).alias("total"), over.alias("imbalance"),
        F.min("load").alias("lightest"), F.min_by("n", "load").alias("n_lightest"),
        F.max("load").alias("heaviest"), F.max_by("n", "load").alias("n_heaviest"),
    )


def empty_parts(partition: DataFrame, part_count: int) -> DataFrame:
    """One row (empty_parts)."""
    return partition.agg((F.lit(part_count) - F.count_distinct("part")).alias("empty_parts"))
