"""Number-partitioning experiments: sample weights, run a kernel on every sample, keep the
imbalance; a store of parquet tables that takes each experiment once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import numbers, weights


def run(spark: SparkSession, distribution: str, n: int, iterations: int, kernel: numbers.Kernel, part_count: int, seed: int) -> DataFrame:
    """(iteration, imbalance) of the iterations for which the kernel finds a partition. Samples
    are partitioned side by side, a task each."""
    w = weights.sample(spark, n, iterations, distribution, seed)
    parts = numbers.solve(w, kernel, by="iteration", skip_failures=True)
    loads = w.join(parts, ["iteration", "id"]).groupBy("iteration", "part").agg(F.sum("w").alias("load"))
    total = F.sum("load")
    return loads.groupBy("iteration").agg(F.when(total != 0, F.max("load") * part_count / total - 1).otherwise(0.0).alias("imbalance"))


KEY = ["distribution", "n", "algorithm", "part_count", "seed", "iteration"]


def store(results: DataFrame, path: str, **what) -> int:
    """Appends results that the store doesn't have yet (by KEY); gives their number."""
    spark = results.sparkSession
    rows = results.select(*[F.lit(what[k]).alias(k) for k in KEY if k != "iteration"], "iteration", "imbalance").select(*KEY, "imbalance")
    try:
        old = spark.read.schema(rows.schema).parquet(path)
        rows = rows.join(old.select(*KEY), KEY, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.persist()
    n = rows.count()
    rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n
