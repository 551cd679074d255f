"""An extension for streams: points that arrive later join an existing partition.

Splits or cuts are small and fixed, so assignment is a stateless map and runs in Structured
Streaming as it does on tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from ..functions.geometry import coord
from ..operators.geometric import SplitTree


def by_tree(points: DataFrame, tree: SplitTree, first: int) -> DataFrame:
    """(id, part) from a bisection's split tree; ``first`` is the node that part 0 is."""
    return points.select("id", (tree.node(F.col("coords")) - F.lit(first)).cast("int").alias("part"))


def by_hilbert(points: DataFrame, cuts: list[int], p_min: list[float], p_max: list[float], order: int) -> DataFrame:
    """(id, part) from the cuts of a Hilbert curve in two dimensions; points outside the box
    count as on its rim."""
    g = [curves.to_grid(F.least(F.greatest(coord(i), F.lit(float(p_min[i]))), F.lit(float(p_max[i]))), p_min[i], p_max[i], order) for i in range(2)]
    keyed = points.select("id", curves.hilbert_2d(*g, order).alias("h"))
    table = F.from_json(F.lit(json.dumps(sorted(cuts))), "array<bigint>")
    return keyed.select("id", F.size(F.filter(table, lambda c: c < F.col("h"))).cast("int").alias("part"))
