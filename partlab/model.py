"""Data model: problems as DataFrames, partitions as (id, part), errors, input checks."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PartitionError(Exception):
    """Base of all errors that algorithms and readers raise."""


class NotFound(PartitionError):
    """No partition satisfies the constraints (or none within the budget)."""


class InputLenMismatch(PartitionError):
    """Tables that should cover the same items don't."""


class NegativeValues(PartitionError):
    """Weights must not be negative here."""


class BiPartitioningOnly(PartitionError):
    """The algorithm handles two parts only."""


class InvalidOrder(PartitionError):
    """A curve's order is out of range."""


class NonFinite(PartitionError):
    """A weight or coordinate is null, NaN or infinite."""


class FormatError(PartitionError):
    """A file isn't what its format says."""


class UnsupportedVersion(FormatError):
    """A file has a version that isn't known."""


@dataclass
class Result:
    """A partition and what the algorithm says about it."""

    partition: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)


class Partitioner(ABC):
    """The extension point: anything that makes a partition of a problem.

    ``partition`` is the partition so far (all zero at the start of a chain).
    """

    @abstractmethod
    def run(self, problem: Problem, partition: DataFrame) -> Result: ...


@dataclass
class Problem:
    """Items with optional coordinates, weights and adjacency, as lazy DataFrames.

    points: (id, coords ARRAY<DOUBLE>); weights: (id, w BIGINT or DOUBLE);
    edges: (src, dst, w), both directions; elements and nodes: a mesh that points and edges
    are derived from if they aren't given.
    """

    weights: DataFrame | None = None
    points: DataFrame | None = None
    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    elements: DataFrame | None = None
    dimension: int | None = None
    edge_weights: str = "uniform"

    @cached_property
    def coordinates(self) -> DataFrame:
        if self.points is not None:
            return self.points
        from .operators.mesh import barycentres

        return barycentres(self.nodes, self.elements).persist()

    @cached_property
    def adjacency(self) -> DataFrame:
        from .operators.graph import dual_graph, weigh_edges

        edges = self.edges if self.edges is not None else dual_graph(self.elements)
        return weigh_edges(edges, self.weights, self.edge_weights).persist() if self.weights is not None else edges

    @cached_property
    def items(self) -> DataFrame:
        """(id) of all items."""
        for df in (self.weights, self.points):
            if df is not None:
                return df.select("id")
        if self.elements is not None:
            return self.coordinates.select("id")
        return self.edges.select(F.col("src").alias("id")).distinct()

    def zeros(self) -> DataFrame:
        return self.items.select("id", F.lit(0).alias("part"))


def check_items(df: DataFrame, *numbers: str) -> int:
    """One pass: ids not null and distinct, ``numbers`` finite. Gives the number of rows."""
    bad = F.lit(False)
    for c in numbers:
        v = F.col(c).cast("double")
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    per_id = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad"))
    n, most, nulls, wrong = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.col("id").isNull()), F.coalesce(F.max("bad"), F.lit(False))).first()
    if nulls or most > 1:
        raise InputLenMismatch("ids must be distinct and not null")
    if wrong:
        raise NonFinite("weights and coordinates must be finite numbers")
    return int(n)


def check_same_items(left: DataFrame, right: DataFrame) -> None:
    """Both tables must cover the same ids."""
    if left.select("id").join(right.select("id"), "id", "left_anti").isEmpty() and right.select("id").join(left.select("id"), "id", "left_anti").isEmpty():
        return
    raise InputLenMismatch("both tables must have the same ids")
