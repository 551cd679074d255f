"""Algorithm chains from text: ``parse("hilbert,4")``, ``run_chain(problem, ["rcb,2", "fm,0.05"])``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PartitionError, Partitioner, Problem, Result
from ..operators import geometric, graph, kmeans, numbers


class _Step(Partitioner):
    def __init__(self, name: str, run: Callable[[Problem, DataFrame], DataFrame | Result]):
        self.name, self._run = name, run

    def run(self, problem: Problem, partition: DataFrame) -> Result:
        out = self._run(problem, partition)
        return out if isinstance(out, Result) else Result(out)


def _real(p: Problem) -> DataFrame:
    """Weights as one number an item: the first criterion."""
    first = F.col("w")[0] if p.weights.schema["w"].dataType.simpleString().startswith("array") else F.col("w")
    return p.weights.select("id", first.alias("w"))


def _whole_edges(p: Problem) -> DataFrame:
    return p.adjacency.select("src", "dst", F.col("w").cast("bigint").alias("w"))


def _kernel(name: str, *args) -> Callable[[Problem, DataFrame], DataFrame]:
    kernel = numbers.KERNELS[name](*args)
    return lambda p, part: numbers.solve(_real(p).join(part, "id"), kernel)


def _number(args: list[str], i: int, kind, default=None):
    if i < len(args) and args[i] != "":
        try:
            return kind(args[i])
        except ValueError as e:
            raise PartitionError(f"{args[i]!r} is not a {kind.__name__}") from e
    if default is None:
        raise PartitionError("an argument is missing")
    return default


def parse(spec: str) -> Partitioner:
    """An algorithm from ``name,argument,...``. For limits 0 means none."""
    name, *a = spec.strip().split(",")
    n = lambda i, kind, default=None: _number(a, i, kind, default)
    none = lambda v: v or None
    table: dict[str, Callable[[], Callable]] = {
        "random": lambda: (lambda k, seed: lambda p, _: geometric.random_parts(p.items, k, seed))(n(0, int), n(1, int, 0)),
        "greedy": lambda: _kernel("greedy", n(0, int)),
        "kk": lambda: _kernel("kk", n(0, int)),
        "ckk": lambda: _kernel("ckk", n(0, float)),
        "vn-best": lambda: _kernel("vn-best"),
        "vn-first": lambda: _kernel("vn-first"),
        "rcb": lambda: (lambda k, t: lambda p, _: geometric.rcb(p.coordinates, _real(p), k, t))(n(0, int), n(1, float, 0.05)),
        "rib": lambda: (lambda k, t: lambda p, _: geometric.rib(p.coordinates, _real(p), k, t))(n(0, int), n(1, float, 0.05)),
        "hilbert": lambda: (lambda k, o: lambda p, _: geometric.hilbert(p.coordinates, _real(p), k, o))(n(0, int), n(1, int, 12)),
        "zcurve": lambda: (lambda k, o: lambda p, _: geometric.z_curve(p.coordinates, k, o))(n(0, int), n(1, int, 12)),
        "multi-jagged": lambda: (lambda k, o: lambda p, _: geometric.multi_jagged(p.coordinates, _real(p), k, o))(n(0, int), n(1, int, 2)),
        "graph-growth": lambda: (lambda k, s: lambda p, _: graph.graph_growth(p.adjacency, _real(p), k, s))(n(0, int), n(1, int, 0)),
        "kmeans": lambda: (lambda t, d, m: lambda p, part: kmeans.kmeans(p.coordinates, _real(p), part, t, d, m))(n(0, float, 5.0), n(1, float, 0.01), n(2, int, 500)),
        "arcswap": lambda: (lambda m: lambda p, part: graph.arc_swap(_whole_edges(p), _real(p), part, m))(n(0, float) if a and a[0] else None),
        "fm": lambda: (lambda m, bad, passes, moves: lambda p, part: graph.fiduccia_mattheyses(_whole_edges(p), _real(p), part, none(passes), none(moves), m, bad))(n(0, float) if a and a[0] else None, n(1, int, 0), n(2, int, 0), n(3, int, 0)),
        "kl": lambda: (lambda bad: lambda p, part: graph.kernighan_lin(p.adjacency, _real(p), part, 1, None, bad))(n(0, int, 1)),
    }
    if name not in table:
        raise PartitionError(f"unknown algorithm {name!r}")
    return _Step(spec, table[name]())


def run_chain(problem: Problem, specs: list[str]) -> Result:
    """Each algorithm works on the partition of the one before; the first on all zero."""
    result = Result(problem.zeros())
    said = {}
    for i, spec in enumerate(specs):
        result = parse(spec).run(problem, result.partition)
        said[f"{i}:{spec}"] = result.metadata
    return Result(result.partition, said)
