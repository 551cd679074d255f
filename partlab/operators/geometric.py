"""Partitions from coordinates: recursive bisection, curves, jagged cuts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves, geometry
from ..functions.geometry import coord
from ..functions.numeric import root_ceil
from .prefix import prefix_sum, rank, tile

#: Midpoints that one pass over the data tries ahead: 2**AHEAD - 1.
AHEAD = 6


def axis_rank(points: DataFrame, axis: int) -> DataFrame:
    """(id, rank): 0-based place along an axis, ties by id."""
    p = points.select("id", coord(axis).alias("x"))
    return rank(p, ["x", "id"]).select("id", F.col("rank").cast("bigint").alias("rank"))


def random_parts(items: DataFrame, part_count: int, seed: int = 0) -> DataFrame:
    """A uniform part for each id, always the same for a seed."""
    return items.select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(part_count)).cast("int").alias("part"))


@dataclass
class SplitTree:
    """Bisections by node: node i's children are 2 i + 1 (below the split) and 2 i + 2."""

    dimension: int
    depth: int
    splits: dict[int, float] = field(default_factory=dict)  # infinity: all stay below

    def node(self, coords: Column, levels: int | None = None) -> Column:
        """The node that holds a point after so many levels."""
        levels = self.depth if levels is None else levels
        if levels == 0:
            return F.lit(0)
        table = F.from_json(F.lit(json.dumps([str(self.splits.get(i, float("inf"))) for i in range(2**levels - 1)]).replace("inf", "Infinity")), "array<string>")
        table = F.transform(table, lambda s: s.cast("double"))
        axes = F.array(*[F.lit(k % self.dimension) for k in range(levels)])
        step = lambda n, axis: (2 * n + 1 + (F.element_at(coords, axis + 1).cast("double") >= F.element_at(table, n + 1)).cast("int")).cast("int")
        return F.aggregate(axes, F.lit(0), step)


@dataclass
class _Search:
    """One node's search for its split position: an interval that is halved until the weights
    of both sides agree."""

    lo: float
    hi: float
    total: float
    box: list[list[float]]
    before: int | None = None
    split: float | None = None
    left: float = 0.0

    def targets(self) -> list[float]:
        """All midpoints that the next AHEAD steps may ask for."""
        found, level = set(), [(self.lo, self.hi)]
        for _ in range(AHEAD):
            level = [x for lo, hi in level for x in ((lo, (lo + hi) / 2), ((lo + hi) / 2, hi))]
            found |= {hi for lo, hi in level[::2]}
        return sorted(found)

    def advance(self, targets: list[float], below: dict[float, tuple[int, float, float | None]], tolerance: float) -> None:
        """Steps as far as the targets go. ``below``: for each target the count and weight left
        of it and the nearest coordinate at or right of it."""
        known = set(targets)
        half = self.total / 2
        while self.split is None:
            t = (self.lo + self.hi) / 2
            if t not in known:
                return
            count, weight, near = below[t]
            if near is None:
                if self.before == count:
                    self.split, self.left = float("inf"), self.total
                    return
                self.hi, self.before = t, count
                continue
            off = abs((weight - half) / half) if half else 0.0
            if count == self.before or self.hi <= t + (near - t) or off <= tolerance:
                self.split, self.left = t, weight
                return
            self.before = count
            if weight < self.total - weight:
                self.lo = t
            else:
                self.hi = t


def bisection_tree(points: DataFrame, weights: DataFrame, iterations: int, tolerance: float = 0.05, float32: bool = False) -> tuple[SplitTree, DataFrame]:
    """The split tree, and (id, coords, w) that it was made from.

    All nodes of a level are searched in the same passes. A pass tries the midpoints of several
    halvings at once: rows are counted between neighbouring midpoints, so what reaches the
    driver is a few dozen sums a node, and rows are never moved or sorted.
    """
    d = geometry.dimension(points)
    data = points.select("id", "coords").join(weights.select("id", "w"), "id")
    if float32:
        data = data.withColumn("coords", F.col("coords").cast("array<float>"))
    data = data.persist()
    box = geometry.bounding_box(data, d).first()
    total = data.agg(F.sum("w")).first()[0]
    tree = SplitTree(max(d, 1), iterations)
    if box["p_min"] is None:
        return tree, data
    open_nodes = {0: _Search(box["p_min"][0], box["p_max"][0], float(total), [[float(x) for x in box["p_min"]], [float(x) for x in box["p_max"]]])}
    for level in range(iterations):
        axis = level % d
        node = tree.node(F.col("coords"), level)
        searching = dict(open_nodes)
        while searching:
            targets = {n: s.targets() for n, s in searching.items()}
            table = F.from_json(F.lit(json.dumps({str(n): t for n, t in targets.items()})), "map<string,array<double>>")
            rows = data.select(node.alias("node"), F.element_at("coords", axis + 1).cast("double").alias("x"), "w")
            rows = rows.where(F.col("node").isin(list(searching))).withColumn("t", F.element_at(table, F.col("node").cast("string")))
            halves = F.array(*[F.lit(1 << i) for i in reversed(range(AHEAD))])
            cell = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.try_element_at(F.col("t"), at + step) <= F.col("x"), at + step).otherwise(at))
            sums = rows.groupBy("node", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("x").alias("near")).collect()
            cells: dict[int, dict[int, tuple]] = {}
            for r in sums:
                cells.setdefault(r["node"], {})[r["cell"]] = (r["n"], r["w"], r["near"])
            for n, s in list(searching.items()):
                own = cells.get(n, {})
                below, count, weight = {}, 0, 0
                near: list[float | None] = [None] * (len(targets[n]) + 2)
                for k in range(len(targets[n]), -1, -1):
                    near[k] = own[k][2] if k in own else near[k + 1]
                for k, t in enumerate(targets[n]):
                    if k in own:
                        count, weight = count + own[k][0], weight + own[k][1]
                    below[t] = (count, float(weight), near[k + 1])
                s.advance(targets[n], below, tolerance)
                if s.split is not None:
                    tree.splits[n] = s.split
                    del searching[n]
        following: dict[int, _Search] = {}
        nxt = (level + 1) % d
        for n, s in open_nodes.items():
            sides = [(2 * n + 1, s.left, 1)] + ([(2 * n + 2, s.total - s.left, 0)] if s.split != float("inf") else [])
            for child, w, end in sides:
                b = [list(s.box[0]), list(s.box[1])]
                if s.split != float("inf"):
                    b[end][axis] = s.split
                elif end:
                    b[1][axis] = s.hi
                following[child] = _Search(b[0][nxt], b[1][nxt], w, b)
        open_nodes = following
    return tree, data


def rcb(points: DataFrame, weights: DataFrame, iterations: int, tolerance: float = 0.05, float32: bool = False) -> DataFrame:
    """(id, part): 2**iterations parts at most, by halving along one axis after another. Part
    ids start at 0 and keep the tree's order; a node without items leaves a gap."""
    tree, data = bisection_tree(points, weights, iterations, tolerance, float32)
    nodes = data.select("id", tree.node(F.col("coords")).alias("node"))
    first = nodes.agg(F.min("node")).first()[0] or 0
    return nodes.select("id", (F.col("node") - first).cast("int").alias("part"))


def rib(points: DataFrame, weights: DataFrame, iterations: int, tolerance: float = 0.05) -> DataFrame:
    """RCB along the points' principal axes."""
    d = geometry.dimension(points)
    if not d:
        return rcb(points, weights, iterations, tolerance)
    box = geometry.OrientedBox.of(points, d)
    return rcb(box.aligned(points), weights, iterations, tolerance)


def _boxed(points: DataFrame, rotate: bool) -> tuple[DataFrame, list[float] | None, list[float] | None, int]:
    d = geometry.dimension(points)
    if not d:
        return points, None, None, 0
    if rotate:
        box = geometry.OrientedBox.of(points, d)
        return box.aligned(points), box.p_min, box.p_max, d
    row = geometry.bounding_box(points, d).first()
    return points, row["p_min"], row["p_max"], d


def hilbert_index(points: DataFrame, order: int = 12, rotate: bool = True) -> DataFrame:
    """(id, h): place along the Hilbert curve through 2 or 3 dimensions."""
    p, lo, hi, d = _boxed(points, rotate)
    if not d:
        return points.select("id", F.lit(0).cast("bigint").alias("h"))
    if d not in (2, 3):
        raise ValueError("Hilbert curves are for two and three dimensions")
    axes = p.select("id", *[curves.to_grid(coord(i), lo[i], hi[i], order).alias(f"g{i}") for i in range(d)])
    g = [F.col(f"g{i}") for i in range(d)]
    return axes.select("id", (curves.hilbert_2d(*g, order) if d == 2 else curves.hilbert_3d(*g, order)).alias("h"))


def weighted_cuts(keyed: DataFrame, part_count: int, key: str = "h") -> DataFrame:
    """(i, cut) for i = 1 ... part_count - 1: the least key at which the weight up to and with it
    reaches i / part_count of all. Rows are summed by key first; then a prefix sum."""
    per_key = keyed.groupBy(key).agg(F.sum("w").alias("w"))
    run = prefix_sum(per_key, F.col("w"), [key])
    total = keyed.agg(F.sum("w").alias("total"))
    # the cuts that a row reaches, but for rounding: a few numbers, tested exactly
    place = lambda x: F.floor(x.cast("double") * part_count / F.nullif(F.col("total"), F.lit(0))).cast("int")
    low, high = F.greatest(F.lit(1), place(F.col("cum") - F.col("w")) - 1), F.least(F.lit(part_count - 1), place(F.col("cum")) + 1)
    wanted = F.when(low <= high, F.sequence(low, high))
    each = run.crossJoin(F.broadcast(total)).select(key, "cum", F.explode(F.filter(wanted, lambda i: (F.col("cum") * part_count >= i * F.col("total")) & ((F.col("cum") - F.col("w")) * part_count < i * F.col("total")))).alias("i"))
    return each.groupBy("i").agg(F.min(key).alias("cut"))


def curve_parts(keyed: DataFrame, part_count: int, key: str = "h") -> DataFrame:
    """(id, part): the number of cuts strictly below the key, by a binary search. Cuts are
    part_count - 1 numbers."""
    cuts = sorted(r["cut"] for r in weighted_cuts(keyed, part_count, key).collect())
    table = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    if not cuts:
        return keyed.select("id", F.lit(0).alias("part"))
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.try_element_at(table, at + step) < F.col(key), at + step).otherwise(at))
    return keyed.select("id", below.cast("int").alias("part"))


def hilbert(points: DataFrame, weights: DataFrame, part_count: int = 2, order: int = 12, rotate: bool = True) -> DataFrame:
    """(id, part): runs of the Hilbert curve of equal weight."""
    keyed = hilbert_index(points, order, rotate).join(weights.select("id", "w"), "id")
    return curve_parts(keyed, part_count)


def z_curve(points: DataFrame, part_count: int, order: int = 12, rotate: bool = True) -> DataFrame:
    """(id, part): runs of the Z-curve of equal numbers of items; weights play no part."""
    p, lo, hi, d = _boxed(points, rotate)
    if not d:
        return points.select("id", F.lit(0).alias("part"))
    keyed = p.select("id", curves.z_order([coord(i) for i in range(d)], lo, hi, order).alias("z"))
    n = points.count()
    return rank(keyed, ["z", "id"], rows=n).select("id", tile(F.col("rank"), F.lit(n), part_count).alias("part"))


def jagged_scheme(part_count: int, iterations: int) -> list[list[int]]:
    """How many parts each slab of a level is to have, level by level; slabs in order."""
    levels, now = [], [part_count]
    for left in range(iterations, 0, -1):
        nxt = []
        for n in now:
            slabs = min(root_ceil(n, left), n) if n > 1 else 1
            each, longer = divmod(n, slabs)
            nxt.append([each + 1] * longer + [each] * (slabs - longer))
        levels.append(nxt)
        now = [m for slabs in nxt for m in slabs]
    return levels


def multi_jagged(points: DataFrame, weights: DataFrame, part_count: int, iterations: int) -> DataFrame:
    """(id, part): each level cuts every slab of the one before along the next axis into slabs
    of weights in proportion to the parts they'll have. An item that fills a slab exactly stays
    in it. Parts are numbered in the slabs' order."""
    d = geometry.dimension(points)
    data = points.select("id", "coords").join(weights.select("id", "w"), "id").select("id", "w", "coords", F.lit(0).alias("seg"))
    if not d:
        return data.select("id", F.lit(0).alias("part"))
    n = data.count()
    for level, slabs in enumerate(jagged_scheme(part_count, iterations)):
        data = data.withColumn("x", coord(level % d))
        run = prefix_sum(data, F.col("w"), ["x", "id"], ["seg"], rows=n)
        totals = data.groupBy("seg").agg(F.sum("w").alias("total"))
        base, firsts, ends = 0, [], []
        for s in slabs:
            firsts.append(base)
            base += len(s)
            done, e = 0, []
            for m in s[:-1]:
                done += m
                e.append(done)
            ends.append(e)
        table = F.from_json(F.lit(json.dumps([{"first": a, "parts": sum(s), "ends": e} for a, s, e in zip(firsts, slabs, ends)])), "array<struct<first:int,parts:int,ends:array<int>>>")
        own = F.element_at(table, F.col("seg") + 1)
        # ends counts parts: the slab goes on while cum <= total * end / parts
        over = F.size(F.filter(own["ends"], lambda e: F.col("cum") * own["parts"] > e * F.col("total")))
        data = run.join(F.broadcast(totals), "seg").select("id", "w", "coords", (own["first"] + over).cast("int").alias("seg"))
    return data.select("id", F.col("seg").alias("part"))
