"""Number partitioning: kernels for one set of weights, and their use on many sets at once.

Each heuristic is sequential by nature, so one set is one task (about a million items a set
is the ceiling); many sets run side by side. Kernels take (ids, weights,
parts so far) and give the new parts and a metadata dictionary.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NegativeValues, NotFound, PartitionError

#: Items of a set without a key at most.
MOST_ITEMS = 8_000_000

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, dict]]


def greedy(part_count: int) -> Kernel:
    """Heaviest first (ties: the larger id), each to the lightest part (ties: the highest)."""

    def run(ids, w, parts):
        if part_count < 2:
            return np.zeros(len(w), np.int64), {}
        loads = [(0, -p) for p in range(part_count)]
        heapq.heapify(loads)
        out = np.zeros(len(w), np.int64)
        for i in np.lexsort((-ids, -w)):
            load, p = loads[0]
            out[i] = -p
            heapq.heapreplace(loads, (load + w[i].item(), p))
        return out, {}

    return run


def karmarkar_karp(part_count: int) -> Kernel:
    """The largest differencing method; with two parts the plain form."""

    def two(ids, w):
        heap = [(-x.item(), -i) for i, x in enumerate(w)]
        heapq.heapify(heap)
        against = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            against.append((-a[1], -b[1]))
            heapq.heappush(heap, (a[0] - b[0], a[1]))
        out = np.zeros(len(w), np.int64)
        for a, b in reversed(against):
            out[b] = 1 - out[a]
        return out

    def many(ids, w):
        # a state is part_count (weight, label) pairs, heaviest first; labels name merged piles
        k, n = part_count, len(w)
        fresh = n
        heap = []
        for i, x in enumerate(w):
            state = [(x.item(), i)]
            for _ in range(k - 1):
                state.append((0, fresh))
                fresh += 1
            heap.append(_Reversed(sorted(state, reverse=True)))
        heapq.heapify(heap)
        joins: list[tuple[int, int]] = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap).state, heapq.heappop(heap).state
            merged = []
            for (x, i), (y, j) in zip(a, reversed(b)):
                merged.append((x + y, i))
                joins.append((i, j))
            merged.sort(reverse=True)
            least = merged[-1][0]
            heapq.heappush(heap, _Reversed([(x - least, i) for x, i in merged]))
        out = np.zeros(fresh, np.int64)
        for p, (_, i) in enumerate(heap[0].state):
            out[i] = p
        for i, j in reversed(joins):
            out[j] = out[i]
        return out[:n]

    def run(ids, w, parts):
        if part_count < 2 or len(w) < 2:
            return parts, {}
        order = np.argsort(ids, kind="stable")
        out = np.empty(len(w), np.int64)
        out[order] = (two if part_count == 2 else many)(ids[order], w[order])
        return out, {}

    return run


class _Reversed:
    """A state whose heap order is the largest first."""

    __slots__ = ("state",)

    def __init__(self, state):
        self.state = state

    def __lt__(self, other):
        return self.state > other.state


def complete_karmarkar_karp(tolerance: float, budget: int = 200_000) -> Kernel:
    """Two parts: the two largest are parted or put together, depth first, until what is left
    over is within tolerance times the sum. ``budget`` bounds the nodes that are visited."""

    def run(ids, w, parts):
        if len(w) < 2:
            return np.zeros(len(w), np.int64), {"visited": 0}
        order = sorted(range(len(w)), key=lambda i: (w[i], ids[i]))
        limit = type(w[0].item())(tolerance * float(w.sum()))
        stack = [([(w[i].item(), i) for i in order], None, 0)]  # values ascending, last step, parent
        nodes: list[tuple] = []
        visited = 0
        while stack:
            values, step, parent = stack.pop()
            visited += 1
            if visited > budget:
                break
            at = len(nodes)
            nodes.append((step, parent))
            if len(values) == 1:
                if values[0][0] <= limit:
                    return _unroll(nodes, at, len(w)), {"visited": visited, "residual": values[0][0]}
                continue
            (b, j), (a, i) = values[-2], values[-1]
            rest = values[:-2]
            # the difference is tried first, so it goes on the stack last
            stack.append((_inserted(rest, (a + b, i)), (i, j, False), at))
            stack.append((_inserted(rest, (a - b, i)), (i, j, True), at))
        raise NotFound(f"nothing within {tolerance} of the sum after {visited} nodes")

    return run


def _inserted(values, item):
    out = list(values)
    bisect.insort(out, item)
    return out


def _unroll(nodes, at, n):
    """Parts from the steps between a leaf and the root: what was merged last is known first."""
    out = np.zeros(n, np.int64)
    while nodes[at][0] is not None:
        (i, j, apart), at = nodes[at]
        out[j] = 1 - out[i] if apart else out[i]
    return out


def _loads(w, parts, k):
    return np.bincount(parts, weights=w, minlength=k) if w.dtype.kind == "f" else np.array([w[parts == p].sum() for p in range(k)], w.dtype)


def vn_best(ids, w, parts):
    """Moves the item of the heaviest part that is nearest to half the spread (below rather than
    above) to the lightest part, as long as the spread shrinks. Counts moves."""
    if len(w) and w.min() < 0:
        raise NegativeValues("weights must not be negative")
    parts = parts.copy()
    k = int(parts.max()) + 1 if len(parts) else 0
    moves = 0
    if k < 2:
        return parts, {"moves": 0}
    loads = _loads(w, parts, k)
    while True:
        hi, lo = int(loads.argmax()), int(k - 1 - loads[::-1].argmin())
        spread = loads[hi] - loads[lo]
        own = np.flatnonzero(parts == hi)
        if not len(own) or spread <= 0:
            break
        half = spread // 2 if w.dtype.kind in "iu" else spread / 2
        gap = np.abs(w[own] - half)
        best = own[np.lexsort((ids[own], w[own] > half, gap))[0]]
        x = w[best]
        if x == 0 or spread <= x:
            break
        parts[best] = lo
        loads[hi] -= x
        loads[lo] += x
        moves += 1
    return parts, {"moves": moves}


def vn_first(ids, w, parts):
    """Goes through the items round and round; moves one from the heaviest part to the lightest
    if that makes the spread smaller, until a whole round moves none. Counts moves."""
    if len(w) and w.min() < 0:
        raise NegativeValues("weights must not be negative")
    parts = parts.copy()
    k = int(parts.max()) + 1 if len(parts) else 0
    moves = 0
    if k < 2:
        return parts, {"moves": 0}
    loads = _loads(w, parts, k)
    order = np.argsort(ids, kind="stable")
    idle = 0
    while idle < len(order):
        for i in order:
            idle += 1
            p = parts[i]
            if loads[p] == loads.max() and w[i] > 0:
                lo = int(k - 1 - loads[::-1].argmin())
                spread = loads.max() - loads.min()
                loads[p] -= w[i]
                loads[lo] += w[i]
                if loads.max() - loads.min() < spread:
                    parts[i] = lo
                    moves += 1
                    idle = 0
                else:
                    loads[p] += w[i]
                    loads[lo] -= w[i]
            if idle >= len(order):
                break
    return parts, {"moves": moves}


KERNELS: dict[str, Callable[..., Kernel]] = {
    "greedy": greedy,
    "kk": karmarkar_karp,
    "ckk": complete_karmarkar_karp,
    "vn-best": lambda: vn_best,
    "vn-first": lambda: vn_first,
}


def solve(sets: DataFrame, kernel: Kernel, by: str | None = None, skip_failures: bool = False) -> DataFrame:
    """(by, id, part) from (by, id, w[, part]): the kernel on each set. Without ``by`` all rows
    are one set, of MOST_ITEMS at most. A set for which nothing is found fails the query, or
    with ``skip_failures`` gives no rows."""
    key = by or "__set"
    if by is None and (n := sets.count()) > MOST_ITEMS:
        raise PartitionError(f"{n} items: a set is one task and has {MOST_ITEMS} items at most")
    data = sets if by else sets.withColumn(key, F.lit(0))
    if "part" not in data.columns:
        data = data.withColumn("part", F.lit(0))
    kind = data.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame | None:
        try:
            parts, _ = kernel(pdf["id"].to_numpy(), pdf["w"].to_numpy(), pdf["part"].to_numpy(np.int64))
        except NotFound:
            if not skip_failures:
                raise
            return None
        return pd.DataFrame({key: pdf[key].to_numpy(), "id": pdf["id"].to_numpy(), "part": np.asarray(parts, "int32")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by set; a set may reach into the next batch, so the last one waits
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[key]
            new = ((k != k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy()
            new[0] = bool(held) and not (held[-1][key].iloc[-1] == k.iloc[0] or (pd.isna(held[-1][key].iloc[-1]) and pd.isna(k.iloc[0])))
            at = [0, *np.flatnonzero(new).tolist(), len(pdf)]
            done = []
            for lo, hi in zip(at, at[1:]):
                if lo < len(pdf) and new[lo] and held:
                    done.append(one(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                if hi > lo:
                    held.append(pdf.iloc[lo:hi])
            done = [d for d in done if d is not None]
            if done:
                yield pd.concat(done)
        if held and (last := one(pd.concat(held))) is not None:
            yield last

    ready = data.select(key, "id", "w", F.col("part").cast("int").alias("part")).repartition(key).sortWithinPartitions(key, "id")
    out = ready.mapInPandas(run, f"`{key}` {kind}, id bigint, part int")
    return out if by else out.drop(key)
