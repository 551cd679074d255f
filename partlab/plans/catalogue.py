"""The registered queries: every operator on the driver's tables, with DuckDB SQL of the same
result. Heuristics whose result SQL can't express are queried by their invariants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import curves, geometry, numeric
from .. import shared
from ..model import FormatError, Problem
from ..operators import geometric, graph, grid, kmeans, mesh, metrics, numbers, weights
from ..sources import tables
from . import experiments, inputs, registry, report
from .inputs import CELLS, EDGES, GRID, MESH, PARTS, PTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- geometry


@query(f"WITH {PTS} SELECT min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM pts")
def bbox_orders(spark, d):
    b = geometry.bounding_box(inputs.orders(spark, d), 2)
    return b.select(F.col("p_min")[0].alias("x_min"), F.col("p_min")[1].alias("y_min"), F.col("p_max")[0].alias("x_max"), F.col("p_max")[1].alias("y_max"))


@query(f"WITH {PTS} SELECT round(avg(x), 3) AS cx, round(avg(y), 3) AS cy FROM pts")
def centroid_orders(spark, d):
    c = geometry.centroid(inputs.orders(spark, d), 2)
    return c.select(F.round("c0", 3).alias("cx"), F.round("c1", 3).alias("cy"))


@query(f"""WITH {PTS}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM pts)
    SELECT round(sum((x - cx) * (x - cx)) / any_value(n) / 1e6, 4) AS xx, round(sum((x - cx) * (y - cy)) / any_value(n) / 1e6, 4) AS xy, round(sum((y - cy) * (y - cy)) / any_value(n) / 1e6, 4) AS yy FROM pts, c""")
def inertia_orders(spark, d):
    o = inputs.orders(spark, d)
    m = geometry.inertia_matrix(o, 2)
    n = o.agg(F.count(F.lit(1)).alias("n"))
    return n.select(*[F.round(F.lit(float(v)) / F.col("n") / 1e6, 4).alias(k) for k, v in (("xx", m[0, 0]), ("xy", m[0, 1]), ("yy", m[1, 1]))])


_BOX = f"WITH {PTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts)"


@query(f"{_BOX} SELECT id, (CASE WHEN x > (x0 + x1) / 2 THEN 1 ELSE 0 END + CASE WHEN y > (y0 + y1) / 2 THEN 2 ELSE 0 END)::INTEGER AS region, (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS inside FROM pts, b")
def box_regions(spark, d):
    o = inputs.orders(spark, d)
    b = geometry.bounding_box(o, 2).first()
    lo, hi = (F.array(*[F.lit(v) for v in b[k]]) for k in ("p_min", "p_max"))
    return o.select("id", geometry.region(lo, hi, F.col("coords")).cast("int").alias("region"), geometry.contains(lo, hi, F.col("coords")).alias("inside"))


@query(f"""{_BOX}, q AS (SELECT id, x, y, x0 + (x1 - x0) / 4 AS a0, x1 - (x1 - x0) / 4 AS a1, y0 + (y1 - y0) / 4 AS b0, y1 - (y1 - y0) / 4 AS b1 FROM pts, b),
    r AS (SELECT id, greatest(a0 - x, x - a1, 0) AS ox, greatest(b0 - y, y - b1, 0) AS oy, least(x - a0, a1 - x) AS ix, least(y - b0, b1 - y) AS iy FROM q)
    SELECT id, round(CASE WHEN ox = 0 AND oy = 0 THEN least(ix, iy) ELSE sqrt(ox * ox + oy * oy) END, 6) AS distance FROM r""")
def box_distance(spark, d):
    """Distance of each point to the middle half of the box."""
    o = inputs.orders(spark, d)
    b = geometry.bounding_box(o, 2).first()
    lo = F.array(*[F.lit(p + (q - p) / 4) for p, q in zip(b["p_min"], b["p_max"])])
    hi = F.array(*[F.lit(q - (q - p) / 4) for p, q in zip(b["p_min"], b["p_max"])])
    return o.select("id", F.round(geometry.distance_to_box(lo, hi, F.col("coords")), 6).alias("distance"))


@query(f"{_BOX} SELECT id, CASE WHEN x > (x0 + x1) / 2 THEN (x0 + x1) / 2 ELSE x0 END AS x_min, CASE WHEN x > (x0 + x1) / 2 THEN x1 ELSE (x0 + x1) / 2 END AS x_max, CASE WHEN y > (y0 + y1) / 2 THEN (y0 + y1) / 2 ELSE y0 END AS y_min, CASE WHEN y > (y0 + y1) / 2 THEN y1 ELSE (y0 + y1) / 2 END AS y_max FROM pts, b")
def sub_boxes(spark, d):
    """The quarter of the box that each point is in."""
    o = inputs.orders(spark, d)
    b = geometry.bounding_box(o, 2).first()
    lo, hi = (F.array(*[F.lit(v) for v in b[k]]) for k in ("p_min", "p_max"))
    s = o.select("id", geometry.sub_box(lo, hi, geometry.region(lo, hi, F.col("coords"))).alias("s"))
    return s.select("id", F.col("s.p_min")[0].alias("x_min"), F.col("s.p_max")[0].alias("x_max"), F.col("s.p_min")[1].alias("y_min"), F.col("s.p_max")[1].alias("y_max"))


@query(f"WITH {PTS} SELECT id, row_number() OVER (ORDER BY x, id) - 1 AS rank FROM pts")
def axis_rank(spark, d):
    return geometric.axis_rank(inputs.orders(spark, d), 0)


# --- curves

_Z = f"""{_BOX.replace("WITH", "WITH RECURSIVE")},
    z(id, x, y, l0, h0, l1, h1, key, lvl) AS (
        SELECT id, x, y, x0, x1, y0, y1, 0::BIGINT, 0 FROM pts, b
        UNION ALL
        SELECT id, x, y, CASE WHEN x > (l0 + h0) / 2 THEN (l0 + h0) / 2 ELSE l0 END, CASE WHEN x > (l0 + h0) / 2 THEN h0 ELSE (l0 + h0) / 2 END,
               CASE WHEN y > (l1 + h1) / 2 THEN (l1 + h1) / 2 ELSE l1 END, CASE WHEN y > (l1 + h1) / 2 THEN h1 ELSE (l1 + h1) / 2 END,
               key * 4 + CASE WHEN x > (l0 + h0) / 2 THEN 1 ELSE 0 END + CASE WHEN y > (l1 + h1) / 2 THEN 2 ELSE 0 END, lvl + 1 FROM z WHERE lvl < 10),
    zp AS (SELECT id, (ntile(8) OVER (ORDER BY key, id) - 1)::INTEGER AS part FROM z WHERE lvl = 10)"""


@query(f"{_Z} SELECT id, part FROM zp")
def zcurve_parts(spark, d):
    return geometric.z_curve(inputs.orders(spark, d), 8, 10, rotate=False)


@query(f"{_Z} SELECT part, sum(w)::BIGINT AS load, count(*) AS items FROM zp JOIN pts USING (id) GROUP BY part")
def zcurve_loads(spark, d):
    o = inputs.orders(spark, d)
    p = geometric.z_curve(o, 8, 10, rotate=False)
    return p.join(o, "id").groupBy("part").agg(F.sum("w").alias("load"), F.count(F.lit(1)).alias("items"))


def _scale(lo: str, hi: str, order: int, name: str) -> str:
    n = float(1 << order)
    step = lambda f: f"(CASE WHEN {n} <= ({hi} - {lo}) * {f} THEN nextafter({f}, 0.0::DOUBLE) ELSE {f} END)"
    f = f"({n} / nullif({hi} - {lo}, 0))"
    return f"coalesce({step(step(f))}, 0) AS {name}"


def _hilbert_sql(order: int) -> str:
    quad = "(2 * ((gx >> (lvl - 1)) & 1) + ((gy >> (lvl - 1)) & 1))"
    return f"""{_BOX.replace("WITH", "WITH RECURSIVE")}, f AS (SELECT *, {_scale('x0', 'x1', order, 'fx')}, {_scale('y0', 'y1', order, 'fy')} FROM b),
    g AS (SELECT id, w, CAST(trunc(fx * (x - x0)) AS BIGINT) AS gx, CAST(trunc(fy * (y - y0)) AS BIGINT) AS gy FROM pts, f),
    walk(id, w, gx, gy, h, s, lvl) AS (SELECT id, w, gx, gy, 0::BIGINT, 0, {order} FROM g UNION ALL
        SELECT id, w, gx, gy, h * 4 + substr('{curves._PLACE_2D}', (s * 4 + {quad} + 1)::INTEGER, 1)::INTEGER, substr('{curves._NEXT_2D}', (s * 4 + {quad} + 1)::INTEGER, 1)::INTEGER, lvl - 1 FROM walk WHERE lvl > 0),
    hx AS (SELECT id, w, h FROM walk WHERE lvl = 0)"""


@query(f"{_hilbert_sql(12)} SELECT id, h FROM hx")
def hilbert_index_2d(spark, d):
    return geometric.hilbert_index(inputs.orders(spark, d), 12, rotate=False)


_OCT = "(4 * ((gx >> (lvl - 1)) & 1) + 2 * ((gy >> (lvl - 1)) & 1) + ((gz >> (lvl - 1)) & 1))"


@query(f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM v),
    f AS (SELECT *, {_scale('x0', 'x1', 10, 'fx')}, {_scale('y0', 'y1', 10, 'fy')}, {_scale('z0', 'z1', 10, 'fz')} FROM b),
    g AS (SELECT id, CAST(trunc(fx * (x - x0)) AS BIGINT) AS gx, CAST(trunc(fy * (y - y0)) AS BIGINT) AS gy, CAST(trunc(fz * (z - z0)) AS BIGINT) AS gz FROM v, f),
    walk(id, gx, gy, gz, h, s, lvl) AS (SELECT id, gx, gy, gz, 0::BIGINT, 0, 10 FROM g UNION ALL
        SELECT id, gx, gy, gz, h * 8 + substr('{curves._PLACE_3D}', (s * 8 + {_OCT} + 1)::INTEGER, 1)::INTEGER, (strpos('0123456789ab', substr('{curves._NEXT_3D}', (s * 8 + {_OCT} + 1)::INTEGER, 1)) - 1)::INTEGER, lvl - 1 FROM walk WHERE lvl > 0)
    SELECT id, h FROM walk WHERE lvl = 0""")
def hilbert_index_3d(spark, d):
    return geometric.hilbert_index(inputs.vectors(spark, d), 10, rotate=False)


_CUTS = f"""{_hilbert_sql(12)}, per AS (SELECT h, sum(w) AS w FROM hx GROUP BY h), run AS (SELECT h, w, sum(w) OVER (ORDER BY h) AS cum, sum(w) OVER () AS total FROM per),
    cuts AS (SELECT i::INTEGER AS i, min(h) AS cut FROM run, (SELECT unnest(range(1, 8)) AS i) WHERE cum * 8 >= i * total GROUP BY i)"""


@query(f"{_CUTS} SELECT i, cut FROM cuts")
def weighted_quantile_cuts(spark, d):
    o = inputs.orders(spark, d)
    return geometric.weighted_cuts(geometric.hilbert_index(o, 12, rotate=False).join(o.select("id", "w"), "id"), 8)


@query(f"{_CUTS} SELECT id, (SELECT count(*) FROM cuts WHERE cut < h)::INTEGER AS part FROM hx")
def hilbert_parts(spark, d):
    o = inputs.orders(spark, d)
    return geometric.hilbert(o, o, 8, 12, rotate=False)


def _jagged_sql() -> str:
    levels = geometric.jagged_scheme(10, 2)
    sql, base = f"WITH {PTS}, l0 AS (SELECT *, 0 AS seg FROM pts)", "l0"
    for i, slabs in enumerate(levels):
        axis = "xy"[i % 2]
        rows, first = [], 0
        for s, parts in enumerate(slabs):
            done = 0
            rows += [f"({s}, {first}, {sum(parts)}, {sum(parts[:j])})" for j in range(1, len(parts))] or [f"({s}, {first}, {sum(parts)}, NULL)"]
            first += len(parts)
            del done
        sql += f""", r{i} AS (SELECT *, sum(w) OVER (PARTITION BY seg ORDER BY {axis}, id) AS cum, sum(w) OVER (PARTITION BY seg) AS total FROM {base}),
        t{i}(s, base, parts, e) AS (VALUES {', '.join(rows)}),
        l{i + 1} AS (SELECT id, any_value(x) AS x, any_value(y) AS y, any_value(w) AS w, (any_value(base) + count(*) FILTER (WHERE cum * parts > e * total))::INTEGER AS seg FROM r{i} JOIN t{i} ON s = seg GROUP BY id)"""
        base = f"l{i + 1}"
    return f"{sql} SELECT id, seg AS part FROM {base}"


@query(_jagged_sql())
def multi_jagged_parts(spark, d):
    o = inputs.orders(spark, d)
    return geometric.multi_jagged(o, o, 10, 2)


# --- recursive bisection


def _rcb_sql(levels: int, tol: float = 0.05) -> str:
    sql = f"WITH RECURSIVE {PTS}, s0 AS (SELECT id, x, y, w, 0 AS seg FROM pts), b0 AS (SELECT 0 AS seg, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts)"
    for i in range(levels):
        a = "xy"[i % 2]
        sql += f""", tot{i} AS (SELECT seg, sum(w)::DOUBLE AS total FROM s{i} GROUP BY seg),
        f{i}(seg, mn, mx, prev, done, split, step) AS (
            SELECT seg, {a}0, {a}1, -1::BIGINT, false, NULL::DOUBLE, 0 FROM b{i} JOIN tot{i} USING (seg)
            UNION ALL
            SELECT seg, CASE WHEN near IS NOT NULL AND NOT stop AND wl < total - wl THEN t ELSE mn END,
                   CASE WHEN near IS NULL AND cl <> prev THEN t WHEN near IS NOT NULL AND NOT stop AND NOT wl < total - wl THEN t ELSE mx END,
                   cl, (near IS NULL AND cl = prev) OR (near IS NOT NULL AND stop), CASE WHEN near IS NULL AND cl = prev THEN 'Infinity'::DOUBLE WHEN near IS NOT NULL AND stop THEN t END, step + 1
            FROM (SELECT *, cl = prev OR mx <= t + (near - t) OR abs((wl - total / 2) / (total / 2)) <= {tol} AS stop
                  FROM (SELECT f.seg, f.mn, f.mx, f.prev, f.step, (f.mn + f.mx) / 2 AS t, any_value(total) AS total,
                               count(*) FILTER (WHERE {a} < (f.mn + f.mx) / 2) AS cl, coalesce(sum(w) FILTER (WHERE {a} < (f.mn + f.mx) / 2), 0)::DOUBLE AS wl, min({a}) FILTER (WHERE {a} >= (f.mn + f.mx) / 2) AS near
                        FROM f{i} f JOIN s{i} s ON s.seg = f.seg JOIN tot{i} tt ON tt.seg = f.seg WHERE NOT f.done GROUP BY f.seg, f.mn, f.mx, f.prev, f.step))),
        c{i} AS (SELECT seg, split FROM f{i} WHERE done),
        s{i + 1} AS (SELECT id, x, y, w, CASE WHEN {a} < split THEN 2 * seg + 1 ELSE 2 * seg + 2 END AS seg FROM s{i} JOIN c{i} USING (seg)),
        b{i + 1} AS (SELECT 2 * seg + 1 AS seg, {'x0, split AS x1, y0, y1' if a == 'x' else 'x0, x1, y0, split AS y1'} FROM b{i} JOIN c{i} USING (seg)
                     UNION ALL SELECT 2 * seg + 2, {'split, x1, y0, y1' if a == 'x' else 'x0, x1, split, y1'} FROM b{i} JOIN c{i} USING (seg))"""
    return f"{sql} SELECT id, (seg - (SELECT min(seg) FROM s{levels}))::INTEGER AS part FROM s{levels}"


def _rcb(levels):
    def run(spark, d):
        o = inputs.orders(spark, d)
        return geometric.rcb(o, o, levels)

    run.__name__ = f"rcb_{levels}"
    return query(_rcb_sql(levels))(run)


for _levels in (1, 2, 3):
    _rcb(_levels)


@query("SELECT count(*) AS items, true AS all_once, true AS four_parts FROM orders")
def rib_parts(spark, d):
    o = inputs.orders(spark, d)
    p = geometric.rib(o, o, 2)
    return p.agg(F.count(F.lit(1)).alias("items"), (F.count_distinct("id") == F.count(F.lit(1))).alias("all_once"), ((F.count_distinct("part") == 4) & (F.max("part") == 3)).alias("four_parts"))


def _grid_sql(levels: int, sizes: list[int] = GRID) -> str:
    axes, at, stride = range(len(sizes)), [], 1
    for n in sizes:
        at.append(f"(id // {stride}) % {n}")
        stride *= n
    place = ", ".join(f"{p} AS x{j}" for j, p in enumerate(at))
    sql = f"WITH {CELLS}, s0 AS (SELECT id, w, {place}, 0 AS seg FROM (SELECT id, w FROM cell)), g0 AS (SELECT 0 AS seg, {', '.join(f'0 AS a{j}, {n} AS n{j}' for j, n in enumerate(sizes))})"
    xs = ", ".join(f"x{j}" for j in axes)
    for i in range(levels):
        k = (1 + i) % len(sizes)
        low = ", ".join(f"a{j}, " + (f"cut - a{j}" if j == k else f"n{j}") + f" AS n{j}" for j in axes)
        high = ", ".join(f"cut, a{j} + n{j} - cut" if j == k else f"a{j}, n{j}" for j in axes)
        sql += f""", m{i} AS (SELECT g.seg, p.p AS pos, g.a{k} AS start, coalesce(sum(s.w), 0) AS w FROM g{i} g JOIN (SELECT unnest(range({max(sizes)})) AS p) p ON p.p >= g.a{k} AND p.p < g.a{k} + g.n{k} LEFT JOIN s{i} s ON s.seg = g.seg AND s.x{k} = p.p GROUP BY 1, 2, 3),
        q{i} AS (SELECT seg, pos, coalesce(sum(w) OVER (PARTITION BY seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre, sum(w) OVER (PARTITION BY seg) AS total FROM m{i}),
        c{i} AS (SELECT seg, coalesce(min(pos) FILTER (WHERE pre BETWEEN trunc(total / 2.0::DOUBLE * (1 - 0.01::DOUBLE)) AND trunc(total / 2.0::DOUBLE * (1 + 0.01::DOUBLE))), max(pos) FILTER (WHERE pre < trunc(total / 2.0::DOUBLE * (1 - 0.01::DOUBLE))), min(pos)) AS cut FROM q{i} GROUP BY seg),
        s{i + 1} AS (SELECT id, w, {xs}, 2 * seg + CASE WHEN x{k} >= cut THEN 1 ELSE 0 END AS seg FROM s{i} JOIN c{i} USING (seg)),
        g{i + 1} AS (SELECT 2 * seg AS seg, {low} FROM g{i} JOIN c{i} USING (seg) UNION ALL SELECT 2 * seg + 1, {high} FROM g{i} JOIN c{i} USING (seg))"""
    return f"{sql} SELECT id, seg::INTEGER AS part FROM s{levels}"


@query(_grid_sql(3))
def grid_rcb_2d(spark, d):
    return grid.rcb(inputs.cells(spark, d), GRID, 3)


@query(_grid_sql(3, [10, 11, 5]))
def grid_rcb_3d(spark, d):
    return grid.rcb(inputs.cells(spark, d), [10, 11, 5], 3)


def _grid_edges_sql(sizes: list[int]) -> str:
    total, near, stride = 1, [], 1
    for n in sizes:
        at = f"(id // {stride}) % {n}"
        near += [f"SELECT id AS src, id - {stride} AS dst FROM c WHERE {at} > 0", f"SELECT id, id + {stride} FROM c WHERE {at} < {n - 1}"]
        stride *= n
        total *= n
    return f"WITH c AS (SELECT unnest(range({total})) AS id) SELECT src, dst, 1::BIGINT AS w FROM ({' UNION ALL '.join(near)})"


@query(_grid_edges_sql([50, 11]))
def grid_edges_2d(spark, d):
    return grid.edges(spark, [50, 11])


@query(_grid_edges_sql([10, 11, 5]))
def grid_edges_3d(spark, d):
    return grid.edges(spark, [10, 11, 5])


# --- metrics

_LOADS = f"WITH {PTS}, l AS (SELECT k::INTEGER AS part, coalesce(sum(w), 0)::BIGINT AS load FROM (SELECT unnest(range(8)) AS k) LEFT JOIN pts ON id % 8 = k GROUP BY k)"


@query(f"{_LOADS} SELECT part, load FROM l")
def part_loads(spark, d):
    return metrics.part_loads(*inputs.partitioned(spark, d, 8), 8)


@query(f"{_LOADS} SELECT round(max(load) / (sum(load) / 8) - 1, 9) AS imbalance FROM l")
def imbalance(spark, d):
    return metrics.imbalance(part_loads(spark, d)).select(F.round("imbalance", 9).alias("imbalance"))


@query(f"{_LOADS} SELECT max(load - (part + 1) * 1000)::BIGINT AS excess FROM l")
def imbalance_target(spark, d):
    targets = spark.range(8).select(F.col("id").cast("int").alias("part"), ((F.col("id") + 1) * 1000).alias("target"))
    return metrics.imbalance_target(part_loads(spark, d), targets)


@query(f"{_LOADS} SELECT (max(load) - min(load))::BIGINT AS spread FROM l")
def max_imbalance(spark, d):
    return metrics.max_imbalance(part_loads(spark, d))


@query(f"""WITH {PTS}, c AS (SELECT id % 8 AS part, 0 AS criterion, w AS v FROM pts UNION ALL SELECT id % 8, 1, 1 FROM pts),
    s AS (SELECT k AS part, criterion, coalesce((SELECT sum(v) FROM c WHERE c.part = k AND c.criterion = q.criterion), 0)::BIGINT AS load FROM (SELECT unnest(range(8)) AS k), (SELECT DISTINCT criterion FROM c) q)
    SELECT criterion, sum(load)::BIGINT AS total, round(greatest(0, max(load) / (sum(load) / 8) - 1), 9) AS imbalance, min(load) AS lightest, (SELECT count(*) FROM s t WHERE t.criterion = s.criterion AND t.load = min(s.load)) AS n_lightest,
        max(load) AS heaviest, (SELECT count(*) FROM s t WHERE t.criterion = s.criterion AND t.load = max(s.load)) AS n_heaviest FROM s GROUP BY criterion""")
def weight_stats(spark, d):
    p, w = inputs.partitioned(spark, d, 8)
    out = metrics.weight_stats(p, w.select("id", F.array(F.col("w"), F.lit(1).cast("bigint")).alias("w")), 8)
    return out.withColumn("imbalance", F.round("imbalance", 9))


@query("SELECT (10 - count(DISTINCT o_orderkey % 8))::BIGINT AS empty_parts FROM orders")
def empty_parts(spark, d):
    return metrics.empty_parts(inputs.partitioned(spark, d, 8)[0], 10)


_HALVES = f"WITH {EDGES}, {PARTS}"


def _by_id(spark, d, parts=4):
    return inputs.part_items(spark, d).select("id", (F.col("id") % parts).cast("int").alias("part"))


@query(f"{_HALVES} SELECT count(*) AS edge_cut FROM e WHERE dst < src AND src % 4 <> dst % 4")
def edge_cut(spark, d):
    return metrics.edge_cut(inputs.bought_together(spark, d), _by_id(spark, d))


_LAMBDA = f"{_HALVES}, n AS (SELECT src, count(DISTINCT q) - 1 AS extra FROM (SELECT src, dst % 4 AS q FROM e UNION ALL SELECT id, id % 4 FROM p) GROUP BY src)"


@query(f"{_LAMBDA} SELECT sum(extra)::BIGINT AS lambda_cut FROM n")
def lambda_cut(spark, d):
    items = inputs.part_items(spark, d)
    w = items.select("id", metrics.vertex_weight(F.array("w"), "uniform").alias("w"))
    return metrics.lambda_cut(inputs.bought_together(spark, d), _by_id(spark, d), w)


@query(f"{_LAMBDA} SELECT sum(extra * w)::BIGINT AS lambda_cut FROM n JOIN p ON src = id")
def lambda_cut_linear(spark, d):
    items = inputs.part_items(spark, d)
    w = items.select("id", metrics.vertex_weight(F.array("w"), "linear").cast("bigint").alias("w"))
    return metrics.lambda_cut(inputs.bought_together(spark, d), _by_id(spark, d), w)


def _edge_weights(mode, expr):
    def run(spark, d):
        e = graph.weigh_edges(inputs.bought_together(spark, d), inputs.part_items(spark, d), mode)
        return e.select("src", "dst", F.round("w", 6).alias("w"))

    run.__name__ = f"edge_weights_{mode}"
    return query(f"{_HALVES} SELECT src, dst, round({expr}, 6) AS w FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst")(run)


_edge_weights("uniform", "1.0::DOUBLE")
_edge_weights("linear", "(a.w + b.w)::DOUBLE")
_edge_weights("sqrt", "sqrt(a.w) + sqrt(b.w)")


# --- meshes


@query(f"WITH {MESH} SELECT el_id AS id, avg(x) AS cx, avg(y) AS cy FROM en JOIN node USING (node_id) GROUP BY el_id")
def mesh_barycentres(spark, d):
    b = mesh.barycentres(*inputs.mesh(spark, d))
    return b.select("id", F.col("coords")[0].alias("cx"), F.col("coords")[1].alias("cy"))


@query(f"WITH {MESH} SELECT src, dst, 1.0::DOUBLE AS w FROM dual")
def mesh_dual(spark, d):
    return graph.dual_graph(inputs.mesh(spark, d)[1])


@query(f"WITH {MESH} SELECT (SELECT count(*) FROM el) * 4 AS elements, {(2 * GRID[0] + 1) * (2 * GRID[1] + 1)}::BIGINT AS nodes, {float(GRID[0] * GRID[1])}::DOUBLE AS area, (SELECT sum(ref) * 4 FROM el)::BIGINT AS refs, (2 * {2 * GRID[0]} * {2 * GRID[1]} - {2 * GRID[0]} - {2 * GRID[1]})::BIGINT AS neighbours")
def mesh_refine(spark, d):
    n, e = mesh.refine(*inputs.mesh(spark, d))
    at = e.select("el_id", "ref", F.posexplode("nodes").alias("k", "node_id")).join(n.select("node_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")), "node_id")
    ring = at.groupBy("el_id", "ref").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    twice = F.aggregate(F.transform("p", lambda a, i: a["x"] * F.element_at("p", (i + 1) % 4 + 1)["y"] - F.element_at("p", (i + 1) % 4 + 1)["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    out = ring.agg(F.count(F.lit(1)).alias("elements"), F.sum(F.abs(twice) / 2).alias("area"), F.sum("ref").alias("refs"))
    near = graph.dual_graph(e).where("dst < src").agg(F.count(F.lit(1)).alias("neighbours"))
    return out.join(n.agg(F.count_distinct("node_id").alias("nodes")), how="cross").join(near, how="cross").select("elements", "nodes", "area", "refs", "neighbours")


@query(f"WITH {MESH}, k AS (SELECT unnest(range(5)) AS c) SELECT node_id + c * {(GRID[0] + 1) * (GRID[1] + 1)} AS node_id, x + (c % 3) * {GRID[0]} AS x, y + (c // 3) * {GRID[1]} AS y FROM node, k")
def mesh_duplicate(spark, d):
    n, _ = mesh.duplicate(*inputs.mesh(spark, d), 5)
    return n.select("node_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


@query(f"WITH {MESH} SELECT count(*) AS elements, {(GRID[0] + 1) * (GRID[1] + 1)}::BIGINT AS nodes, (SELECT count(*) FROM dual) AS adjacent, sum(ref)::BIGINT AS refs FROM el")
def mesh_reorder(spark, d):
    n, e = mesh.reorder(*inputs.mesh(spark, d), seed=3)
    out = e.agg(F.count(F.lit(1)).alias("elements"), F.sum("ref").alias("refs"))
    return out.join(n.agg(F.count_distinct("node_id").alias("nodes")), how="cross").join(graph.dual_graph(e).agg(F.count(F.lit(1)).alias("adjacent")), how="cross").select("elements", "nodes", "adjacent", "refs")


@query(f"WITH {MESH} SELECT el_id, el_id % 5 AS ref FROM el")
def apply_part(spark, d):
    e = inputs.mesh(spark, d)[1]
    return mesh.apply_part(e, e.select(F.col("el_id").alias("id"), (F.col("el_id") % 5).cast("int").alias("part"))).select("el_id", "ref")


@query(f"WITH {MESH} SELECT id AS el_id, w AS ref FROM cell")
def apply_weight(spark, d):
    return mesh.apply_weight(inputs.mesh(spark, d)[1], inputs.cells(spark, d)).select("el_id", "ref")


@query(f"WITH {MESH} SELECT el_id AS id, avg(x)::VARCHAR || ' ' || avg(y)::VARCHAR || ' ' || any_value(ref)::VARCHAR AS line FROM en JOIN node USING (node_id) JOIN el USING (el_id) GROUP BY el_id")
def mesh_points(spark, d):
    return mesh.mesh_points(*inputs.mesh(spark, d), with_ref=True)


@query(f"""WITH RECURSIVE {MESH}, same AS (SELECT src, dst FROM dual JOIN el a ON a.el_id = src JOIN el b ON b.el_id = dst WHERE a.ref = b.ref),
    reach(v, u) AS (SELECT el_id, el_id FROM el UNION SELECT reach.v, dst FROM reach JOIN same ON src = u)
    SELECT v AS el_id, any_value(ref) AS ref, min(u) AS blob FROM reach JOIN el ON el_id = v GROUP BY v""")
def blobs(spark, d):
    return mesh.blobs(inputs.mesh(spark, d)[1])


@query(f"WITH {MESH} SELECT el_id AS blob, ref, 1 AS rings, 4 AS corners FROM el")
def blob_frontiers(spark, d):
    n, e = inputs.mesh(spark, d)
    f = mesh.frontiers(n, e, e.select("el_id", F.col("el_id").alias("blob")))
    return f.select("blob", "ref", F.size("rings").alias("rings"), F.size(F.col("rings")[0]).alias("corners"))


# --- weights


@query("SELECT o_orderkey AS id, 2.5::DOUBLE AS w FROM orders")
def weights_constant(spark, d):
    return weights.constant(inputs.orders(spark, d), 2.5)


@query(f"{_BOX} SELECT id, round(100 / (x1 - x0) * (x - x0), 6) AS w FROM pts, b")
def weights_linear(spark, d):
    return weights.linear(inputs.orders(spark, d), 0, 0, 100).select("id", F.round("w", 6).alias("w"))


@query("SELECT vec_id AS id, round(exp(ln(1000.0) - sqrt(pow(embedding[1]::DOUBLE - 0.1, 2) + pow(embedding[2]::DOUBLE - 0.2, 2) + pow(embedding[3]::DOUBLE, 2))) + exp(ln(50.0) - sqrt(pow(embedding[1]::DOUBLE + 1, 2) + pow(embedding[2]::DOUBLE - 1, 2) + pow(embedding[3]::DOUBLE - 1, 2))), 6) AS w FROM embeddings")
def weights_spike(spark, d):
    return weights.spike(inputs.vectors(spark, d), [(1000.0, [0.1, 0.2, 0.0]), (50.0, [-1.0, 1.0, 1.0])]).select("id", F.round("w", 6).alias("w"))


@query(f"""WITH {PTS}, s AS (SELECT sum(w::DOUBLE) AS total, max(w)::DOUBLE AS hi, count(*) AS n FROM pts), t AS (SELECT *, (hi * 2147483647 + total - hi * n) / total AS top FROM s)
    SELECT id, trunc(w * ((top - 1) / hi) + 1)::BIGINT AS w FROM pts, t""")
def zoom_in(spark, d):
    return numeric.zoom_in(inputs.orders(spark, d).select("id", "w"))


@query(f"{_BOX} SELECT id, trunc(2.5)::BIGINT AS w0, trunc(100 / (x1 - x0) * (x - x0))::BIGINT AS w1 FROM pts, b")
def weights_criteria(spark, d):
    """Two criteria, truncated."""
    o = inputs.orders(spark, d)
    both = weights.combine([weights.constant(o, 2.5), weights.linear(o, 0, 0, 100)], integers=True)
    return both.select("id", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"))


@query(f"WITH {MESH} SELECT count(*) AS used FROM el")
def used_elements(spark, d):
    """Items of a mesh that also holds edges and vertices: the elements of the top dimension."""
    e = inputs.mesh(spark, d)[1]
    low = e.select("el_id", F.lit("edge").alias("type"), F.slice("nodes", 1, 2).alias("nodes"), "ref", F.lit(1).alias("block"))
    points = e.select("el_id", F.lit("vertex").alias("type"), F.slice("nodes", 1, 1).alias("nodes"), "ref", F.lit(2).alias("block"))
    return graph.used_elements(e.unionByName(low).unionByName(points)).agg(F.count(F.lit(1)).alias("used"))


# --- number partitioning


_SETS = "SELECT o_custkey AS set_id, count(*) AS items, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total, true AS ok FROM orders GROUP BY o_custkey"


def _sets(spark, d):
    o = inputs.table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("w"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS set_id, o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS w FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY w DESC, id DESC) AS n FROM o),
    run(set_id, n, id, part, loads) AS (SELECT DISTINCT set_id, 0::BIGINT, 0::BIGINT, 0, [0, 0, 0, 0]::BIGINT[] FROM o UNION ALL
        SELECT r.set_id, r.n, r.id, 4 - list_position(list_reverse(loads), list_min(loads))::INTEGER, list_transform(range(1, 5), lambda k: loads[k] + CASE WHEN k = 5 - list_position(list_reverse(loads), list_min(loads)) THEN r.w ELSE 0 END)
        FROM run JOIN r ON r.set_id = run.set_id AND r.n = run.n + 1)
    SELECT set_id, id, part FROM run WHERE n > 0""")
def greedy_parts(spark, d):
    return numbers.solve(_sets(spark, d), numbers.greedy(4), "set_id")


def _summed(sets, parts, ok, k):
    """(set_id, items, total, ok): ``ok`` is a condition on the loads of a set's k parts."""
    loads = sets.join(parts, ["set_id", "id"]).groupBy("set_id").agg(F.count(F.lit(1)).alias("items"), F.sum("w").alias("total"), F.max("w").alias("top"), F.array(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("w"))), F.lit(0)) for p in range(k)]).alias("loads"))
    return loads.select("set_id", "items", "total", ok.alias("ok"))



def _spread():
    return F.array_max("loads") - F.array_min("loads")


@query(_SETS)
def kk_2(spark, d):
    s = _sets(spark, d)
    return _summed(s, numbers.solve(s, numbers.karmarkar_karp(2), "set_id"), (_spread() <= F.col("top")) | (F.col("items") < 2), 2)


@query(_SETS)
def kk_k(spark, d):
    s = _sets(spark, d)
    return _summed(s, numbers.solve(s, numbers.karmarkar_karp(4), "set_id"), (_spread() <= F.col("top")) | (F.col("items") < 2), 4)


#: The least spread of a set's two parts, from all sums of one half of its items against the
#: nearest sums of the other half.
_LEAST_SPREAD = """WITH o AS (SELECT o_custkey AS set_id, CAST(round(o_totalprice * 100) AS BIGINT) AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    n AS (SELECT set_id, count(*) AS items, sum(w)::BIGINT AS total FROM o GROUP BY set_id),
    half AS (SELECT set_id, i % 2 AS side, list(w ORDER BY i) AS ws FROM o GROUP BY 1, 2 UNION ALL SELECT set_id, 0, [] FROM n WHERE items = 1),
    pick AS (SELECT set_id, side, ws, unnest(range(1 << len(ws))) AS m FROM half),
    s AS (SELECT set_id, side, coalesce(list_sum([CASE WHEN (m >> (k - 1)) & 1 = 1 THEN ws[k] ELSE 0 END FOR k IN range(1, len(ws) + 1)]), 0)::BIGINT AS s FROM pick),
    a AS (SELECT set_id, total - 2 * s AS t FROM s JOIN n USING (set_id) WHERE side = 1), b AS (SELECT set_id, 2 * s AS t FROM s WHERE side = 0),
    near AS (SELECT a.set_id, a.t - b.t AS d FROM a ASOF JOIN b ON a.set_id = b.set_id AND a.t >= b.t UNION ALL SELECT a.set_id, b.t - a.t FROM a ASOF JOIN b ON a.set_id = b.set_id AND a.t <= b.t),
    least AS (SELECT set_id, min(d) AS d FROM near GROUP BY set_id)"""


@query(f"{_LEAST_SPREAD} SELECT set_id, items, total, (items < 2 OR d * 1000 <= total) AS found FROM n JOIN least USING (set_id)")
def ckk(spark, d):
    """Sets that can be parted to within a thousandth of their sum: found by the search if and
    only if they are there."""
    s = _sets(spark, d)
    parts = numbers.solve(s, numbers.complete_karmarkar_karp(0.001, budget=5_000_000), "set_id", skip_failures=True)
    found = _summed(s, parts, (_spread() * 1000 <= F.col("total")) | (F.col("items") < 2), 2).select("set_id", "ok")
    every = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("items"), F.sum("w").alias("total"))
    return every.join(found, "set_id", "left").select("set_id", "items", "total", F.coalesce("ok", F.lit(False)).alias("found"))


def _improved(spark, d, kernel):
    s = _sets(spark, d)
    first = s.withColumn("part", (F.row_number().over(W.partitionBy("set_id").orderBy("id")) % 2).cast("int"))
    before = first.groupBy("set_id").agg(F.abs(F.sum(F.when(F.col("part") == 0, F.col("w")).otherwise(-F.col("w")))).alias("before"))
    out = _summed(s, numbers.solve(first, kernel, "set_id"), _spread(), 2)
    return out.join(before, "set_id").select("set_id", "items", "total", (F.col("ok") <= F.col("before")).alias("ok"))


@query(_SETS)
def vn_best(spark, d):
    return _improved(spark, d, numbers.vn_best)


@query(_SETS)
def vn_first(spark, d):
    return _improved(spark, d, numbers.vn_first)


@query("SELECT count(*) AS items, true AS spread_out, true AS in_range FROM orders")
def random_parts(spark, d):
    p = geometric.random_parts(inputs.orders(spark, d), 8, 1)
    each = p.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("items"), (F.max("n") < 1.5 * F.min("n")).alias("spread_out"), ((F.min("part") == 0) & (F.max("part") == 7)).alias("in_range"))


# --- graphs


def _grid_problem(spark, d):
    w = inputs.cells(spark, d)
    start = w.select("id", F.when(F.col("id") % GRID[0] < GRID[0] // 2, 0).otherwise(1).cast("int").alias("part"))
    return grid.edges(spark, GRID), w, start


_CELLS_OK = f"WITH {CELLS} SELECT count(*) AS items, sum(w)::BIGINT AS total, true AS cut_not_worse, true AS load_ok FROM cell"


def _refined(edges, w, start, end):
    """One row: the cut after is not above the cut before, the heavier part not above the limit."""
    cut = lambda p, n: metrics.edge_cut(edges, p).withColumnRenamed("edge_cut", n)
    top = lambda p, n: p.join(w, "id").groupBy("part").agg(F.sum("w").alias("l")).agg(F.max("l").alias(n))
    all_ = end.join(w, "id").agg(F.count(F.lit(1)).alias("items"), F.sum("w").alias("total"))
    one = all_.join(cut(start, "c0"), how="cross").join(cut(end, "c1"), how="cross").join(top(start, "t0"), how="cross").join(top(end, "t1"), how="cross")
    return one.select("items", "total", (F.col("c1") <= F.col("c0")).alias("cut_not_worse"), (F.col("t1") <= F.greatest(F.col("t0"), F.col("total") * 0.55)).alias("load_ok"))


@query(_CELLS_OK)
def arc_swap(spark, d):
    e, w, start = _grid_problem(spark, d)
    mixed = start.select("id", F.when(F.col("id") % 7 == 0, 1 - F.col("part")).otherwise(F.col("part")).cast("int").alias("part"))
    return _refined(e, w, mixed, graph.arc_swap(e, w, mixed, 0.1).partition)


@query(_CELLS_OK)
def fm(spark, d):
    e, w, start = _grid_problem(spark, d)
    return _refined(e, w, start, graph.fiduccia_mattheyses(e, w, start, max_imbalance=0.1, max_bad_moves=10))


@query(_CELLS_OK.replace("true AS load_ok", "true AS same_sizes"))
def kl(spark, d):
    e, w, start = _grid_problem(spark, d)
    end = graph.kernighan_lin(e, w, start, max_passes=2, max_flips_per_pass=40, max_bad_moves=5)
    sizes = start.agg(F.sum("part").alias("a")).join(end.agg(F.sum("part").alias("b")), how="cross").select((F.col("a") == F.col("b")).alias("same_sizes"))
    return _refined(e, w, start, end).drop("load_ok").join(sizes, how="cross")


@query("SELECT 550::BIGINT AS items, true AS all_once, true AS in_range")
def graph_growth(spark, d):
    p = graph.graph_growth(grid.edges(spark, GRID), inputs.cells(spark, d), 6)
    return p.agg(F.count(F.lit(1)).alias("items"), (F.count_distinct("id") == F.count(F.lit(1))).alias("all_once"), ((F.min("part") == 0) & (F.max("part") == 5) & (F.count_distinct("part") == 6)).alias("in_range"))


@query("SELECT count(*) AS items, true AS balanced, true AS all_parts FROM orders")
def kmeans_balanced(spark, d):
    """Balanced clusters: a grid of starts, loads that are brought within a tenth of the mean."""
    o = inputs.orders(spark, d).withColumn("w", F.lit(1).cast("bigint"))
    n = o.count()
    start = geometric.hilbert(o, o, 4, 12, rotate=False)
    tol = n / 4 * 0.1
    end = kmeans.kmeans(o, o, start, imbalance_tol=tol, max_iter=4, max_balance_iter=40).partition
    loads = end.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return loads.agg(F.sum("n").alias("items"), (F.max("n") - F.min("n") <= tol).alias("balanced"), (F.count(F.lit(1)) == 4).alias("all_parts"))


@query("SELECT count(*) AS items, true AS closer, true AS all_parts FROM embeddings")
def kmeans_parts(spark, d):
    """Clusters of the whole vectors; without balancing the spread inside them must shrink."""
    v = inputs.vectors(spark, d, 64)
    start = v.select("id", (F.col("id") % 4).cast("int").alias("part"))
    end = kmeans.kmeans(v, v, start, imbalance_tol=1e9, max_iter=5).partition

    def inside(p, name):
        j = v.join(p, "id").select("part", *[F.col("coords")[i].alias(f"c{i}") for i in range(64)])
        var = sum((F.var_pop(f"c{i}") for i in range(64)), F.lit(0.0))
        return j.groupBy("part").agg((var * F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("n")).agg(F.sum("v").alias(name), F.sum("n").alias(f"n{name}"), F.count(F.lit(1)).alias(f"k{name}"))

    both = inside(start, "a").join(inside(end, "b"), how="cross")
    return both.select(F.col("nb").alias("items"), (F.col("b") <= F.col("a")).alias("closer"), (F.col("kb") == 4).alias("all_parts"))


@query(f"WITH {PARTS} SELECT count(*) AS items, sum(w)::BIGINT AS total, true AS cut_not_worse, true AS load_ok FROM p")
def arc_swap_orders(spark, d):
    """The graph of parts that are bought together, in two parts."""
    e, w = shared.checkpoint(inputs.bought_together(spark, d)), inputs.part_items(spark, d)
    start = _by_id(spark, d, 2)
    return _refined(e, w, start, graph.arc_swap(e, w, start, 0.1).partition)


@query(f"WITH {EDGES} SELECT (SELECT count(*) FROM e) AS arcs, true AS sound, true AS loop_refused, true AS lone_refused")
def edge_checks(spark, d):
    """Checks of an edge table: the graph of orders passes; a loop and a lone arc don't."""
    e, w = inputs.both_ways(shared.checkpoint(inputs.bought_pairs(spark, d))), inputs.part_items(spark, d)

    def refused(edges) -> bool:
        try:
            graph.check_edges(edges, w)
        except FormatError:
            return True
        return False

    first = e.orderBy("src", "dst").limit(1)
    loop = e.unionByName(first.withColumn("dst", F.col("src")))
    lone = e.join(first.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "w")
    return e.agg(F.count(F.lit(1)).alias("arcs")).select("arcs", F.lit(not refused(e)).alias("sound"), F.lit(refused(loop)).alias("loop_refused"), F.lit(refused(lone)).alias("lone_refused"))


# --- files


def _mesh_file(ending: str, name: str):
    """The mesh written as a file and read again."""

    def run(spark, d):
        path = shared.new_path(spark, "mesh") + ending
        tables.write_mesh(*inputs.mesh(spark, d), path, name)
        n, e = tables.read_mesh(spark, path)
        at = e.select("el_id", "ref", "type", F.posexplode("nodes").alias("k", "node_id")).join(n.select("node_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")), "node_id")
        return at.select("el_id", "ref", "type", F.col("k").cast("bigint").alias("k"), "x", "y")

    run.__name__ = f"file_{name.replace('-', '_')}"
    return query(f"WITH {MESH}, c AS (SELECT el_id, ref, unnest(nodes) AS node_id, unnest([0, 1, 2, 3])::BIGINT AS k FROM el) SELECT el_id, ref, 'quadrilateral' AS type, k, x, y FROM c JOIN node USING (node_id)")(run)


for _ending, _name in ((".mesh", "mesh"), (".meshb", "meshb"), (".vtk", "vtk-ascii"), (".vtk", "vtk-binary")):
    _mesh_file(_ending, _name)


@query(f"WITH {PTS} SELECT row_number() OVER (ORDER BY id) - 1 AS id, w, id AS key FROM pts")
def file_weights(spark, d):
    """Two whole criteria, written and read again: a file keeps the order of ids, not the ids."""
    path = shared.new_path(spark, "weights") + ".weights"
    o = inputs.orders(spark, d)
    tables.write_weights(o.select("id", F.array("w", "id").alias("w")), path)
    tables.register(spark)
    back = spark.read.format("mewe").load(path)
    return back.select("id", F.col("w")[0].alias("w"), F.col("w")[1].alias("key"))


@query(f"WITH {PTS} SELECT row_number() OVER (ORDER BY id) - 1 AS id, (id % 8)::INTEGER AS part FROM pts")
def file_partition(spark, d):
    path = shared.new_path(spark, "partition") + ".part"
    tables.write_partition(inputs.partitioned(spark, d, 8)[0], path)
    tables.register(spark)
    return spark.read.format("mepe").load(path)


# --- chains and experiments


@query(_CELLS_OK)
def chain_rcb_arcswap(spark, d):
    e, w, _ = _grid_problem(spark, d)
    points = w.select("id", F.array(*[x.cast("double") for x in grid.position(F.col("id"), GRID)]).alias("coords"))
    problem = Problem(weights=w, points=points, edges=e)
    first = registry.run_chain(problem, ["rcb,1"]).partition
    return _refined(e, w, first, registry.run_chain(problem, ["rcb,1", "arcswap,0.1"]).partition)


@query(_CELLS_OK)
def chain_hilbert_fm(spark, d):
    e, w, _ = _grid_problem(spark, d)
    points = w.select("id", F.array(*[x.cast("double") for x in grid.position(F.col("id"), GRID)]).alias("coords"))
    problem = Problem(weights=w, points=points, edges=e)
    first = registry.run_chain(problem, ["hilbert,2"]).partition
    return _refined(e, w, first, registry.run_chain(problem, ["hilbert,2", "fm,0.1,5"]).partition)


@query("SELECT unnest(range(20)) AS iteration, true AS ok")
def num_part_experiment(spark, d):
    r = experiments.run(spark, "exp,0.5", 200, 20, numbers.karmarkar_karp(2), 2, seed=5)
    return r.select("iteration", ((F.col("imbalance") >= -1e-9) & (F.col("imbalance") < 0.01)).alias("ok"))


# --- reports


@query(f"""WITH {PTS}, l AS (SELECT id % 8 AS part, sum(w)::BIGINT AS load FROM pts GROUP BY 1)
    SELECT 8 AS parts, 0::BIGINT AS empty_parts, sum(load)::BIGINT AS total, min(load) AS lightest, max(load) AS heaviest FROM l""")
def part_info(spark, d):
    p, w = inputs.partitioned(spark, d, 8)
    return report.part_info(p, w, None, 8).select("parts", "empty_parts", "total", "lightest", "heaviest")


@query(f"""WITH {EDGES}, {PARTS}, l AS (SELECT id % 4 AS part, sum(w)::BIGINT AS load FROM p GROUP BY 1), n AS (SELECT src, count(DISTINCT q) - 1 AS extra FROM (SELECT src, dst % 4 AS q FROM e UNION ALL SELECT id, id % 4 FROM p) GROUP BY src)
    SELECT 4 AS parts, (SELECT max(load) FROM l) AS heaviest, (SELECT count(*) FROM e WHERE dst < src AND src % 4 <> dst % 4) AS edge_cut, (SELECT sum(extra * w)::DOUBLE FROM n JOIN p ON src = id) AS lambda_cut""")
def part_info_graph(spark, d):
    i = report.part_info(_by_id(spark, d), inputs.part_items(spark, d), inputs.bought_together(spark, d), 4)
    return i.select("parts", "heaviest", "edge_cut", "lambda_cut")


@query("SELECT chain, weights, true AS balanced FROM (SELECT unnest(['rcb,1', 'hilbert,2', 'zcurve,2']) AS chain), (SELECT unnest(['constant,1', 'linear,x,1,100']) AS weights)")
def quality_matrix(spark, d):
    cells = grid.cells(spark, [12, 10])
    points = cells.select("id", F.array(F.col("x0").cast("double"), F.col("x1").cast("double")).alias("coords"))
    q = report.quality(points, grid.edges(spark, [12, 10]), [["rcb,1"], ["hilbert,2"], ["zcurve,2"]], ["constant,1", "linear,x,1,100"])
    return q.select("chain", "weights", ((F.col("imbalance") < 0.9) & (F.col("edge_cut") > 0)).alias("balanced"))


@query("SELECT count(*) AS items, true AS all_inside FROM orders")
def oriented_box(spark, d):
    o = inputs.orders(spark, d)
    w = report.within(o, geometry.OrientedBox.of(o, 2))
    return w.agg(F.count(F.lit(1)).alias("items"), F.bool_and("inside").alias("all_inside"))
