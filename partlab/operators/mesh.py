"""Mesh transforms over nodes (node_id, coords, ref) and elements (el_id, type, nodes, ref, block)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .graph import dual_graph, used_elements
from .prefix import rank


def barycentres(nodes: DataFrame, elements: DataFrame, dimension: int | None = None) -> DataFrame:
    """(id, coords): the mean of each item element's nodes."""
    d = geometry.dimension(nodes)
    e = used_elements(elements, dimension).select(F.col("el_id").alias("id"), F.explode("nodes").alias("node_id"))
    at = e.join(nodes.select("node_id", *[geometry.coord(i).alias(f"c{i}") for i in range(d)]), "node_id")
    return at.groupBy("id").agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(d)]).select("id", F.array(*[F.col(f"c{i}") for i in range(d)]).alias("coords"))


def _next_id(rows: DataFrame, column: str) -> int:
    """1 + the largest id, 0 for no rows."""
    last = rows.agg(F.max(column)).first()[0]
    return 0 if last is None else last + 1


def duplicate(nodes: DataFrame, elements: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """``copies`` of a mesh side by side, on a grid with equal sides. Ids of copy i are moved by
    i times the number of ids (1 + the largest)."""
    spark = nodes.sparkSession
    d = geometry.dimension(nodes)
    side = math.ceil(copies ** (1 / max(d, 1)) - 1e-9)
    box = geometry.bounding_box(nodes, d).first()
    n_nodes, n_elements = _next_id(nodes, "node_id"), _next_id(elements, "el_id")
    copy = spark.range(copies).select(F.col("id").alias("copy"))  # a row a copy, asked for by the caller
    move = [(F.floor(F.col("copy") / side**i) % side) * F.lit(box["p_max"][i] - box["p_min"][i]) for i in range(d)] if copies and box["p_min"] else []
    shifted = F.array(*[geometry.coord(i) + m for i, m in enumerate(move)]) if move else F.col("coords")
    new_nodes = nodes.join(F.broadcast(copy)).select((F.col("node_id") + F.col("copy") * n_nodes).alias("node_id"), shifted.alias("coords"), "ref")
    new_elements = elements.join(F.broadcast(copy)).select((F.col("el_id") + F.col("copy") * n_elements).alias("el_id"), "type", F.transform("nodes", lambda v: v + F.col("copy") * n_nodes).alias("nodes"), "ref", "block")
    return new_nodes, new_elements


def refine(nodes: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every triangle or quadrilateral becomes four; vertices and edges are dropped.

    Middles of sides are shared: distinct (low, high) pairs of nodes get ids after the largest
    node id, in their order; then centres of quadrilaterals, by element.
    """
    d = geometry.dimension(nodes)
    flat = elements.where(F.col("type").isin("triangle", "quadrangle", "quadrilateral"))
    unknown = elements.where(~F.col("type").isin("vertex", "edge", "triangle", "quadrangle", "quadrilateral"))
    if not unknown.isEmpty():
        raise NotImplementedError("only triangles and quadrilaterals can be refined")
    n = F.size("nodes")
    side = lambda i, j: F.struct(F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi"))
    sides = F.transform("nodes", lambda v, i: side(v, F.element_at("nodes", F.when(i + 1 < n, i + 2).otherwise(1))))
    each = flat.select("el_id", F.posexplode(sides).alias("k", "s")).select("el_id", "k", "s.lo", "s.hi")
    first = _next_id(nodes, "node_id")
    middles = rank(each.select("lo", "hi").distinct(), ["lo", "hi"], out="r")
    middles = middles.select("lo", "hi", (F.col("r") + first).cast("bigint").alias("mid")).persist()
    at = nodes.select("node_id", "coords", "ref")
    ends = middles.join(at.select(F.col("node_id").alias("lo"), F.col("coords").alias("a"), F.col("ref").alias("ra")), "lo").join(at.select(F.col("node_id").alias("hi"), F.col("coords").alias("b"), F.col("ref").alias("rb")), "hi")
    half = F.zip_with("a", "b", lambda x, y: (x + y) / 2)
    middle_nodes = ends.select(F.col("mid").alias("node_id"), half.alias("coords"), ((F.col("ra") + F.col("rb")) / 2).cast("bigint").alias("ref"))
    own = each.join(middles, ["lo", "hi"]).groupBy("el_id").agg(F.sort_array(F.collect_list(F.struct("k", "mid"))).alias("m"))  # four a row at most
    marked = flat.join(own, "el_id").select("el_id", "type", "nodes", "ref", "block", F.transform("m", lambda x: x["mid"]).alias("m"))
    count = middles.count()
    quads = rank(marked.where(F.size("nodes") == 4).select("el_id"), ["el_id"], out="r").select("el_id", (F.col("r") + first + count).cast("bigint").alias("mm"))
    marked = marked.join(quads, "el_id", "left")
    centre = marked.where(F.size("nodes") == 4).select("mm", F.col("m")[0].alias("lo"), F.col("m")[2].alias("hi"))
    mids = middle_nodes.select("node_id", "coords", "ref")
    centres = centre.join(mids.select(F.col("node_id").alias("lo"), F.col("coords").alias("a"), F.col("ref").alias("ra")), "lo").join(mids.select(F.col("node_id").alias("hi"), F.col("coords").alias("b"), F.col("ref").alias("rb")), "hi")
    centre_nodes = centres.select(F.col("mm").alias("node_id"), half.alias("coords"), ((F.col("ra") + F.col("rb")) / 2).cast("bigint").alias("ref"))
    v, m = (lambda i: F.col("nodes")[i]), (lambda i: F.col("m")[i])
    tri = F.array(F.array(v(0), m(0), m(2)), F.array(v(1), m(0), m(1)), F.array(v(2), m(2), m(1)), F.array(m(0), m(2), m(1)))
    mm = F.col("mm")
    quad = F.array(F.array(v(0), m(0), mm, m(3)), F.array(v(1), m(1), mm, m(0)), F.array(v(2), m(2), mm, m(1)), F.array(v(3), m(3), mm, m(2)))
    children = F.when(F.size("nodes") == 3, tri).otherwise(quad)
    parts = marked.select("el_id", "type", "ref", "block", F.posexplode(children).alias("k", "nodes"))
    new_elements = parts.select((F.col("el_id") * 4 + F.col("k")).cast("bigint").alias("el_id"), "type", "nodes", "ref", "block")
    del d
    return nodes.select("node_id", "coords", "ref").unionByName(middle_nodes).unionByName(centre_nodes), new_elements


def reorder(nodes: DataFrame, elements: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same mesh with nodes, and the elements of each block, in a random order."""
    shuffled = nodes.withColumn("h", F.xxhash64(F.lit(seed), "node_id"))
    place = rank(shuffled.select("node_id", "h"), ["h", "node_id"], out="new").select("node_id", F.col("new").cast("bigint").alias("new"))
    new_nodes = nodes.join(place, "node_id").select(F.col("new").alias("node_id"), "coords", "ref")
    e = elements.withColumn("h", F.xxhash64(F.lit(seed + 1), "el_id"))
    e = rank(e, ["block", "h", "el_id"], out="at")
    ids = e.select("at", "type", "ref", "block", F.posexplode("nodes").alias("k", "node_id")).join(place, "node_id")
    back = ids.groupBy("at", "type", "ref", "block").agg(F.sort_array(F.collect_list(F.struct("k", "new"))).alias("n"))
    return new_nodes, back.select(F.col("at").cast("bigint").alias("el_id"), "type", F.transform("n", lambda x: x["new"]).alias("nodes"), "ref", "block")


def _with_ref(elements: DataFrame, items: DataFrame, value: Column) -> DataFrame:
    used = used_elements(elements).select("el_id", F.lit(True).alias("used"))
    new = items.select(F.col("id").alias("el_id"), value.cast("bigint").alias("new"))
    joined = elements.join(used, "el_id", "left").join(new, "el_id", "left")
    return joined.select("el_id", "type", "nodes", F.when(F.col("used") & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("ref")).alias("ref"), "block")


def apply_part(elements: DataFrame, partition: DataFrame) -> DataFrame:
    """Elements whose ref is their part."""
    return _with_ref(elements, partition, F.col("part"))


def apply_weight(elements: DataFrame, weights: DataFrame) -> DataFrame:
    """Elements whose ref is their first criterion, truncated."""
    w = F.col("w")[0] if weights.schema["w"].dataType.simpleString().startswith("array") else F.col("w")
    return _with_ref(elements, weights, w)


def mesh_points(nodes: DataFrame, elements: DataFrame, with_ref: bool = False) -> DataFrame:
    """(id, line): barycentres as text, coordinates and then the ref if asked for."""
    p = barycentres(nodes, elements)
    text = F.array_join(F.transform("coords", lambda c: c.cast("string")), " ")
    if not with_ref:
        return p.select("id", text.alias("line"))
    return p.join(elements.select(F.col("el_id").alias("id"), "ref"), "id").select("id", F.concat_ws(" ", text, F.col("ref").cast("string")).alias("line"))


def blobs(elements: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(el_id, ref, blob): connected elements of equal ref; a blob is named by its smallest
    element. Minimum labels with shortcuts: each round joins labels along edges and then jumps
    to the label's label, until nothing changes."""
    from .. import shared

    e = used_elements(elements)
    edges = dual_graph(elements) if edges is None else edges
    refs = e.select(F.col("el_id"), "ref")
    a, b = refs.select(F.col("el_id").alias("src"), F.col("ref").alias("ra")), refs.select(F.col("el_id").alias("dst"), F.col("ref").alias("rb"))
    same = shared.checkpoint(edges.select("src", "dst").join(a, "src").join(b, "dst").where("ra = rb").select("src", "dst"))
    label = shared.checkpoint(refs.select("el_id", "ref", F.col("el_id").alias("blob")))
    while True:
        near = same.join(label.select(F.col("el_id").alias("dst"), F.col("blob").alias("b")), "dst").groupBy("src").agg(F.min("b").alias("b"))
        step = label.join(near.withColumnRenamed("src", "el_id"), "el_id", "left").select("el_id", "ref", "blob", F.least("blob", F.coalesce("b", "blob")).alias("next"))
        jump = step.select(F.col("el_id").alias("next"), F.col("next").alias("far"))
        new = shared.checkpoint(step.join(jump, "next").select("el_id", "ref", "blob", F.least("next", "far").alias("next")))
        if new.where("blob != next").isEmpty():
            return label
        label = new.select("el_id", "ref", F.col("next").alias("blob"))


def frontiers(nodes: DataFrame, elements: DataFrame, blob: DataFrame) -> DataFrame:
    """(blob, ref, rings): the outline of each blob, rings of node coordinates without points on
    a straight line. One task traces a blob; its input is the blob's outer sides only."""
    n = F.size("nodes")
    side = F.transform("nodes", lambda v, i: F.struct(v.alias("a"), F.element_at("nodes", F.when(i + 1 < n, i + 2).otherwise(1)).alias("b")))
    each = elements.join(blob.select("el_id", "blob"), "el_id").select("blob", "ref", F.explode(side).alias("s")).select("blob", "ref", "s.a", "s.b")
    outer = each.groupBy("blob", "ref", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    at = nodes.select("node_id", geometry.coord(0).alias("x"), geometry.coord(1).alias("y"))
    ends = outer.join(at.toDF("lo", "xa", "ya"), "lo").join(at.toDF("hi", "xb", "yb"), "hi")

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        place = {}
        for r in pdf.sort_values(["lo", "hi"]).itertuples():
            near.setdefault(r.lo, []).append(r.hi)
            near.setdefault(r.hi, []).append(r.lo)
            place[r.lo], place[r.hi] = (r.xa, r.ya), (r.xb, r.yb)
        rings = []
        for first in sorted(near):
            while near[first]:
                ring, at = [first], near[first].pop()
                near[at].remove(first)
                while at != first:
                    ring.append(at)
                    nxt = near[at].pop()
                    near[nxt].remove(at)
                    at = nxt
                rings.append(_straightened([place[v] for v in ring]))
        return pd.DataFrame({"blob": [pdf["blob"].iloc[0]], "ref": [pdf["ref"].iloc[0]], "rings": [rings]})

    return ends.groupBy("blob", "ref").applyInPandas(trace, "blob bigint, ref bigint, rings array<array<array<double>>>")


def _straightened(ring: list[tuple[float, float]]) -> list[list[float]]:
    out = []
    for i, p in enumerate(ring):
        a, b = ring[i - 1], ring[(i + 1) % len(ring)]
        if abs((p[0] - a[0]) * (b[1] - p[1]) - (p[1] - a[1]) * (b[0] - p[0])) > 1e-12:
            out.append(list(p))
    return out
