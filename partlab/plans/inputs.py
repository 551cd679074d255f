"""The driver's tables as points, weights, graphs, grids and meshes, in DataFrames and in the
SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid

GRID = [50, 11]
#: Line items of a task that joins orders with themselves, about.
LINES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, coords, w): price and day as coordinates, cents as whole weights."""
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("double")
    return o.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice"), day).alias("coords"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("w"))


PTS = """pts AS (SELECT o_orderkey AS id, o_totalprice AS x, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y,
    CAST(round(o_totalprice * 100) AS BIGINT) AS w FROM orders)"""


def partitioned(spark: SparkSession, sf_dir: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """(partition, weights) of the orders: part = id modulo parts."""
    o = orders(spark, sf_dir)
    return o.select("id", (F.col("id") % parts).cast("int").alias("part")), o.select("id", "w")


def vectors(spark: SparkSession, sf_dir: str, d: int = 3) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.array(*[F.col("embedding")[i].cast("double") for i in range(d)]).alias("coords"), F.lit(1).cast("bigint").alias("w"))


def bought_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts that an order has both of, the smaller id as src. Tasks are as many as
    the line items ask for, whatever the session's number, so that none grows with the table;
    pairs are dealt out before they are made distinct, so that a task holds only its share."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES + 1)
    line = lines.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").distinct()
    other = line.select("l_orderkey", F.col("l_partkey").alias("dst"))
    pairs = line.join(other, "l_orderkey").where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst")
    return pairs.repartition(tasks, "src", "dst").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """(src, dst, w = 1): every pair in both directions."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return pairs.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("e")).select("e.src", "e.dst", F.lit(1).cast("bigint").alias("w"))


def bought_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w = 1): parts that an order has both of, in both directions."""
    return both_ways(bought_pairs(spark, sf_dir))


EDGES = """line AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
    e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM line a JOIN line b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey)"""


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, w): the parts, cents of the retail price as weight."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("w"))


PARTS = "p AS (SELECT p_partkey AS id, CAST(round(p_retailprice * 100) AS BIGINT) AS w FROM part)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, w): line items counted on the grid of quantity by discount."""
    line = table(spark, sf_dir, "lineitem")
    at = (F.col("l_quantity").cast("bigint") - 1) + F.round(F.col("l_discount") * 100).cast("bigint") * GRID[0]
    seen = line.groupBy(at.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(GRID[0] * GRID[1]).join(seen, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("w"))


CELLS = f"""seen AS (SELECT CAST(l_quantity AS BIGINT) - 1 + CAST(round(l_discount * 100) AS BIGINT) * {GRID[0]} AS id, count(*) AS n FROM lineitem GROUP BY 1),
    cell AS (SELECT r.id, coalesce(n, 0)::BIGINT AS w, r.id % {GRID[0]} AS x0, r.id // {GRID[0]} AS x1 FROM (SELECT unnest(range({GRID[0] * GRID[1]})) AS id) r LEFT JOIN seen USING (id))"""


def mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements): a quadrilateral for each cell of the grid; its ref is the cell's count
    in thousands of the table's share."""
    nx, ny = GRID
    n = grid.cells(spark, [nx + 1, ny + 1])
    nodes = n.select(F.col("id").alias("node_id"), F.array(F.col("x0").cast("double"), F.col("x1").cast("double")).alias("coords"), F.lit(0).cast("bigint").alias("ref"))
    c = cells(spark, sf_dir).select("id", "w", *[p.alias(f"x{i}") for i, p in enumerate(grid.position(F.col("id"), GRID))])
    a = F.col("x0") + F.col("x1") * (nx + 1)
    corners = F.array(a, a + 1, a + nx + 2, a + nx + 1)
    elements = c.select(F.col("id").alias("el_id"), F.lit("quadrilateral").alias("type"), corners.alias("nodes"), (F.col("w") % 3).alias("ref"), F.lit(0).alias("block"))
    return nodes, elements


MESH = f"""{CELLS},
    node AS (SELECT id AS node_id, (id % {GRID[0] + 1})::DOUBLE AS x, (id // {GRID[0] + 1})::DOUBLE AS y FROM (SELECT unnest(range({(GRID[0] + 1) * (GRID[1] + 1)})) AS id)),
    el AS (SELECT id AS el_id, w % 3 AS ref, x0 + x1 * {GRID[0] + 1} AS a, [x0 + x1 * {GRID[0] + 1}, x0 + x1 * {GRID[0] + 1} + 1, x0 + x1 * {GRID[0] + 1} + {GRID[0] + 2}, x0 + x1 * {GRID[0] + 1} + {GRID[0] + 1}] AS nodes FROM cell),
    en AS (SELECT el_id, unnest(nodes) AS node_id FROM el),
    dual AS (SELECT a.el_id AS src, b.el_id AS dst FROM en a JOIN en b USING (node_id) WHERE a.el_id <> b.el_id GROUP BY 1, 2 HAVING count(*) >= 2)"""
