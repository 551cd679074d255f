"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from partlab.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "orders lineitem part embeddings".split()


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - {"blobs", "graph_growth", "arc_swap", "chain_rcb_arcswap", "chain_hilbert_fm"}))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert got == want
