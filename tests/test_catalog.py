"""Every query with SQL against DuckDB; the others give rows."""

import duckdb
import pytest

from netloom import catalog
from netloom.operators import neighbors

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, db, name):
    p, o = catalog.queries()[name](spark, SF).toPandas(), db.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(p)
    assert cols == sorted(o)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (p, o))
    assert len(a) == len(b) > 0
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert not catalog.queries()[name](spark, SF).isEmpty()


@pytest.mark.parametrize("size", ("sf0.01", "sf0.1"))
def test_indirect_neighbours_have_recall(spark, size):
    rows = catalog.emb(spark, f"/root/testdata/{size}")
    exact = {(r.i, r.j) for r in neighbors.nearest_rows(rows, 10, "cosim").collect()}
    found = {(r.i, r.j) for r in neighbors.approximate_rows(rows, 10).select("i", "j").collect()}
    print(size, len(found & exact) / len(exact))
    assert len(found & exact) >= 0.9 * len(exact)
