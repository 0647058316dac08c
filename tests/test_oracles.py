"""Every graph query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from evograph.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "dist"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    spark.catalog.clearCache()


def test_queries_read_the_graph_of_all_orders(spark, duck):
    assert not [n for n, sql in ORACLE_SQL.items() if "l_orderkey %" in sql]
    want = duck.execute(f"SELECT count(*) FROM ({ORACLE_SQL['g_dense']})").fetchone()[0]
    assert QUERIES["count_edges"](spark, SF).first()["n_edges"] == want


def test_compare_ranks_on_more_vertices(spark):
    """Some of these ranks end with their fourth decimal, none of the smallest tables' does."""
    more, c = SF.replace("0.001", "0.01"), duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{more}/lineitem.parquet'")
    assert tuple(QUERIES["compare_ranks"](spark, more).first()) == c.execute(ORACLE_SQL["compare_ranks"]).fetchone()
