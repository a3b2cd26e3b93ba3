"""Every registered query of the findings engine against its SQL."""

import duckdb
import pytest

from sightline import plans

from .compare import assert_same, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLE_SQL:
        assert_same(df, con, plans.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_digest_of_large_scans(spark, tmp_path):
    """A scan of 4,200 findings has two nodes on the last level of the SQL's tree."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CASE WHEN k < 4200 THEN k * 1500 ELSE k * 1500 + 1 + k % 2 END AS o_orderkey, k % 97 AS o_custkey, k * 1.5 AS o_totalprice
    FROM range(4210) t(k)) TO '{tmp_path}/orders.parquet'""")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    sql = plans.ORACLE_SQL["a16_digest"]
    assert len(con.execute(sql).fetchall()) == 4
    assert_same(plans.QUERIES["a16_digest"](spark, str(tmp_path)), con, sql)
