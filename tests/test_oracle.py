"""Every registered query with SQL gives what DuckDB gives."""

import decimal
import math

import duckdb
import pytest

from orrery.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(data, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), columns)


def test_mixed_level_of_customers_without_orders(spark, tmp_path):
    """Customers without orders aren't in the join; a null price is no price."""
    customers = [(1, 2.0), (2, 4.0), (3, 0.0), (4, None), (5, -3.0), (6, 1.0), (None, 5.0)]
    orders = [(1, 10.0), (1, None), (3, 7.0), (4, 7.0), (5, None), (6, 0.0), (None, 9.0), (9, 1.0)]
    c, o = "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame([(k, "c", 1, b, "m") for k, b in customers], c).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, k, "O", p, None, "1") for i, (k, p) in enumerate(orders)], o).write.parquet(f"{tmp_path}/orders.parquet")
    found = duckdb.connect()
    for t in ("customer", "orders"):
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["mixed_level"](spark, str(tmp_path))
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert got == rows(found.execute(SQL["mixed_level"]).fetchall(), df.columns) == [(1, 5.0), (5, None), (6, 0.0)]
