import duckdb
import numpy as np
import pytest

from facetflow.operators import cluster, raster
from facetflow.plans import graphs, index, relational

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("plans", [relational, graphs, index])
def test_queries_agree_with_sql(spark, plans):
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)
    for name, sql in plans.ORACLE_SQL.items():
        got = plans.QUERIES[name](spark, FOLDER)
        columns = sorted(got.columns)
        plain = lambda row: str(tuple(round(v, 9) if isinstance(v, float) else v for v in row))
        rows = sorted(plain(r[c] for c in columns) for r in got.collect())
        want = con.execute(f"select {', '.join(columns)} from ({sql}) t").fetchall()
        assert rows and rows == sorted(map(plain, want)), name


def test_kmeans_agrees_with_the_one_in_memory(spark):
    values = np.random.default_rng(1).normal(0, 50, 400).round(1)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "value double")
    for k in (1, 2, 7):
        assert np.allclose(cluster.kmeans_1d(rows, "value", k), raster.kmeans_1d(values, np.ones(400), k))
    assert cluster.kmeans_1d(rows.limit(0), "value", 3) == []


def test_queries_without_sql(spark):
    assert index.kmeans_centres(spark, FOLDER).count() == 5
    got = index.edit_fold(spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey").union(spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey")).distinct().count()
