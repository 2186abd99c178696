"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import math

import duckdb
import pytest

from loomlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return float(f"{float(v):.5g}") if isinstance(v, (int, float)) or hasattr(v, "__float__") else v


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["A22_silhouette", "G11_graph_report", "M14_complexity", "ST10_bayesian_signed_rank", "S6_planted_table"])
def test_runs_without_sql(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
