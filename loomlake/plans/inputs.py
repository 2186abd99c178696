"""The driver's tables bound to the shapes that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import spread

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of fold results: dataset, method, max_splits, fold, score, arity, n."""
    size = F.when(F.col("o_custkey") % 3 == 0, 5).when(F.col("o_custkey") % 3 == 1, 10).otherwise(20)
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method"), size.alias("max_splits"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), "o_totalprice", "o_custkey"
    )
    g = o.groupBy("dataset", "method", "max_splits", "fold")
    return g.agg(F.round(F.avg("o_totalprice") / 600000, 6).alias("score"), F.round(F.avg(F.col("o_custkey") % 97), 6).alias("arity"), F.count(F.lit(1)).alias("n"))


#: The same in SQL.
RUNS = """runs AS (SELECT o_orderstatus AS dataset, o_orderpriority AS method,
    CASE o_custkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 20 END AS max_splits, CAST(o_orderkey % 5 AS INTEGER) AS fold,
    round(avg(o_totalprice) / 600000, 6) AS score, round(avg(o_custkey % 97), 6) AS arity, count(*) AS n
  FROM orders GROUP BY ALL)"""

#: Mean score and arity of each method at each size, and of each method, over all folds.
METHOD_MEANS = RUNS + ", means AS (SELECT dataset, method, round(avg(score), 6) AS score, round(avg(arity), 6) AS arity FROM runs GROUP BY ALL)"


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("dataset", "method").agg(F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("arity"), 6).alias("arity"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a table of features with a label and keys."""
    return table(spark, sf_dir, "lineitem").select(*KEYS, *FEATURES, F.col("l_returnflag").alias("label"))


def coded(spark: SparkSession, sf_dir: str, bins: int = 10) -> DataFrame:
    from ..operators.clean import equi_width

    return equi_width(matrix(spark, sf_dir), FEATURES, bins)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums in another order differ in their last digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def bin_sql(column: str, bins: int = 10) -> str:
    lo, hi = f"(SELECT min({column}) FROM lineitem)", f"(SELECT max({column}) FROM lineitem)"
    return f"CAST(least({bins - 1}, greatest(0, floor(({column} - {lo}) / ({hi} - {lo}) * {bins}))) AS INTEGER)"


CODES = "codes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS label, " + ", ".join(f"{bin_sql(c)} AS b{i}" for i, c in enumerate(FEATURES)) + " FROM lineitem)"
_CELLS = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, b{i} * 10 + b{j} AS code, label AS y FROM codes" for i in range(4) for j in range(i, 4))
MI = f"""{CODES}, cells AS (SELECT i, j, code, y, count(*) AS n FROM ({_CELLS}) GROUP BY ALL),
mi AS (SELECT i, j, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT i, j, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY i, j, code) AS DOUBLE) AS nx,
    CAST(sum(n) OVER (PARTITION BY i, j, y) AS DOUBLE) AS ny, CAST(sum(n) OVER (PARTITION BY i, j) AS DOUBLE) AS t FROM cells) GROUP BY i, j)"""
COI = MI + ", coi AS (SELECT m.i, m.j, a.mi + b.mi - m.mi AS coi FROM mi m JOIN mi a ON a.i = m.i AND a.j = m.i JOIN mi b ON b.i = m.j AND b.j = m.j WHERE m.i < m.j)"


def coi_of(codes: str, name: str) -> str:
    """The co-information of another table of codes, as a table of that name."""
    cells = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, b{i} * 10 + b{j} AS code, label AS y FROM {codes}" for i in range(4) for j in range(i, 4))
    return f"""{name}_cells AS (SELECT i, j, code, y, count(*) AS n FROM ({cells}) GROUP BY ALL),
{name}_mi AS (SELECT i, j, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT i, j, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY i, j, code) AS DOUBLE) AS nx,
    CAST(sum(n) OVER (PARTITION BY i, j, y) AS DOUBLE) AS ny, CAST(sum(n) OVER (PARTITION BY i, j) AS DOUBLE) AS t FROM {name}_cells) GROUP BY i, j),
{name} AS (SELECT m.i, m.j, a.mi + b.mi - m.mi AS coi FROM {name}_mi m JOIN {name}_mi a ON a.i = m.i AND a.j = m.i JOIN {name}_mi b ON b.i = m.j AND b.j = m.j WHERE m.i < m.j)"""


_EDGES = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e{i}" for i, c in enumerate(FEATURES))
#: Codes by quantile bins.
QUANTILE_CODES = f"quantile_codes AS (SELECT l_returnflag AS label, {', '.join(f'CAST(len(list_filter(e{i}[2:-2], lambda v: v <= {c})) AS INTEGER) AS b{i}' for i, c in enumerate(FEATURES))} FROM lineitem, (SELECT {_EDGES} FROM lineitem))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.information import co_information

    return co_information(coded(spark, sf_dir), FEATURES, "label", 10)
