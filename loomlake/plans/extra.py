"""Queries of mixed estimators, range joins, cluster counts, beams, sums of trees, baselines and planted tables."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from ..functions.shared import new_path
from ..operators import clean as C
from ..operators import graph as G
from ..operators import information as I
from ..operators import linalg as L
from ..operators import trees as T
from ..operators.metrics import r_squared
from ..sources import nested as N
from ..sources import synthetic
from .inputs import COI, FEATURES, KEYS, MI, QUANTILE_CODES, coded, coi_of, edges, matrix, rounded, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("A10_mixed_co_information", f"WITH {MI}, {QUANTILE_CODES}, {coi_of('quantile_codes', 'other')} SELECT q.i, q.j, round(a.mi + b.mi - q.mi, 6) AS coi FROM other_mi q JOIN mi a ON a.i = q.i AND a.j = q.i JOIN mi b ON b.i = q.j AND b.j = q.j WHERE q.i < q.j")
def a10(spark, d):
    own = I.pair_information(coded(spark, d), FEATURES, "label", 10).where("i = j")
    joint = I.pair_information(C.quantile_bins(matrix(spark, d), FEATURES, 10), FEATURES, "label", 10)
    return rounded(I.mixed_co_information(own, joint), "coi")


def _subsample_edges(spark, d, seed):
    return I.co_information(C.uniform_sample(coded(spark, d), KEYS[:3], 2000, seed), FEATURES, "label", 10)


@query("A14_subsample_clusters")
def a14(spark, d):
    part = C.stratified_sample(coded(spark, d), "label", KEYS, 2000)
    some = [G.dense(e, len(FEATURES)) for e in (edges(spark, d), I.co_information(part, FEATURES, "label", 10))]
    return rounded(spark.createDataFrame([(L.rand_index(*(L.signed_clusters(w, 2) for w in some)),)], "ari double"), "ari")


@query("A15_seed_clusters")
def a15(spark, d):
    labels = [L.signed_clusters(G.dense(_subsample_edges(spark, d, s), len(FEATURES)), 2) for s in (1, 2, 3)]
    found = [L.rand_index(labels[a], labels[b]) for a in range(3) for b in range(a + 1, 3)]
    return rounded(spark.createDataFrame([(float(np.mean(found)),)], "mean_ari double"), "mean_ari")


@query("A33_validate_variant")
def a33(spark, d):
    return rounded(synthetic.validate_variant(synthetic.variant(spark, "easy_2mod_xor"), "easy_2mod_xor"), "value")


@query("S6_variants", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v.features}, CAST({v.rows} AS BIGINT), true)" for k, v in synthetic.VARIANTS.items()) + ") t(variant, n_features, n, balanced)")
def s6(spark, d):
    out = None
    for name, v in synthetic.VARIANTS.items():
        one = synthetic.variant(spark, name).agg(F.lit(name).alias("variant"), F.lit(v.features).alias("n_features"), F.count(F.lit(1)).alias("n"), F.avg("output").between(0.35, 0.65).alias("balanced"))
        out = one if out is None else out.unionByName(one)
    return out


@query("G9_choose_k_near")
def g9(spark, d):
    w = G.dense(edges(spark, d), len(FEATURES))
    values, vectors = np.linalg.eigh(L.SignedGraph.laplacian(np.abs(w), True))
    k, label = L.choose_k_near(values, vectors, len(w) - 1)
    return spark.createDataFrame([(i, int(x), k) for i, x in enumerate(label)], "node int, label int, k int")


@query("G10_k_strategies")
def g10(spark, d):
    found = L.k_strategies(G.dense(edges(spark, d), len(FEATURES)), 2)
    return spark.createDataFrame(sorted(found.items()), "strategy string, k int")


@query("G16_shifted_edges", f"WITH {COI}, m AS (SELECT quantile_cont(coi, 0.25) AS l FROM coi) SELECT i, j, round(coi - l, 6) AS coi FROM coi, m")
def g16s(spark, d):
    return rounded(G.inject_edges(edges(spark, d), "shift"), "coi")


@query("G16_known_edges", f"WITH {COI} SELECT i, j, round(CASE WHEN i = 0 AND j = 1 THEN abs(coi) ELSE coi END, 6) AS coi FROM coi")
def g16k(spark, d):
    return rounded(G.inject_edges(edges(spark, d), "known", known=spark.createDataFrame([(0, 1)], "i int, j int")), "coi")


@query("G18_high_dim_fixes")
def g18(spark, d):
    w = G.dense(edges(spark, d), len(FEATURES))
    return rounded(spark.createDataFrame(L.high_dim_fixes(w, L.spectral(w, 2), 2), "fix string, setting double, ari double"), "setting", "ari")


@query("J13_range_counts", "WITH p AS (SELECT s_suppkey, s_acctbal AS x, s_nationkey * 100.0 AS y, 200.0 + s_suppkey % 5 * 50 AS r FROM supplier) SELECT a.s_suppkey, count(*) - 1 AS n FROM p a JOIN p b ON abs(a.x - b.x) < a.r AND abs(a.y - b.y) < a.r GROUP BY 1")
def j13(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"), (200.0 + F.col("s_suppkey") % 5 * 50).alias("r"))
    return I.range_counts(p, "s_suppkey", ("x", "y"), "r", 400.0)


def _binary(spark, d):
    return matrix(spark, d).withColumn("y", (F.col("label") == "R").cast("double"))


@query("M7_beam_subsets")
def m7(spark, d):
    e = {(FEATURES[r["i"]], FEATURES[r["j"]]): r["coi"] for r in edges(spark, d).collect()}  # pairs of features
    rows = [(beam, list(s)) for beam in (2, 3, 4) for s in T.beam_subsets(FEATURES, [FEATURES[:3]], beam, 3, e)]
    return spark.createDataFrame(rows, "beam int, features array<string>")


def _sum_r2(df, models):
    return rounded(r_squared(df.withColumn("p", T.predict_sum(models)).withColumn("all", F.lit(1)), "y", "p", ["all"]), "r2")


@query("M9_tree_sum_late_roots")
def m9(spark, d):
    train = _binary(spark, d)
    df = C.scale(train, train, FEATURES)
    return _sum_r2(df, T.grow_sum(df, T.candidates_for(FEATURES, "axis"), "y", 3, depth=6, late_roots=3))


@query("M17_axis_sum")
def m17(spark, d):
    df = _binary(spark, d)
    models = T.grow_sum(df, T.candidates_for(FEATURES, "axis"), "y", 3)
    rows = [(m, int(x.node), len(x.features)) for m, model in enumerate(models) for x in model.nodes.values()]
    return spark.createDataFrame(rows, "tree int, node int, arity int").groupBy("tree").agg(F.count_if(F.col("arity") > 0).alias("splits"), F.max("arity").alias("max_arity"))


@query("M13_probabilities")
def m13(spark, d):
    df, classes = _binary(spark, d), ["A", "N", "R"]
    p = T.softmax(T.one_vs_rest_scores(df, T.candidates_for(FEATURES, "axis"), "label", classes, 6))
    shares = df.select("label", *[x.alias(f"p_{c}") for c, x in zip(classes, p, strict=True)])
    return rounded(shares.groupBy("label").agg(*[F.avg(f"p_{c}").alias(f"p_{c}") for c in classes]), *[f"p_{c}" for c in classes])


@query("M16_baseline_logistic")
def m16l(spark, d):
    df = _binary(spark, d)
    p = T.baseline(df, FEATURES, "y", "logistic").transform(df)
    return p.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 4).alias("recall"))


@query("M16_baseline_forest")
def m16f(spark, d):
    df = _binary(spark, d)
    p = T.baseline(df, FEATURES, "y", "forest").transform(df)
    return p.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 4).alias("recall"))


@query("S8_examples_of_dataset", "SELECT c_custkey AS metadata_row_index, c_mktsegment AS dataset FROM customer WHERE c_mktsegment = 'BUILDING'")
def s8(spark, d):
    path, c = new_path(spark, "examples"), table(spark, d, "customer")
    example = F.struct(
        F.lit("{}").alias("input"), F.lit("").alias("output"), F.lit(0).alias("metadata_fold"), F.lit("regression").alias("metadata_task_type"), F.lit("tpc").alias("metadata_source"), F.col("c_custkey").alias("metadata_row_index"), F.lit(5).alias("metadata_n_classes")
    )
    sets = c.groupBy("c_mktsegment").agg(F.collect_list(example).alias("examples")).select(F.array(F.struct(F.col("c_mktsegment").alias("dataset"), "examples")).alias("datasets"))
    sets.write.option("maxRecordsPerFile", 1).json(path)  # a document is a part
    every = N.read_examples(spark, path)
    parts = every.select("dataset", "part").distinct().where("dataset = 'BUILDING'")  # where the dataset lies
    return every.join(F.broadcast(parts), ["dataset", "part"], "left_semi").select("metadata_row_index", "dataset")


#: Each status is larger than a part but the last one, which has its own.
_BYTES = """length('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}') + 1"""


@query(
    "S10_byte_parts",
    f"WITH z AS (SELECT o_orderstatus AS d, count(*) AS n, sum({_BYTES}) AS size FROM orders GROUP BY 1), c AS (SELECT *, CASE WHEN 50 + size < 40000 THEN n ELSE greatest(1, n // (size // 40000 + 1)) END AS chunk FROM z), f AS (SELECT *, coalesce(sum(ceil(n / chunk)) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c) SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(first + (row_number() OVER (PARTITION BY d ORDER BY o_orderkey) - 1) // chunk AS INTEGER) AS part FROM orders JOIN f ON d = o_orderstatus",
)
def s10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return N.byte_parts(o, "o_orderstatus", ["o_orderkey"], 40_000)
