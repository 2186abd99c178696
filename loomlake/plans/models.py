"""Queries of graph, tree and source operators, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import new_path
from ..operators import graph as G
from ..operators import linalg as L
from ..operators import trees as T
from ..operators.metrics import r_squared
from ..sources import nested as N
from ..sources import synthetic
from .inputs import COI, FEATURES, RUNS, edges, matrix, rounded, runs, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def nodes(spark):
    return spark.range(len(FEATURES)).select(F.col("id").cast("int").alias("node"))


BOTH = COI + ", sym AS (SELECT i, j, coi AS w FROM coi UNION ALL SELECT j, i, coi FROM coi)"


@query("G1_degrees", f"WITH {BOTH} SELECT i AS node, round(sum(greatest(w, 0)), 6) AS d_pos, round(sum(greatest(-w, 0)), 6) AS d_neg, round(sum(abs(w)), 6) AS d_abs FROM sym GROUP BY 1")
def g1(spark, d):
    return rounded(G.degrees(edges(spark, d)), "d_pos", "d_neg", "d_abs")


@query("G1_laplacians", f"WITH {BOTH} SELECT i, j, round(-greatest(w, 0), 6) + 0 AS l_pos, round(-greatest(-w, 0), 6) + 0 AS l_neg, round(-abs(w), 6) AS l_abs, round(-w, 6) AS l_signed FROM sym UNION ALL SELECT i, i, round(sum(greatest(w, 0)), 6), round(sum(greatest(-w, 0)), 6), round(sum(abs(w)), 6), round(sum(abs(w)), 6) FROM sym GROUP BY i")
def g1l(spark, d):
    out = rounded(G.laplacians(edges(spark, d)), "l_pos", "l_neg", "l_abs", "l_signed")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("l_pos", "l_neg")})


@query("G6_strong_components", f"WITH RECURSIVE {COI}, cut AS (SELECT quantile_cont(abs(coi), 0.6) AS c FROM coi WHERE coi <> 0), e AS (SELECT i, j FROM coi, cut WHERE abs(coi) >= c UNION SELECT j, i FROM coi, cut WHERE abs(coi) >= c), r(node, label) AS (SELECT CAST(n AS INTEGER), CAST(n AS INTEGER) FROM (SELECT unnest(range(0, 4)) AS n) UNION SELECT CAST(e.j AS INTEGER), r.label FROM r JOIN e ON e.i = r.node) SELECT node, min(label) AS label FROM r GROUP BY 1")
def g6(spark, d):
    return G.strong_components(edges(spark, d), nodes(spark), 0.6)


@query("G7_random_labels", "SELECT CAST(n AS INTEGER) AS node, CAST(CAST('0x' || left(md5('42|' || n), 8) AS BIGINT) % 3 AS INTEGER) AS label FROM (SELECT unnest(range(0, 4)) AS n)")
def g7(spark, d):
    return G.random_labels(nodes(spark), 3)


@query("G15_disagreement", "SELECT n_nationkey AS node, n_nationkey % 5 <> n_regionkey AS differs FROM nation")
def g15(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "node")
    return G.disagreement(n.select("node", (F.col("node") % 5).alias("label")), n.select("node", F.col("n_regionkey").alias("label")))


@query("G16_inject_edges", f"WITH {COI}, m AS (SELECT quantile_cont(coi, 0.5) AS l FROM coi) SELECT i, j, round(CASE WHEN coi > l THEN abs(coi) ELSE coi END, 6) AS coi FROM coi, m")
def g16(spark, d):
    return rounded(G.inject_edges(edges(spark, d), "median"), "coi")


@query("G19_modules", "SELECT n_regionkey AS label, list_sort(list(n_nationkey)) AS features FROM nation GROUP BY 1 HAVING count(*) >= 2")
def g19(spark, d):
    return G.modules_of(table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("label")))


@query("G20_truth_labels", "SELECT n_nationkey AS node, CAST(CASE WHEN n_nationkey < 15 THEN n_regionkey ELSE -1 END AS INTEGER) AS label FROM nation")
def g20(spark, d):
    n = table(spark, d, "nation")
    modules = n.where("n_nationkey < 15").groupBy(F.col("n_regionkey").alias("module")).agg(F.collect_list("n_nationkey").alias("features"))
    return G.truth_labels(n.select(F.col("n_nationkey").alias("node")), modules, noise="none")


@query("G21_degenerate", f"WITH {COI} SELECT avg(CASE WHEN coi > 0 THEN 1.0 ELSE 0.0 END) AS frac_pos, avg(CASE WHEN coi > 0 THEN 1.0 ELSE 0.0 END) > 0.95 OR avg(CASE WHEN coi > 0 THEN 1.0 ELSE 0.0 END) < 0.05 AS is_degenerate FROM coi")
def g21(spark, d):
    return G.degenerate(edges(spark, d))


@query("O4_strongest_edges", f"WITH {BOTH} SELECT i AS node, j AS other, round(w, 6) AS w, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(abs(w), 9) DESC, j) AS place FROM sym) WHERE place <= 2")
def o4(spark, d):
    return rounded(G.strongest_edges(edges(spark, d), 2), "w")


@query("G2_sponge_clusters")
def g2(spark, d):
    return G.cluster(edges(spark, d), len(FEATURES), "signed", 2, sign=1)


@query("G3_sponge_synergy_clusters")
def g3(spark, d):
    return G.cluster(edges(spark, d), len(FEATURES), "signed", 2)


@query("G4_sponge_unnormalised")
def g4(spark, d):
    return G.cluster(edges(spark, d), len(FEATURES), "signed", 2, normalised=False)


@query("G5_unsigned_spectral")
def g5(spark, d):
    return G.cluster(edges(spark, d), len(FEATURES), "unsigned", 2)


@query("G8_choose_k")
def g8(spark, d):
    return G.cluster(edges(spark, d), len(FEATURES), "signed", None)


@query("G11_graph_report")
def g11(spark, d):
    return rounded(G.graph_report(edges(spark, d), len(FEATURES)), "value")


@query("G17_tau_grid")
def g17(spark, d):
    w = G.dense(edges(spark, d), len(FEATURES))
    grid, _ = L.tau_grid(w, L.spectral(w, 2), 2)
    return spark.createDataFrame([(i, j, float(grid[i, j])) for i in range(len(grid)) for j in range(len(grid))], "i int, j int, ari double")


def _binary(spark, d):
    return matrix(spark, d).withColumn("y", (F.col("label") == "R").cast("double"))


_STUMP = """WITH c AS (SELECT l_quantity AS x, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS s FROM lineitem GROUP BY 1),
r AS (SELECT x, sum(n) OVER w AS nl, CAST(sum(s) OVER w AS DOUBLE) AS sl, sum(n) OVER () AS n, CAST(sum(s) OVER () AS DOUBLE) AS s, lead(x) OVER (ORDER BY x) AS nx FROM c WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM r WHERE nl >= 5 AND n - nl >= 5)
SELECT (x + nx) / 2 AS threshold, round(gain, 6) AS gain, CAST(nl AS BIGINT) AS n_left FROM g ORDER BY round(gain, 6) DESC, x LIMIT 1"""


@query("M1_best_stump", _STUMP)
def m1(spark, d):
    return rounded(T.best_stump(_binary(spark, d), "l_quantity", "y"), "gain")


_LEVELS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
_SPLITS = " UNION ALL ".join(
    f"SELECT '{c}' AS candidate, q AS threshold, CAST(n AS DOUBLE) AS n, s, CAST(count(*) FILTER ({c} <= q) AS DOUBLE) AS nl, CAST(coalesce(sum(y) FILTER ({c} <= q), 0) AS DOUBLE) AS sl FROM b, t, (SELECT DISTINCT unnest(quantile_cont({c}, {_LEVELS})) AS q FROM b) GROUP BY q, n, s"
    for c in FEATURES
)


@query("M2_split_gains", f"WITH b AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), t AS (SELECT count(*) AS n, CAST(sum(y) AS DOUBLE) AS s FROM b), g AS ({_SPLITS}) SELECT candidate, round(threshold, 6) AS threshold, round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n, 5) AS gain, CAST(nl AS BIGINT) AS n_left FROM g WHERE nl >= 5 AND n - nl >= 5")
def m2(spark, d):
    gains = T.split_gains(_binary(spark, d), {c: F.col(c) for c in FEATURES}, "y")
    return rounded(rounded(gains.select("candidate", "threshold", "gain", "n_left"), "gain", digits=5), "threshold")


_FIRST = f"""WITH b AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), t AS (SELECT count(*) AS n, CAST(sum(y) AS DOUBLE) AS s FROM b), g AS ({_SPLITS}),
best AS (SELECT * FROM g WHERE nl >= 5 AND n - nl >= 5 ORDER BY round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n, 9) DESC, candidate, threshold LIMIT 1)"""


@query(
    "M10_single_split",
    f"{_FIRST} SELECT 0 AS node, candidate AS feature, round(threshold, 6) AS threshold, round(s / n, 6) AS value, CAST(n AS BIGINT) AS n FROM best UNION ALL SELECT 1, NULL, 0.0, round(sl / nl, 6), CAST(nl AS BIGINT) FROM best UNION ALL SELECT 2, NULL, 0.0, round((s - sl) / (n - nl), 6), CAST(n - nl AS BIGINT) FROM best",
)
def m10one(spark, d):
    m = T.grow(_binary(spark, d), T.candidates_for(FEATURES, "axis"), "y", 1)
    return rounded(m.table(spark).select("node", F.get("features", F.lit(0)).alias("feature"), "threshold", "value", "n"), "value", "threshold")


_SIDE = " ".join(f"WHEN '{c}' THEN {c}" for c in FEATURES)


@query("M11_single_split_predict", f"{_FIRST} SELECT round(CASE WHEN CASE candidate {_SIDE} END <= threshold THEN sl / nl ELSE (s - sl) / (n - nl) END, 6) AS p, count(*) AS n, round(avg(y), 6) AS mean_y FROM b, best GROUP BY 1")
def m11one(spark, d):
    df = _binary(spark, d)
    m = T.grow(df, T.candidates_for(FEATURES, "axis"), "y", 1)
    return df.select(F.round(m.predict(), 6).alias("p"), "y").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))


@query("M10_grow_tree")
def m10(spark, d):
    m = T.grow(_binary(spark, d), T.candidates_for(FEATURES, "axis"), "y", 4)
    return rounded(m.table(spark), "value", "threshold")


@query("M11_predict")
def m11(spark, d):
    df = _binary(spark, d)
    m = T.grow(df, T.candidates_for(FEATURES, "modules", [FEATURES[:3]]), "y", 3)
    return df.select(F.round(m.predict(), 6).alias("p"), "y").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))


@query("M8_tree_sum")
def m8(spark, d):
    df = _binary(spark, d)
    models = T.grow_sum(df, T.candidates_for(FEATURES, "axis"), "y", 4)
    return rounded(r_squared(df.withColumn("p", T.predict_sum(models)).withColumn("all", F.lit(1)), "y", "p", ["all"]), "r2")


@query("M13_one_vs_rest")
def m13(spark, d):
    df = _binary(spark, d)
    p = T.one_vs_rest(df, T.candidates_for(FEATURES, "axis"), "label", ["A", "N", "R"], 6)
    return df.withColumn("p", p).groupBy("label", "p").agg(F.count(F.lit(1)).alias("n"))


@query("M14_complexity")
def m14(spark, d):
    return T.complexity(T.grow(_binary(spark, d), T.candidates_for(FEATURES, "axis"), "y", 4).table(spark))


@query("M18_cross_validate")
def m18(spark, d):
    df = _binary(spark, d).withColumn("fold", (F.col("l_orderkey") % 2).cast("int"))
    both = {"axis": T.candidates_for(FEATURES, "axis"), "oblique": T.candidates_for(FEATURES, "modules", [FEATURES[:2]])}
    return rounded(T.cross_validate(df, both, "y", [2], folds=2), "r2")


@query("M16_baseline_ridge")
def m16(spark, d):
    df = _binary(spark, d)
    weights, intercept = T.ridge_line(df, tuple(FEATURES), "y")
    line = df.withColumn("p", T.projection(tuple(FEATURES), weights) + intercept).withColumn("all", F.lit(1))
    return rounded(r_squared(line, "y", "p", ["all"]).select("r2", F.lit(intercept).alias("intercept")), "r2", "intercept")


@query("S2_read_lines", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s2(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("S3_read_examples", "SELECT c_mktsegment AS dataset, c_custkey AS metadata_row_index, c_acctbal AS bal FROM customer")
def s3(spark, d):
    path = new_path(spark, "examples")
    c = table(spark, d, "customer")
    example = F.struct(
        F.to_json(F.struct(F.col("c_acctbal").alias("bal"))).alias("input"), F.col("c_mktsegment").alias("output"), (F.col("c_custkey") % 5).cast("int").alias("metadata_fold"), F.lit("regression").alias("metadata_task_type"), F.lit("tpc").alias("metadata_source"), F.col("c_custkey").alias("metadata_row_index"), F.lit(5).alias("metadata_n_classes")
    )
    N.example_documents(c, "c_mktsegment", example).write.option("maxRecordsPerFile", 1).json(path)  # a document is a part
    return N.parse_input(N.read_examples(spark, path), ["bal"], lenient=True).select("dataset", "metadata_row_index", "bal")


@query("S6_planted_table")
def s6(spark, d):
    t = synthetic.planted(spark, 2000, 6, [("xor", [0, 1]), ("and", [2, 3])], 0.1, [(4, 0)])
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("output"), 2).alias("balance"), (F.corr("X4", "X0") > 0.9).alias("redundant"))


@query("S7_tidy_results", "SELECT o_orderstatus AS dataset, o_orderpriority AS method, CAST(o_orderkey AS INTEGER) AS fold, o_totalprice AS score FROM orders WHERE o_orderkey % 3 <> 0")
def s7(spark, d):
    status = F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("success")
    fold = F.struct(F.col("o_orderkey").cast("int").alias("fold"), status.alias("status"), F.col("o_totalprice").alias("balanced_accuracy"), F.lit(None).cast("double").alias("r2"), F.lit(1.0).alias("fit_time"))
    nested = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("c")).agg(F.collect_list(fold).alias("folds"))
    return N.tidy_results(nested).select("dataset", "method", "fold", "score")


@query("S13_nested_results", f"WITH {RUNS} SELECT dataset, method, CAST(count(*) AS INTEGER) AS n FROM runs GROUP BY ALL")
def s13(spark, d):
    return N.nested_results(runs(spark, d).select("dataset", "method", "fold", "max_splits", "score"), ["dataset", "method"]).select("dataset", "method", F.size("rows").alias("n"))
