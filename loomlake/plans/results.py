"""Queries of result-table operators, tests and effect sizes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.tails import nemenyi_distance
from ..operators import hypothesis as H
from ..operators import results as R
from .inputs import METHOD_MEANS, METHODS, RUNS, means, rounded, runs, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


A, B = METHODS[0], METHODS[4]
KEYS = ["dataset", "max_splits", "fold"]
PAIRS = f"{RUNS}, pairs AS (SELECT dataset, max_splits, fold, a.score AS a, b.score AS b, b.score - a.score AS delta FROM (SELECT * FROM runs WHERE method = '{A}') a JOIN (SELECT * FROM runs WHERE method = '{B}') b USING (dataset, max_splits, fold))"


def pairs(spark, d):
    return R.paired(runs(spark, d), "method", A, B, KEYS, "score")


@query("J1_paired_join", f"WITH {PAIRS} SELECT dataset, max_splits, fold, a, b, round(delta, 6) AS delta FROM pairs")
def j1(spark, d):
    return rounded(pairs(spark, d), "delta")


@query(
    "J2_paired_by_place",
    f"WITH {RUNS}, s AS (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY score, max_splits, fold) - 1 AS place, count(*) OVER (PARTITION BY dataset, method) AS c FROM runs WHERE NOT (dataset = 'P' AND method = '{A}' AND fold = 0)) SELECT dataset, a.place, a.score AS a, b.score AS b, round(b.score - a.score, 6) AS delta FROM (SELECT * FROM s WHERE method = '{A}') a JOIN (SELECT * FROM s WHERE method = '{B}') b USING (dataset, place, c)",
)
def j2(spark, d):
    r = runs(spark, d).where(~((F.col("dataset") == "P") & (F.col("method") == A) & (F.col("fold") == 0)))  # one dataset's counts differ
    return rounded(R.paired_by_place(r, "method", A, B, ["dataset"], ["score", "max_splits", "fold"], "score"), "delta")


@query("J3_paired_last", f"WITH {RUNS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method, fold ORDER BY max_splits DESC) AS r FROM runs) WHERE r = 1) SELECT dataset, fold, a.score AS a, b.score AS b, round(b.score - a.score, 6) AS delta FROM (SELECT * FROM l WHERE method = '{A}') a JOIN (SELECT * FROM l WHERE method = '{B}') b USING (dataset, fold)")
def j3(spark, d):
    last = R.last_of_key(runs(spark, d), ["dataset", "method", "fold"], ["max_splits"])
    return rounded(R.paired(last, "method", A, B, ["dataset", "fold"], "score"), "delta")


@query(
    "J4_lookup_last",
    "WITH l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT c_custkey, event_type, value FROM customer LEFT JOIN (SELECT user_id AS c_custkey, event_type, value FROM l WHERE r = 1) USING (c_custkey)",
)
def j4(spark, d):
    right = table(spark, d, "events").withColumnRenamed("user_id", "c_custkey")
    return R.lookup_last(table(spark, d, "customer").select("c_custkey"), right, ["c_custkey"], ["event_id"], ["event_type", "value"])


_BEST = f"{RUNS}, m AS (SELECT dataset, method, max_splits, avg(score) AS mean FROM runs GROUP BY ALL), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY round(mean, 9) DESC, max_splits) AS r FROM m) WHERE r = 1)"


@query("A24_best_setting", f"WITH {_BEST} SELECT dataset, method, max_splits, round(mean, 6) AS mean FROM best")
def a24(spark, d):
    return rounded(R.best_setting(runs(spark, d), ["dataset", "method"], "max_splits", "score"), "mean")


@query("J5_semi_join", f"WITH {_BEST} SELECT dataset, method, max_splits, fold, score FROM runs SEMI JOIN best USING (dataset, method, max_splits)")
def j5(spark, d):
    r = runs(spark, d)
    return R.at_chosen(r, R.best_setting(r, ["dataset", "method"], "max_splits", "score"), ["dataset", "method", "max_splits"]).select("dataset", "method", "max_splits", "fold", "score")


@query("J6_scatter", "SELECT doc_id, coalesce(CAST(toxic AS VARCHAR), '') AS prediction FROM documents LEFT JOIN labels USING (doc_id)")
def j6(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("prediction"))
    return R.scatter(table(spark, d, "documents").select("doc_id"), labels, ["doc_id"], "prediction")


@query("J7_feature_pairs", "SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def j7(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    return n.toDF("i").join(F.broadcast(n.toDF("j")), F.col("i") < F.col("j"))  # features against features


@query("J9_dimension_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j9(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey").join(n, "n_nationkey").select("s_suppkey", "n_name", "r_name")


@query("J10_with_default", "SELECT doc_id, coalesce(quality, 20) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def j10(spark, d):
    return R.with_default(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], "quality", 20)


@query("J11_missing_cells", f"WITH {RUNS}, f AS (SELECT unnest(range(0, 7)) AS fold), g AS (SELECT dataset, method, CAST(fold AS INTEGER) AS fold FROM (SELECT DISTINCT dataset FROM runs), (SELECT DISTINCT method FROM runs), f) SELECT * FROM g ANTI JOIN runs USING (dataset, method, fold)")
def j11(spark, d):
    out = R.missing_cells(runs(spark, d), ["dataset", "method", "fold"], {"fold": list(range(7))})
    return out.withColumn("fold", F.col("fold").cast("int"))


@query("J12_membership", "SELECT n_regionkey AS module, n_nationkey AS feature FROM nation")
def j12(spark, d):
    modules = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("module")).agg(F.collect_list("n_nationkey").alias("features"))
    return R.members(modules)


@query("J14_delta_to_reference", f"WITH {METHOD_MEANS} SELECT m.dataset, CASE m.method WHEN '{A}' THEN 'axis' WHEN '{B}' THEN 'oblique' ELSE 'other' END AS method, round(m.score - r.score, 6) AS delta FROM means m JOIN means r ON m.dataset = r.dataset AND r.method = '{A}' WHERE m.method IN ('{A}', '{B}')")
def j14(spark, d):
    out = R.delta_to_reference(means(spark, d), "method", "axis", ["dataset"], "score", {A: "axis", B: "oblique"})
    return rounded(out.select("dataset", "method", "delta"), "delta")


@query("J15_fallback_lookup", "SELECT c_custkey, coalesce(a.v, b.v) AS v FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a USING (c_custkey) LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) b USING (c_custkey)")
def j15(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    best = lambda t: t.groupBy("c_custkey").agg(F.max("o_totalprice").alias("v"))
    return R.first_of(table(spark, d, "customer").select("c_custkey"), best(o.where("o_orderstatus = 'P'")), best(o), ["c_custkey"], "v")


@query("A1_mean_population_sd", f"WITH {RUNS} SELECT dataset, method, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd FROM runs GROUP BY ALL")
def a1(spark, d):
    return rounded(R.summary(runs(spark, d), ["dataset", "method"], "score"), "mean", "sd")


@query("A2_mean_sample_sd", f"WITH {RUNS} SELECT dataset, method, max_splits, fold, count(score) AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS sd FROM runs GROUP BY ALL")
def a2(spark, d):
    return rounded(R.summary(runs(spark, d), ["dataset", "method", "max_splits", "fold"], "score", 1, 0.0), "mean", "sd")


@query("A3_counts", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_custs, max(c) AS most FROM (SELECT *, count(*) OVER (PARTITION BY o_orderstatus, o_custkey) AS c FROM orders) GROUP BY 1")
def a3(spark, d):
    by = table(spark, d, "orders").groupBy("o_orderstatus", "o_custkey").count()
    return by.groupBy("o_orderstatus").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_custs"), F.max("count").alias("most"))


@query("A4_percentiles", "SELECT o_orderstatus, round(median(o_totalprice), 6) AS median, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr, round(max(o_totalprice) - min(o_totalprice), 6) AS ptp, round(avg(abs(o_totalprice)), 4) AS abs_mean FROM orders GROUP BY 1")
def a4(spark, d):
    p = lambda q: F.percentile("o_totalprice", F.lit(q))
    out = table(spark, d, "orders").groupBy("o_orderstatus").agg(
        p(0.5).alias("median"), p(0.1).alias("p10"), p(0.9).alias("p90"), (p(0.75) - p(0.25)).alias("iqr"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("ptp"), F.round(F.avg(F.abs("o_totalprice")), 4).alias("abs_mean")
    )
    return rounded(out, "median", "p10", "p90", "iqr", "ptp")


_WIDE = ", ".join(f"avg(score) FILTER (method = '{m}') AS \"{m}\"" for m in METHODS)


@query("A25_pivot_means", f"WITH {RUNS}, w AS (SELECT dataset, {_WIDE} FROM runs GROUP BY 1) SELECT dataset, " + ", ".join(f'round("{m}", 6) AS "{m}"' for m in METHODS) + " FROM w")
def a25(spark, d):
    return rounded(R.pivot_means(runs(spark, d), "dataset", "method", METHODS, "score"), *METHODS)


@query("A26_imputed_pivot", f"WITH {RUNS}, w AS (SELECT fold, {_WIDE} FROM runs WHERE (fold + length(method)) % 4 <> 0 GROUP BY 1) SELECT fold, " + ", ".join(f'round(coalesce("{m}", avg("{m}") OVER ()), 6) AS "{m}"' for m in METHODS) + " FROM w")
def a26(spark, d):
    some = runs(spark, d).where((F.col("fold") + F.length("method")) % 4 != 0)
    return rounded(R.pivot_means(some, "fold", "method", METHODS, "score", impute=True), *METHODS)


@query("A27_fisher_pooled", f"WITH {RUNS}, c AS (SELECT dataset, max_splits, corr(score, arity) AS r, count(*) AS n FROM runs GROUP BY ALL) SELECT dataset, round(tanh(sum(atanh(greatest(-0.9999, least(0.9999, r))) * (n - 3)) / sum(n - 3)), 6) AS pooled FROM c WHERE n >= 4 GROUP BY 1")
def a27(spark, d):
    c = runs(spark, d).groupBy("dataset", "max_splits").agg(F.corr("score", "arity").alias("r"), F.count(F.lit(1)).alias("n"))
    return rounded(R.fisher_pooled(c, "r", "n", ["dataset"]), "pooled")


@query("A28_geometric_mean", f"WITH {RUNS} SELECT dataset, round(exp(avg(ln(arity))), 6) AS geo_mean FROM runs WHERE arity > 0 GROUP BY 1")
def a28(spark, d):
    return rounded(R.geometric_mean(runs(spark, d), ["dataset"], "arity"), "geo_mean")


@query("A29_power_law", f"WITH {RUNS}, f AS (SELECT dataset, exp(regr_intercept(ln(arity), ln(n))) AS a, regr_slope(ln(arity), ln(n)) AS b, regr_r2(ln(arity), ln(n)) AS r2 FROM runs WHERE n > 0 AND arity > 0 GROUP BY 1) SELECT dataset, round(a, 5) AS a, round(b, 6) AS b, round(r2, 6) AS r2, round(a * power(1e3, b), 4) AS predicted FROM f")
def a29(spark, d):
    out = R.power_law(runs(spark, d), "n", "arity", ["dataset"], 1e3)
    return rounded(rounded(rounded(out, "b", "r2"), "a", digits=5), "predicted", digits=4)


@query("A30_multi_level", f"WITH {RUNS} SELECT dataset, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd FROM runs GROUP BY GROUPING SETS ((dataset), ())")
def a30(spark, d):
    return rounded(R.multi_level(runs(spark, d), "dataset", "score"), "mean", "sd")


@query("A34_impurity", "SELECT l_returnflag, round(var_pop(l_quantity) * count(*), 3) AS sse, round(2 * p * (1 - p), 6) AS gini FROM (SELECT *, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY l_returnflag) AS p FROM lineitem) GROUP BY l_returnflag, p")
def a34(spark, d):
    p = F.avg((F.col("l_linestatus") == "O").cast("double"))
    q = table(spark, d, "lineitem").groupBy("l_returnflag").agg((F.var_pop("l_quantity") * F.count(F.lit(1))).alias("sse"), (2 * p * (1 - p)).alias("gini"))
    return rounded(rounded(q, "sse", digits=3), "gini")


@query("A35_timing_ratio", f"WITH {METHOD_MEANS} SELECT dataset, method, round(arity / min(arity) OVER (PARTITION BY dataset), 6) AS ratio, score > avg(score) OVER (PARTITION BY dataset) AND arity / min(arity) OVER (PARTITION BY dataset) < 10 AS is_justified FROM means")
def a35(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("dataset")
    ratio = F.col("arity") / F.min("arity").over(w)
    return rounded(means(spark, d).select("dataset", "method", ratio.alias("ratio"), ((F.col("score") > F.avg("score").over(w)) & (ratio < 10)).alias("is_justified")), "ratio")


@query("A36_composite_key", f"WITH {RUNS} SELECT split_part(dataset || '/' || method, '/', 2) AS part, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high, count(*) AS n FROM runs GROUP BY 1")
def a36(spark, d):
    part = F.element_at(F.split(F.concat_ws("/", "dataset", "method"), "/"), 2)
    return rounded(runs(spark, d).groupBy(part.alias("part")).agg(F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("n")), "mean")


@query("A37_best_minus_reference", f"WITH {METHOD_MEANS} SELECT dataset, round(max(score) FILTER (method IN ('{METHODS[1]}', '{METHODS[2]}')) - max(score) FILTER (method = '{A}'), 6) AS advantage FROM means GROUP BY 1")
def a37(spark, d):
    return rounded(R.best_minus_reference(means(spark, d), ["dataset"], "method", METHODS[1:3], A, "score"), "advantage")


@query("A39_line_fit", f"WITH {RUNS} SELECT dataset, round(regr_intercept(score, arity * arity * n), 6) AS intercept, round(regr_slope(score, arity * arity * n), 9) AS slope, round(regr_r2(score, arity * arity * n), 6) AS r2 FROM runs GROUP BY 1")
def a39(spark, d):
    out = R.line_fit(runs(spark, d), F.col("arity") * F.col("arity") * F.col("n"), "score", ["dataset"])
    return rounded(rounded(out, "intercept", "r2"), "slope", digits=9)


@query("A40_mean_of_rounded_means", f"WITH {RUNS} SELECT method, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd FROM (SELECT dataset, method, round(avg(score), 4) AS m FROM runs GROUP BY ALL) GROUP BY 1")
def a40(spark, d):
    m = runs(spark, d).groupBy("dataset", "method").agg(F.round(F.avg("score"), 4).alias("m"))
    return rounded(m.groupBy("method").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd")), "mean", "sd")


_AVG = "rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0"


@query("W1_average_rank", f"WITH {METHOD_MEANS} SELECT dataset, method, CAST({_AVG} AS DOUBLE) AS r FROM means")
def w1(spark, d):
    return means(spark, d).select("dataset", "method", R.average_rank("score", ["dataset"]).alias("r"))


@query("W2_ordinal_rank", f"WITH {METHOD_MEANS} SELECT dataset, method, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, method) AS r FROM means")
def w2(spark, d):
    return means(spark, d).select("dataset", "method", R.ordinal_rank("score", ["dataset"], ["method"]).alias("r"))


@query("W3_top_three_counts", f"WITH {METHOD_MEANS} SELECT method, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, method) AS r FROM means) WHERE r <= 3 GROUP BY 1")
def w3(spark, d):
    return R.top_of_group(means(spark, d), ["dataset"], "score", ["method"], 3).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("W4_winners", f"WITH {METHOD_MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, method) AS r FROM means) SELECT dataset, max(method) FILTER (r = 1) AS winner, max(method) FILTER (r = 2) AS runner_up, round(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 6) AS gap FROM r GROUP BY 1")
def w4(spark, d):
    return rounded(R.winners(means(spark, d), "dataset", "method", "score"), "gap")


@query("W5_gaps", f"WITH {METHOD_MEANS} SELECT dataset, method, round(score - lag(score) OVER (PARTITION BY dataset ORDER BY method), 6) AS gap FROM means")
def w5(spark, d):
    return rounded(R.gaps(means(spark, d), ["method"], "score", ["dataset"]).select("dataset", "method", "gap"), "gap")


@query(
    "W6_holm",
    f"WITH {METHOD_MEANS}, v AS (SELECT *, least(1.0, score * (count(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY score, method) + 1)) AS s FROM means) SELECT dataset, method, round(max(s) OVER (PARTITION BY dataset ORDER BY score, method ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM v",
)
def w6(spark, d):
    return rounded(R.holm(means(spark, d), "score", ["method"], ["dataset"]).select("dataset", "method", "p_holm"), "p_holm")


@query("W7_first_row", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def w7(spark, d):
    return R.top_of_group(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", [], 1, descending=False).select("o_custkey", "o_orderkey")


@query("W10_median_rank", f"WITH {METHOD_MEANS}, r AS (SELECT method, row_number() OVER (PARTITION BY dataset ORDER BY arity, method) AS r FROM means) SELECT method, CAST(median(r) AS DOUBLE) AS median_rank FROM r GROUP BY 1")
def w10(spark, d):
    r = means(spark, d).select("method", R.ordinal_rank("arity", ["dataset"], ["method"], descending=False).alias("r"))
    return r.groupBy("method").agg(F.percentile("r", F.lit(0.5)).alias("median_rank"))


@query("W11_first_stable", f"WITH {RUNS} SELECT dataset, method, min(max_splits) FILTER (score > 0.42 AND arity < 48) AS first FROM runs GROUP BY ALL")
def w11(spark, d):
    return R.first_stable(runs(spark, d), "max_splits", (F.col("score") > 0.42) & (F.col("arity") < 48), ["dataset", "method"])


@query(
    "W12_rank_cliques",
    "WITH r AS (SELECT n_name AS name, CAST(n_nationkey % 7 AS DOUBLE) * 1.1 + n_nationkey * 0.1 AS rank FROM nation), o AS (SELECT *, row_number() OVER (ORDER BY rank, name) AS i FROM r), h AS (SELECT a.i, a.name AS first, max(b.i) AS j FROM o a JOIN o b ON b.i > a.i AND b.rank - a.rank <= 1.05 GROUP BY ALL) SELECT first, (SELECT name FROM o WHERE o.i = h.j) AS last, j - i + 1 AS size FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.i < h.i AND g.j >= h.j)",
)
def w12(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") % 7).cast("double") * 1.1 + F.col("n_nationkey") * 0.1).alias("rank"))
    return R.rank_cliques(n, "name", "rank", 1.05)


_DOMINATED = {
    "weak": "q.arity <= p.arity AND q.score >= p.score AND (q.arity < p.arity OR q.score > p.score)",
    "strict": "q.arity < p.arity AND q.score > p.score",
}


def _frontier(mode):
    return lambda spark, d: R.pareto(means(spark, d), "arity", "score", mode, ["dataset"])


for _pf, _mode in (("PF1_pareto_strict", "strict"), ("PF2_pareto_weak", "weak")):
    query(_pf, f"WITH {METHOD_MEANS} SELECT dataset, method, score, arity FROM means p WHERE NOT EXISTS (SELECT 1 FROM means q WHERE q.dataset = p.dataset AND {_DOMINATED[_mode]})")(_frontier(_mode))
query("PF3_pareto_all", f"WITH {METHOD_MEANS} SELECT dataset, method, score, arity FROM means p WHERE NOT EXISTS (SELECT 1 FROM means q WHERE q.dataset = p.dataset AND (q.score > p.score OR q.arity < p.arity))")(_frontier("all"))


@query("PF4_best_trade_off", f"WITH {METHOD_MEANS}, f AS (SELECT * FROM means p WHERE NOT EXISTS (SELECT 1 FROM means q WHERE q.dataset = p.dataset AND {_DOMINATED['strict']})) SELECT dataset, method, score, arity FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY arity, score DESC, method) AS r FROM f WHERE method <> '{A}') WHERE r = 1")
def pf4(spark, d):
    return R.best_trade_off(_frontier("strict")(spark, d), "arity", "score", "method", [A], ["dataset"])


@query("A23_win_loss_tie", f"WITH {PAIRS} SELECT dataset, count(*) FILTER (delta > 0.001) AS wins, count(*) FILTER (delta < -0.001) AS losses, count(*) FILTER (abs(delta) <= 0.001) AS ties, count(*) FILTER (delta > 0) / count(*) AS win_rate FROM pairs GROUP BY 1")
def a23(spark, d):
    return R.win_loss_tie(pairs(spark, d), ["dataset"], 0.001)


@query("A38_pairwise_win_rate", f"WITH {RUNS} SELECT a.method AS m1, b.method AS m2, round(avg(CASE WHEN a.score > b.score THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM runs a JOIN runs b USING (dataset, max_splits, fold) WHERE a.method <> b.method GROUP BY ALL")
def a38(spark, d):
    r = runs(spark, d)
    a, b = r.select(*KEYS, F.col("method").alias("m1"), F.col("score").alias("s1")), r.select(*KEYS, F.col("method").alias("m2"), F.col("score").alias("s2"))
    return rounded(a.join(b, KEYS).where("m1 <> m2").groupBy("m1", "m2").agg(F.avg((F.col("s1") > F.col("s2")).cast("double")).alias("win_rate")), "win_rate")


@query("P14_unified_metric", f"WITH {RUNS} SELECT dataset, method, fold, max_splits, coalesce(CASE WHEN dataset <> 'P' THEN score END, arity) AS metric FROM runs")
def p14(spark, d):
    r = runs(spark, d).withColumn("ba", F.when(F.col("dataset") != "P", F.col("score"))).withColumn("r2", F.col("arity"))
    return r.select("dataset", "method", "fold", "max_splits", F.coalesce("ba", "r2").alias("metric"))


@query("P15_derived_columns", f"WITH {RUNS} SELECT dataset, method, max_splits, fold, round(score * arity, 6) AS complexity, CASE WHEN arity <> 0 THEN round(score / arity, 6) END AS per_arity FROM runs")
def p15(spark, d):
    return rounded(runs(spark, d).select("dataset", "method", "max_splits", "fold", (F.col("score") * F.col("arity")).alias("complexity"), S.ratio(F.col("score"), F.col("arity")).alias("per_arity")), "complexity", "per_arity")


@query("P16_set_membership", f"WITH {RUNS} SELECT dataset, method, fold, max_splits FROM runs WHERE method IN ('{A}', '{B}')")
def p16(spark, d):
    return runs(spark, d).where(F.col("method").isin(A, B)).select("dataset", "method", "fold", "max_splits")


@query("P19_effect_labels", f"WITH {RUNS} SELECT dataset, method, fold, max_splits, CASE WHEN abs(score - 0.4) * 10 < 0.2 THEN 'negligible' WHEN abs(score - 0.4) * 10 < 0.5 THEN 'small' WHEN abs(score - 0.4) * 10 < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM runs")
def p19(spark, d):
    return runs(spark, d).select("dataset", "method", "fold", "max_splits", S.effect_size_label(F.abs(F.col("score") - 0.4) * 10).alias("effect"))


@query("P21_claim_status", f"WITH {METHOD_MEANS} SELECT dataset, method, CASE WHEN abs(0.42 - score) / 0.01 <= 1 THEN 'MATCH' WHEN abs(0.42 - score) / 0.01 <= 5 THEN 'APPROXIMATE' ELSE 'MISMATCH' END AS status FROM means")
def p21(spark, d):
    return means(spark, d).select("dataset", "method", S.claim_status(F.lit("absolute"), F.lit(0.42), F.col("score"), F.lit(0.01)).alias("status"))


@query("P22_verdict", f"WITH {PAIRS}, w AS (SELECT count(*) FILTER (delta > 0) / count(*) AS r FROM pairs) SELECT round(r, 6) AS rate, CASE WHEN r >= 0.6 THEN 'CONFIRMED' WHEN r >= 0.4 THEN 'PARTIALLY' ELSE 'DISCONFIRMED' END AS verdict FROM w")
def p22(spark, d):
    r = pairs(spark, d).agg(F.avg((F.col("delta") > 0).cast("double")).alias("rate"))
    return rounded(r.withColumn("verdict", F.when(F.col("rate") >= 0.6, "CONFIRMED").when(F.col("rate") >= 0.4, "PARTIALLY").otherwise("DISCONFIRMED")), "rate")


@query("O1_sorted", f"WITH {RUNS} SELECT dataset, method, max_splits, fold, score FROM runs ORDER BY dataset, method, max_splits, fold")
def o1(spark, d):
    return runs(spark, d).select("dataset", "method", "max_splits", "fold", "score").orderBy("dataset", "method", "max_splits", "fold")


@query("O3_top_ten", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def o3(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("U1_union_all", "SELECT c_nationkey AS nation, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def u1(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal")))


@query("U3_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u3(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'P'").select("k"))


@query("U4_common_to_all", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5")
def u4(spark, d):
    return R.common_to_all(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("U5_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u5(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query(
    "ST1_friedman",
    f"""WITH {RUNS}, b AS (SELECT dataset || '/' || max_splits || '/' || fold AS block, method, score FROM runs), r AS (SELECT block, method, rank() OVER (PARTITION BY block ORDER BY score DESC) + (count(*) OVER (PARTITION BY block, score) - 1) / 2.0 AS r FROM b),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY block, r)), s AS (SELECT sum(s * s) AS ss, max(n) AS n, CAST(count(*) AS DOUBLE) AS k FROM (SELECT CAST(sum(r) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY method))
SELECT CAST(k AS INTEGER) AS k, CAST(n AS INTEGER) AS n, round((12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS chi2,
round((12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) / (n * (k - 1)), 6) AS kendall_w, round(2.728 * sqrt(k * (k + 1) / (6 * n)), 6) AS critical_distance FROM s, t""",
)
def st1(spark, d):
    b = runs(spark, d).withColumn("block", F.concat_ws("/", "dataset", "max_splits", "fold"))
    return rounded(H.friedman(b, "block", "method", "score").drop("p"), "chi2", "kendall_w", "critical_distance")


@query(
    "ST2_friedman_plain",
    f"""WITH {RUNS}, b AS (SELECT dataset || '/' || max_splits || '/' || fold AS block, method, score FROM runs), r AS (SELECT block, method, rank() OVER (PARTITION BY block ORDER BY score DESC) + (count(*) OVER (PARTITION BY block, score) - 1) / 2.0 AS r FROM b),
m AS (SELECT method, avg(r) AS r, count(*) AS n FROM r GROUP BY 1) SELECT CAST(count(*) AS INTEGER) AS k, CAST(max(n) AS INTEGER) AS n, round(12.0 * max(n) / (count(*) * (count(*) + 1)) * sum(power(r - (SELECT count(*) + 1 FROM m) / 2.0, 2)), 6) AS chi2 FROM m""",
)
def st2(spark, d):
    b = runs(spark, d).withColumn("block", F.concat_ws("/", "dataset", "max_splits", "fold"))
    return rounded(H.friedman_plain(b, "block", "method", "score"), "chi2")


#: With five methods there are four degrees of freedom, whose tail has a closed form.
_FRIEDMAN_P = f"""WITH {RUNS}, b AS (SELECT dataset || '/' || max_splits || '/' || fold AS block, method, score FROM runs), r AS (SELECT block, method, rank() OVER (PARTITION BY block ORDER BY score DESC) + (count(*) OVER (PARTITION BY block, score) - 1) / 2.0 AS r FROM b),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY block, r)), s AS (SELECT sum(s * s) AS ss, max(n) AS n, CAST(count(*) AS DOUBLE) AS k FROM (SELECT CAST(sum(r) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY method)),
x AS (SELECT (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS c FROM s, t) SELECT round(c, 6) AS chi2, round(exp(-c / 2) * (1 + c / 2), 6) AS p FROM x"""


@query("ST1_friedman_p", _FRIEDMAN_P)
def st1p(spark, d):
    b = runs(spark, d).withColumn("block", F.concat_ws("/", "dataset", "max_splits", "fold"))
    return rounded(H.friedman(b, "block", "method", "score").select("chi2", "p"), "chi2", "p")


@query("ST5_rank_gaps", f"WITH {METHOD_MEANS}, q AS (SELECT method, CAST({_AVG} AS DOUBLE) AS r FROM means), r AS (SELECT method, avg(r) AS r FROM q GROUP BY 1) SELECT a.method AS a, b.method AS b, round(abs(a.r - b.r), 6) AS gap, abs(a.r - b.r) > {nemenyi_distance(5, 3)!r} AS significant FROM r a JOIN r b ON a.method < b.method")
def st5(spark, d):
    return rounded(H.rank_gaps(means(spark, d), "dataset", "method", "score", nemenyi_distance(5, 3)), "gap")


_WR = f"{PAIRS}, z AS (SELECT dataset, delta, round(abs(delta), 12) AS m FROM pairs WHERE abs(delta) > 1e-15), w AS (SELECT dataset, delta, rank() OVER (PARTITION BY dataset ORDER BY m) + (count(*) OVER (PARTITION BY dataset, m) - 1) / 2.0 AS r FROM z)"


@query("ST6_wilcoxon", f"WITH {_WR} SELECT dataset, count(*) AS n, CAST(least(coalesce(sum(r) FILTER (delta > 0), 0), coalesce(sum(r) FILTER (delta < 0), 0)) AS DOUBLE) AS w FROM w GROUP BY 1")
def st6(spark, d):
    return H.wilcoxon(pairs(spark, d), ["dataset"]).select("dataset", "n", "w")


@query("ST6_wilcoxon_p")
def st6p(spark, d):
    return rounded(H.wilcoxon(pairs(spark, d), ["dataset"]), "z", "p")


@query("ST7_paired_t", f"WITH {PAIRS} SELECT dataset, count(delta) AS n, round(avg(delta), 6) AS mean, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 5) AS t FROM pairs GROUP BY 1")
def st7(spark, d):
    return rounded(rounded(H.paired_t(pairs(spark, d), ["dataset"]).select("dataset", "n", "mean", "t"), "mean"), "t", digits=5)


@query(
    "ST8_effect_sizes",
    f"WITH {PAIRS}, s AS (SELECT dataset, count(delta) AS n, avg(delta) AS m, stddev_samp(delta) AS sd, var_samp(a) AS va, var_samp(b) AS vb FROM pairs GROUP BY 1) SELECT dataset, n, round(m / sd, 6) AS dz, round(m / sqrt((va + vb) / 2), 6) AS d, round(m / sqrt((va + vb) / 2) * (1 - 3.0 / (4 * (2 * n) - 9)), 6) AS g, round(m / sd * (1 - 3.0 / (4 * n - 5)), 6) AS g_paired FROM s",
)
def st8(spark, d):
    return rounded(H.effect_sizes(pairs(spark, d), ["dataset"]), "dz", "d", "g", "g_paired")


@query("ST10_bayesian_signed_rank")
def st10(spark, d):
    return H.bayesian_signed_rank(pairs(spark, d))


@query("ST11_rope_shares", f"WITH {PAIRS} SELECT dataset, round(avg(CASE WHEN delta <= -0.01 THEN 1.0 ELSE 0.0 END), 6) AS \"left\", round(avg(CASE WHEN abs(delta) < 0.01 THEN 1.0 ELSE 0.0 END), 6) AS rope, round(avg(CASE WHEN delta >= 0.01 THEN 1.0 ELSE 0.0 END), 6) AS \"right\" FROM pairs GROUP BY 1")
def st11(spark, d):
    return rounded(H.rope_shares(pairs(spark, d), ["dataset"]), "left", "rope", "right")


@query(
    "ST12_bootstrap",
    f"""WITH {PAIRS}, p AS (SELECT delta, row_number() OVER (ORDER BY dataset, max_splits, fold) - 1 AS i, count(*) OVER () AS n FROM pairs),
d AS (SELECT b, CAST('0x' || left(md5('42|' || b || '|' || i), 8) AS BIGINT) % n AS i FROM p, (SELECT unnest(range(0, 10000)) AS b)), m AS (SELECT b, avg(delta) AS m FROM d JOIN p USING (i) GROUP BY 1)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""",
)
def st12(spark, d):
    return rounded(H.bootstrap_mean(pairs(spark, d), ["dataset", "max_splits", "fold"]), "mean", "lo", "hi")


_PERMUTED = f"""WITH {METHOD_MEANS}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS x, rank() OVER (ORDER BY arity) + (count(*) OVER (PARTITION BY arity) - 1) / 2.0 AS y,
    row_number() OVER (ORDER BY dataset, method) - 1 AS i FROM means), t AS (SELECT b, y, row_number() OVER (PARTITION BY b ORDER BY md5('42|' || b || '|' || i)) - 1 AS i FROM r, (SELECT unnest(range(0, 10000)) AS b)),
c AS (SELECT b, corr(CAST(r.x AS DOUBLE), CAST(t.y AS DOUBLE)) AS c FROM t JOIN r USING (i) GROUP BY 1), o AS (SELECT corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)) AS rho FROM r)
SELECT round(rho, 6) AS rho, round(avg(CASE WHEN abs(c) >= abs(rho) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM c, o GROUP BY rho"""


@query("ST13_permutation_p", _PERMUTED)
def st13(spark, d):
    return rounded(H.permutation_p(means(spark, d), "score", "arity", ["dataset", "method"]), "rho", "p")


@query("ST14_required_n", f"WITH {RUNS}, c AS (SELECT dataset, corr(score, arity) AS r, count(*) AS n FROM runs GROUP BY 1) SELECT dataset, CAST(ceil(power(2.802, 2) / power(atanh(r), 2) + 3) AS BIGINT) AS required, round(2.8 / sqrt(n - 3), 6) AS detectable, round(atanh(r), 6) AS z FROM c")
def st14(spark, d):
    c = runs(spark, d).groupBy("dataset").agg(F.corr("score", "arity").alias("r"), F.count(F.lit(1)).alias("n"))
    return rounded(c.select("dataset", H.required_n(F.col("r")).alias("required"), H.detectable(F.col("n")).alias("detectable"), S.fisher_z(F.col("r")).alias("z")), "detectable", "z")


@query("ST19_pearson", f"WITH {RUNS} SELECT dataset, round(corr(score, arity), 6) AS r FROM runs GROUP BY 1")
def st19(spark, d):
    return rounded(runs(spark, d).groupBy("dataset").agg(F.corr("score", "arity").alias("r")), "r")


@query("ST20_bonferroni", f"WITH {METHOD_MEANS} SELECT dataset, method, round(least(1.0, score * 2), 6) AS p, abs(score - 0.4) > 0.2 AS is_large FROM means")
def st20(spark, d):
    return rounded(means(spark, d).select("dataset", "method", H.bonferroni(F.col("score"), F.lit(2)).alias("p"), (F.abs(F.col("score") - 0.4) > 0.2).alias("is_large")), "p")


@query("ST21_g_difference", f"WITH {METHOD_MEANS} SELECT dataset, method, round((score - arity / 100) / sqrt(2 / 35.0 + score * score / 70 + 2 / 25.0 + arity / 100 * arity / 100 / 50), 6) AS z FROM means")
def st21(spark, d):
    return rounded(means(spark, d).select("dataset", "method", H.g_difference_z(F.col("score"), F.lit(35.0), F.col("arity") / 100, F.lit(25.0)).alias("z")), "z")
