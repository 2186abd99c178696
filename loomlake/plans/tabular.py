"""Queries of cleaning, sampling and information operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean as C
from ..operators import information as I
from ..operators import metrics as M
from .inputs import COI, FEATURES, KEYS, MI, QUANTILE_CODES, bin_sql, coded, coi_of, edges, matrix, rounded, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("P1_keep_columns", "SELECT l_quantity, l_tax, l_returnflag FROM lineitem")
def p1(spark, d):
    return C.keep_columns(table(spark, d, "lineitem"), ["l_quantity", "l_tax", "absent"], "l_returnflag")


@query("P2_coerce_numeric", "SELECT o_orderkey, try_cast(left(o_orderpriority, 1) AS DOUBLE) AS a, try_cast(o_orderpriority AS DOUBLE) AS b FROM orders")
def p2(spark, d):
    return C.coerce_numeric(table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("a"), F.col("o_orderpriority").alias("b")), ["a", "b"])


@query("P3_drop_incomplete", "SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")
def p3(spark, d):
    return C.drop_incomplete(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "toxic"), ["toxic"])


@query("P4_zero_fill", "SELECT doc_id, CASE WHEN toxic IS NULL OR toxic = 0 THEN 0.0 ELSE 1.0 / toxic END AS v FROM documents LEFT JOIN labels USING (doc_id)")
def p4(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    v = F.when(F.col("toxic") == 0, F.lit(float("nan"))).otherwise(1.0 / F.col("toxic"))
    return C.zero_fill(t.select("doc_id", v.alias("v")), ["v"])


@query("P5_count_sentinels", "SELECT 'o_orderstatus' AS column_name, count(*) FILTER (trim(o_orderstatus) = 'F') AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(*) FILTER (trim(o_orderpriority) = 'F') FROM orders")
def p5(spark, d):
    return C.count_sentinels(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "F")


@query("P6_map_encode", "SELECT o_orderkey, CASE trim(o_orderstatus) WHEN 'F' THEN 1 ELSE 0 END AS y FROM orders WHERE trim(o_orderstatus) IN ('F', 'O')")
def p6(spark, d):
    return C.map_encode(table(spark, d, "orders"), "o_orderstatus", {"F": 1, "O": 0}, "y").select("o_orderkey", "y")


@query("P7_ordinal_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def p7(spark, d):
    return C.ordinal_encode(table(spark, d, "orders"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("P8_detect_task", "SELECT n_distinct, CASE WHEN n_distinct = 2 THEN 'binary_classification' WHEN n_distinct <= 100 THEN 'multiclass_classification' ELSE 'regression' END AS task FROM (SELECT count(DISTINCT l_returnflag) AS n_distinct FROM lineitem)")
def p8(spark, d):
    return C.detect_task(table(spark, d, "lineitem"), "l_returnflag")


_Q10 = "(SELECT list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM {t})"


def _quantile_sql(column: str, source: str) -> str:
    e = f"list_sort({_Q10.format(c=column, t=source)})"
    return f"CAST(len(list_filter({e}[2:-2], lambda v: v <= {column})) AS INTEGER)"


@query("P9_discretise_target", f"SELECT o_orderkey, {_quantile_sql('o_totalprice', 'orders')} AS code FROM orders")
def p9(spark, d):
    return C.discretise_target(table(spark, d, "orders"), "o_totalprice", "code").select("o_orderkey", "code")


@query("P10_equi_width_bins", f"SELECT {K}, {bin_sql('l_quantity')} AS l_quantity, {bin_sql('l_extendedprice')} AS l_extendedprice FROM lineitem")
def p10(spark, d):
    return C.equi_width(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 10).select(*KEYS, "l_quantity", "l_extendedprice")


@query("P11_quantile_bins", f"SELECT {K}, {_quantile_sql('l_extendedprice', 'lineitem')} AS l_extendedprice, {_quantile_sql('l_discount', 'lineitem')} AS l_discount FROM lineitem")
def p11(spark, d):
    return C.quantile_bins(table(spark, d, "lineitem"), ["l_extendedprice", "l_discount"], 10).select(*KEYS, "l_extendedprice", "l_discount")


@query("P12_constant_columns", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(stddev_pop({c}), 6) AS sd, stddev_pop({c}) <= 1e-10 AS is_constant FROM lineitem" for c in FEATURES))
def p12(spark, d):
    return rounded(C.constant_columns(table(spark, d, "lineitem"), FEATURES), "sd")


@query("P13_fold_predicate", "SELECT o_orderkey, o_orderkey % 5 AS fold FROM orders WHERE o_orderkey % 5 <> 2")
def p13(spark, d):
    return C.split_fold(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("fold")), 2)[0]


@query("P17_first_by_index", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def p17(spark, d):
    return C.first_by_index(table(spark, d, "events"), [], "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("P18_is_correct", "SELECT o_orderkey, abs(o_totalprice - o_custkey * 100) / greatest(o_totalprice, 1e-8) < 0.1 AS number_ok, o_orderstatus = 'F' AS class_ok FROM orders")
def p18(spark, d):
    t = table(spark, d, "orders")
    price, guess = F.col("o_totalprice").cast("string"), (F.col("o_custkey") * 100).cast("string")
    return t.select("o_orderkey", S.is_correct(F.lit("regression"), price, guess).alias("number_ok"), S.is_correct(F.lit("classification"), F.col("o_orderstatus"), F.lit("F")).alias("class_ok"))


@query("P20_near_zero_sign", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount - 0.05 > 0.001 THEN 1 WHEN l_discount - 0.05 < -0.001 THEN -1 ELSE 0 END AS s FROM lineitem")
def p20(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.near_zero_sign(F.col("l_discount") - 0.05, 0.001).alias("s"))


@query("P24_json_safe", "SELECT doc_id, coalesce(CAST(toxic AS DOUBLE), -999.0) AS v FROM documents LEFT JOIN labels USING (doc_id)")
def p24(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", S.null_if_not_finite(F.col("toxic").cast("double"), -999.0).alias("v"))


_KEY = "md5('42|' || {})"


@query("K1_stratified_folds", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def k1(spark, d):
    return C.stratified_folds(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "fold")


@query("K2_plain_folds", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def k2(spark, d):
    return C.stratified_folds(table(spark, d, "orders"), None, ["o_orderkey"]).select("o_orderkey", "fold")


@query(
    "K3_stratified_sample",
    """WITH s AS (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1), f AS (SELECT *, 1000.0 * c / sum(c) OVER () AS sh, floor(1000.0 * c / sum(c) OVER ()) AS fl FROM s),
q AS (SELECT o_orderstatus, fl + CASE WHEN row_number() OVER (ORDER BY round(sh - fl, 9) DESC, o_orderstatus) <= 1000 - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM f)
SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, quota, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r FROM orders JOIN q USING (o_orderstatus)) WHERE r <= quota""",
)
def k3(spark, d):
    return C.stratified_sample(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"], 1000).select("o_orderkey", "o_orderstatus")


@query(
    "K4_class_quota_sample",
    "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS c, count(*) OVER () AS n FROM orders) WHERE r <= greatest(1, floor(500.0 * c / n))",
)
def k4(spark, d):
    return C.class_quota_sample(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"], 500).select("o_orderkey", "o_orderstatus")


@query("K5_uniform_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 300")
def k5(spark, d):
    return C.uniform_sample(table(spark, d, "orders"), ["o_orderkey"], 300).select("o_orderkey")


@query("W8_systematic_sample", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, greatest(1.0, count(*) OVER () / 2000.0) AS st FROM orders) SELECT o_orderkey FROM r WHERE floor(ceil(i / st) * st) = i")
def w8(spark, d):
    return C.systematic_sample(table(spark, d, "orders"), ["o_orderkey"], 2000).select("o_orderkey")


@query("W9_enumerate_rows", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders")
def w9(spark, d):
    return C.enumerate_rows(table(spark, d, "orders"), ["o_orderkey"], "i", ["o_custkey"]).select("o_custkey", "o_orderkey", "i")


@query("M15_min_max_scale", "WITH f AS (SELECT min(l_quantity) AS lo, max(l_quantity) - min(l_quantity) AS w FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - lo) / w, 6) AS l_quantity FROM lineitem, f WHERE l_orderkey % 5 = 0")
def m15(spark, d):
    train, test = C.split_fold(table(spark, d, "lineitem").withColumn("fold", F.col("l_orderkey") % 5), 0)
    return rounded(C.scale(train, test, ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_quantity")


@query("S14_validate", "SELECT 'null_o_orderkey' AS check_name, count(*) FILTER (o_orderkey IS NULL) AS n_bad FROM orders UNION ALL SELECT 'null_o_totalprice', count(*) FILTER (o_totalprice IS NULL) FROM orders UNION ALL SELECT 'not_finite_o_totalprice', count(*) FILTER (NOT isfinite(o_totalprice)) FROM orders UNION ALL SELECT 'fold_out_of_range', count(*) FILTER (o_orderkey % 7 > 4) FROM orders")
def s14(spark, d):
    return C.validate(table(spark, d, "orders").withColumn("fold", F.col("o_orderkey") % 7), ["o_orderkey", "o_totalprice"])


@query("A6_mutual_information", f"WITH {MI} SELECT i, j, round(mi, 6) AS mi FROM mi")
def a6(spark, d):
    return rounded(I.pair_information(coded(spark, d), FEATURES, "label", 10), "mi")


@query("A7_coi_edges", f"WITH {COI} SELECT i, j, round(coi, 6) AS coi FROM coi")
def a7(spark, d):
    return rounded(edges(spark, d), "coi")


@query(
    "A11_sign_distribution",
    f"""WITH {COI} SELECT count(*) AS n, count(*) FILTER (coi > 0.001) AS n_pos, count(*) FILTER (coi < -0.001) AS n_neg, count(*) FILTER (abs(coi) <= 0.001) AS n_zero,
    count(*) FILTER (coi > 0.001) / count(*) AS frac_pos, round(avg(coi), 6) AS mean, round(stddev_pop(coi), 6) AS sd, round(quantile_cont(coi, 0.5), 6) AS median,
    round(quantile_cont(coi, 0.75) - quantile_cont(coi, 0.25), 6) AS iqr, round(quantile_cont(coi, 0.1), 6) AS p10, round(quantile_cont(coi, 0.9), 6) AS p90,
    round(avg(abs(coi)), 6) AS abs_mean, round(max(coi) - min(coi), 6) AS ptp FROM coi""",
)
def a11(spark, d):
    return rounded(I.sign_distribution(edges(spark, d)), "mean", "sd", "median", "iqr", "p10", "p90", "abs_mean", "ptp")


@query("P23_keep_strongest", f"WITH {COI} SELECT i, j, round(coi, 6) AS coi FROM coi WHERE abs(coi) >= (SELECT quantile_cont(abs(coi), 0.5) FROM coi)")
def p23(spark, d):
    return rounded(I.keep_strongest(edges(spark, d), 0.5), "coi")


_AGREED = ["pearson", "pearson_abs", "spearman", "kendall", "sign_agreement", "sign_flip_rate"]
_AGREE = """j AS (SELECT a.coi AS x, b.coi AS y FROM coi a JOIN other b USING (i, j)), rk AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j),
kt AS (SELECT sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))) AS tau FROM j p, j q)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(abs(x), abs(y)), 6) AS pearson_abs, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS spearman, round(max(tau), 6) AS kendall,
    round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement, round(avg(CASE WHEN abs(x) > 0.001 THEN CASE WHEN sign(x) <> sign(y) THEN 1.0 ELSE 0.0 END END), 6) AS sign_flip_rate FROM rk, kt"""


@query("A13_estimator_agreement", f"WITH {COI}, {QUANTILE_CODES}, {coi_of('quantile_codes', 'other')}, {_AGREE}")
def a13(spark, d):
    quantile = I.co_information(C.quantile_bins(matrix(spark, d), FEATURES, 10), FEATURES, "label", 10)
    return rounded(I.agreement(edges(spark, d), quantile, ["i", "j"]), *_AGREED)


_PART = f"""s AS (SELECT label, count(*) AS c FROM codes GROUP BY 1), f AS (SELECT *, 2000.0 * c / sum(c) OVER () AS sh, floor(2000.0 * c / sum(c) OVER ()) AS fl FROM s),
q AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY round(sh - fl, 9) DESC, label) <= 2000 - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM f),
part AS (SELECT * FROM (SELECT codes.*, quota, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), {K}) AS r FROM codes JOIN q USING (label)) WHERE r <= quota)"""


@query("A14_subsample_stability", f"WITH {COI}, {_PART}, {coi_of('part', 'other')}, {_AGREE}")
def a14(spark, d):
    part = C.stratified_sample(coded(spark, d), "label", KEYS, 2000)
    return rounded(I.agreement(edges(spark, d), I.co_information(part, FEATURES, "label", 10), ["i", "j"]), *_AGREED)


@query("A8_knn_co_information")
def a8(spark, d):
    return rounded(I.knn_co_information(matrix(spark, d), FEATURES, "label"), "coi")


@query("A16_balanced_accuracy", "SELECT l_linestatus, round(avg(r), 6) AS balanced_accuracy FROM (SELECT l_linestatus, l_returnflag, avg(CASE WHEN l_returnflag = CASE WHEN l_quantity > 25 THEN 'N' ELSE 'R' END THEN 1.0 ELSE 0.0 END) AS r FROM lineitem GROUP BY ALL) GROUP BY ALL")
def a16(spark, d):
    t = table(spark, d, "lineitem").withColumn("p", F.when(F.col("l_quantity") > 25, "N").otherwise("R"))
    return rounded(M.balanced_accuracy(t, "l_returnflag", "p", ["l_linestatus"]), "balanced_accuracy")


@query(
    "A17_roc_auc",
    """WITH r AS (SELECT l_linestatus, l_returnflag = 'R' AS pos, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0 AS rk FROM lineitem),
s AS (SELECT l_linestatus, sum(CASE WHEN pos THEN rk ELSE 0 END) AS r, CAST(count(*) FILTER (pos) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1)
SELECT l_linestatus, CASE WHEN p > 0 AND p < n THEN round((r - p * (p + 1) / 2) / (p * (n - p)), 6) END AS auc FROM s""",
)
def a17(spark, d):
    return rounded(M.roc_auc(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", "l_extendedprice", ["l_linestatus"]), "auc")


_ONE = " UNION ALL ".join(f"SELECT '{c}' AS c, l_linestatus AS g, l_returnflag = '{c}' AS pos, CAST({s} AS DOUBLE) AS s FROM lineitem" for c, s in (("A", "l_extendedprice"), ("N", "l_quantity"), ("R", "l_discount")))


@query(
    "A17_weighted_auc",
    f"""WITH o AS ({_ONE}), r AS (SELECT c, g, pos, rank() OVER (PARTITION BY c, g ORDER BY s) + (count(*) OVER (PARTITION BY c, g, s) - 1) / 2.0 AS rk FROM o),
a AS (SELECT c, g, sum(CASE WHEN pos THEN rk ELSE 0 END) AS r, CAST(count(*) FILTER (pos) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY ALL)
SELECT g AS l_linestatus, CASE WHEN bool_and(p > 0 AND p < n) THEN round(sum(CASE WHEN p > 0 AND p < n THEN (r - p * (p + 1) / 2) / (p * (n - p)) * p END) / sum(p), 6) END AS auc FROM a GROUP BY 1""",
)
def a17w(spark, d):
    scores = {"A": "l_extendedprice", "N": "l_quantity", "R": "l_discount"}
    return rounded(M.weighted_auc(table(spark, d, "lineitem"), "l_returnflag", scores, ["l_linestatus"]), "auc")


@query("A18_r_squared", "SELECT l_returnflag, round(1 - sum(power(l_extendedprice - l_quantity * 2000, 2)) / (count(*) * var_pop(l_extendedprice)), 6) AS r2 FROM lineitem GROUP BY 1")
def a18(spark, d):
    t = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 2000)
    return rounded(M.r_squared(t, "l_extendedprice", "p", ["l_returnflag"]), "r2")


_ARI = """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2.0) AS t, sum(n) AS n FROM c),
p AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)), q AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((t - p.v * q.v / (n * (n - 1) / 2.0)) / ((p.v + q.v) / 2 - p.v * q.v / (n * (n - 1) / 2.0)), 6) AS ari FROM x, p, q"""


@query("A19_adjusted_rand", _ARI)
def a19(spark, d):
    return rounded(M.adjusted_rand(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), "ari")


_LABELS = "p AS (SELECT n_nationkey AS f, n_nationkey % 5 AS l FROM nation), t AS (SELECT n_nationkey AS f, n_regionkey AS l FROM nation WHERE n_nationkey < 20)"
_PAIRS = "pp AS (SELECT a.f AS i, b.f AS j FROM p a JOIN p b ON a.l = b.l AND a.f < b.f), tp AS (SELECT a.f AS i, b.f AS j FROM t a JOIN t b ON a.l = b.l AND a.f < b.f)"


def _labels(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("feature"), (F.col("n_nationkey") % 5).alias("label")), n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("feature"), F.col("n_regionkey").alias("label"))


@query("A20_pair_jaccard", f"WITH {_LABELS}, {_PAIRS}, b AS (SELECT count(*) AS n_both FROM (SELECT * FROM pp INTERSECT SELECT * FROM tp)), e AS (SELECT count(*) AS n_either FROM (SELECT * FROM pp UNION SELECT * FROM tp)) SELECT n_both, n_either, CAST(n_both AS DOUBLE) / n_either AS jaccard FROM b, e")
def a20(spark, d):
    return M.pair_jaccard(*_labels(spark, d), only_truth_items=False)


@query("A20_pair_jaccard_masked", f"WITH {_LABELS.replace('FROM nation), t', 'FROM nation WHERE n_nationkey < 20), t')}, {_PAIRS}, b AS (SELECT count(*) AS n_both FROM (SELECT * FROM pp INTERSECT SELECT * FROM tp)), e AS (SELECT count(*) AS n_either FROM (SELECT * FROM pp UNION SELECT * FROM tp)) SELECT n_both, n_either, CAST(n_both AS DOUBLE) / n_either AS jaccard FROM b, e")
def a20m(spark, d):
    return M.pair_jaccard(*_labels(spark, d), only_truth_items=True)


@query("A21_whole_modules", "SELECT avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS recovered FROM (SELECT n_regionkey, count(DISTINCT n_nationkey % 3) AS k FROM nation GROUP BY 1)")
def a21(spark, d):
    n = table(spark, d, "nation")
    return M.whole_modules(n.select(F.col("n_regionkey").alias("module"), F.col("n_nationkey").alias("feature")), n.select(F.col("n_nationkey").alias("feature"), (F.col("n_nationkey") % 3).alias("label")))


_SILHOUETTE = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), c AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
m AS (SELECT vec_id, own, max(CASE WHEN own = other THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p JOIN c ON c.label = p.other GROUP BY ALL)
SELECT round(sum(CASE WHEN c.n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) / count(*), 6) AS silhouette FROM m JOIN c ON c.label = m.own"""


@query("A22_silhouette", _SILHOUETTE)
def a22(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(M.silhouette(e, "label", "v", "vec_id"), "silhouette")


@query(
    "A31_spearman",
    """WITH r AS (SELECT o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2.0 AS y FROM orders)
SELECT o_orderstatus, round(corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)), 6) AS rho, count(*) AS n FROM r GROUP BY 1""",
)
def a31(spark, d):
    return rounded(M.spearman(table(spark, d, "orders"), "o_totalprice", "o_custkey", ["o_orderstatus"]), "rho")


@query("A31_kendall_tau", "WITH n AS (SELECT s_suppkey AS k, s_acctbal AS x, s_nationkey AS y FROM supplier) SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(sign(a.x - b.x) * sign(a.x - b.x)) * sum(sign(a.y - b.y) * sign(a.y - b.y))), 6) AS tau FROM n a JOIN n b ON a.k < b.k")
def a31k(spark, d):
    return rounded(M.kendall_tau(table(spark, d, "supplier"), "s_acctbal", "s_nationkey"), "tau")
