"""Queries of the remaining operators: reports, k-selection, variants of trees, round trips of sources and sinks."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from ..functions.shared import new_path
from ..functions.tails import sign_test
from ..operators import clean as C
from ..operators import graph as G
from ..operators import hypothesis as H
from ..operators import information as I
from ..operators import linalg as L
from ..operators import results as R
from ..operators import trees as T
from ..sources import nested as N
from ..sources import synthetic
from .inputs import COI, FEATURES, METHOD_MEANS, RUNS, coded, coi_of, edges, matrix, means, rounded, runs, table
from .results import PAIRS, pairs

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def shared(spark, name: str) -> str:
    return new_path(spark, name)


_TRUTH = "truth AS (SELECT i, j, CASE WHEN i = 0 AND j = 1 THEN 'synergy' WHEN j = 3 THEN 'noise' ELSE 'unknown' END AS kind FROM coi)"


@query("A12_pair_report", f"WITH {COI}, {_TRUTH} SELECT kind, count(*) AS n, round(avg(coi), 6) AS mean_coi, avg(CASE WHEN coi < 0 THEN 1.0 ELSE 0.0 END) AS share_negative FROM coi JOIN truth USING (i, j) GROUP BY 1")
def a12(spark, d):
    kind = F.when((F.col("i") == 0) & (F.col("j") == 1), "synergy").when(F.col("j") == 3, "noise").otherwise("unknown")
    e = edges(spark, d).withColumn("kind", kind)
    return rounded(e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("coi").alias("mean_coi"), F.avg((F.col("coi") < 0).cast("double")).alias("share_negative")), "mean_coi")


def _seed(k: int) -> str:
    return f"p{k} AS (SELECT * FROM codes ORDER BY md5('{k}|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey LIMIT 2000), {coi_of(f'p{k}', f'c{k}')}"


@query(
    "A15_reproducibility",
    f"WITH {COI}, {_seed(1)}, {_seed(2)}, {_seed(3)}, u AS (SELECT 1 AS seed, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3), f AS (SELECT *, first_value(sign(coi)) OVER (PARTITION BY i, j ORDER BY seed) AS s FROM u) SELECT i, j, round(CASE WHEN abs(avg(coi)) > 1e-6 THEN stddev_pop(coi) / abs(avg(coi)) END, 6) AS cv, round(avg(CASE WHEN sign(coi) = s THEN 1.0 ELSE 0.0 END), 6) AS same_sign FROM f GROUP BY i, j",
)
def a15(spark, d):
    parts = [I.co_information(C.uniform_sample(coded(spark, d), ["l_orderkey", "l_linenumber", "l_partkey"], 2000, seed), FEATURES, "label", 10).withColumn("seed", F.lit(seed)) for seed in (1, 2, 3)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(I.reproducibility(every, ["i", "j"], "seed"), "cv", "same_sign")


@query("A32_interaction_term", "SELECT l_orderkey, l_linenumber, l_partkey, sign(l_quantity - 25) * sign(l_discount - 0.05) AS xor, CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 1.0 ELSE -1.0 END AS both_high FROM lineitem")
def a32(spark, d):
    t = table(spark, d, "lineitem").withColumn("a", F.col("l_quantity") - 25).withColumn("b", F.col("l_discount") - 0.05)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", synthetic.xor_term(["a", "b"]).alias("xor"), F.when(F.forall(F.array(F.col("l_quantity") > 25, F.col("l_discount") > 0.05), lambda x: x), 1.0).otherwise(-1.0).alias("both_high"))


@query("A33_sanity", "SELECT round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 6) AS balance, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) BETWEEN 0.35 AND 0.65 AS balanced, round(corr(l_quantity, l_extendedprice), 6) AS redundancy FROM lineitem")
def a33(spark, d):
    share = F.avg((F.col("l_returnflag") == "N").cast("double"))
    return rounded(table(spark, d, "lineitem").agg(share.alias("balance"), share.between(0.35, 0.65).alias("balanced"), F.corr("l_quantity", "l_extendedprice").alias("redundancy")), "balance", "redundancy")


@query("A9_knn_clipped_bits")
def a9(spark, d):
    return rounded(I.knn_co_information(matrix(spark, d), FEATURES, "label", clip=True, base=2.0), "coi")


@query("G10_stability_k")
def g10(spark, d):
    w = G.dense(edges(spark, d), len(FEATURES))
    return spark.createDataFrame([(L.stability_k(w, [2, 3]),)], "k int")


@query("G14_subspace_similarity")
def g14(spark, d):
    w = G.dense(edges(spark, d), len(FEATURES))
    found = L.subspace_similarity(L.sponge(-w)[1][:, :2], np.linalg.eigh(L.SignedGraph.laplacian(np.abs(w)))[1][:, :2])
    return rounded(spark.createDataFrame(sorted(found.items()), "measure string, value double"), "value")


@query("G18_sparsified_clusters")
def g18(spark, d):
    w = L.sparsified(G.dense(edges(spark, d), len(FEATURES)), share=0.5)
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(L.signed_clusters(w, 2))], "node int, label int")


def _binary(spark, d):
    return matrix(spark, d).withColumn("y", (F.col("label") == "R").cast("double"))


_MOMENTS = "m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM b), g AS (SELECT 1 + sum((a - ma) * (a - ma)) AS aa, 1 + sum((b - mb) * (b - mb)) AS bb, 1 + sum((c - mc) * (c - mc)) AS cc, sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (c - mc)) AS ac, sum((b - mb) * (c - mc)) AS bc, sum((a - ma) * (y - my)) AS ya, sum((b - mb) * (y - my)) AS yb, sum((c - mc) * (y - my)) AS yc FROM b, m)"
_DETERMINANT = "aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac)"
_LEVELS = "[0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]"


@query("M3_split_gains_leafwise", f"WITH b AS (SELECT l_quantity AS x, l_linestatus AS leaf, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), t AS (SELECT leaf, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM b GROUP BY 1), q AS (SELECT DISTINCT leaf, unnest(quantile_cont(x, {_LEVELS})) AS threshold FROM b GROUP BY leaf), g AS (SELECT leaf, threshold, CAST(count(*) FILTER (x <= threshold) AS DOUBLE) AS nl, CAST(coalesce(sum(y) FILTER (x <= threshold), 0) AS DOUBLE) AS sl FROM b JOIN q USING (leaf) GROUP BY ALL) SELECT leaf, threshold, round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n, 5) AS gain FROM g JOIN t USING (leaf) WHERE nl >= 2 AND n - nl >= 2")
def m3(spark, d):
    t = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    gains = T.split_gains(t, {"x": F.col("l_quantity")}, "y", F.col("l_linestatus"), tuple(i / 10 for i in range(2, 9)), 2)
    return rounded(gains.select("leaf", "threshold", "gain"), "gain", digits=5)


@query(
    "M4_ridge_direction",
    f"""WITH b AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b, CAST(l_discount AS DOUBLE) AS c, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), {_MOMENTS}
SELECT 'l_quantity' AS feature, round((ya * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc)) / ({_DETERMINANT}), 6) AS weight FROM g
UNION ALL SELECT 'l_extendedprice', round((aa * (yb * cc - bc * yc) - ya * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac)) / ({_DETERMINANT}), 6) FROM g
UNION ALL SELECT 'l_discount', round((aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - bb * ac)) / ({_DETERMINANT}), 6) FROM g""",
)
def m4(spark, d):
    w = T.ridge_direction(_binary(spark, d), tuple(FEATURES[:3]), "y")
    return spark.createDataFrame([(f, round(x, 6)) for f, x in zip(FEATURES, w, strict=False)], "feature string, weight double")


#: Of a penalty: weights w = (G + a I)^-1 t, error syy - w t - a w w, and degrees 3 - a trace (G + a I)^-1.
_PENALTIES = f"""WITH b AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b, CAST(l_discount AS DOUBLE) AS c, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), {_MOMENTS},
p AS (SELECT z.p, (SELECT n FROM m) AS n, (SELECT sum((y - my) * (y - my)) FROM b, m) AS yy, aa - 1 + z.p AS aa, bb - 1 + z.p AS bb, cc - 1 + z.p AS cc, ab, ac, bc, ya, yb, yc FROM g, (VALUES (0.01), (0.1), (1.0), (10.0)) z(p)),
q AS (SELECT *, {_DETERMINANT} AS det FROM p),
w AS (SELECT *, (ya * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc)) / det AS w1, (aa * (yb * cc - bc * yc) - ya * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac)) / det AS w2,
    (aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - bb * ac)) / det AS w3, 3 - p * (bb * cc - bc * bc + aa * cc - ac * ac + aa * bb - ab * ab) / det AS freedom FROM q),
best AS (SELECT * FROM w ORDER BY (yy - w1 * ya - w2 * yb - w3 * yc - p * (w1 * w1 + w2 * w2 + w3 * w3)) / n / power(1 - (1 + freedom) / n, 2), p LIMIT 1)
SELECT 'l_quantity' AS feature, round(w1, 6) AS weight FROM best UNION ALL SELECT 'l_extendedprice', round(w2, 6) FROM best UNION ALL SELECT 'l_discount', round(w3, 6) FROM best"""


@query("M5_ridge_penalties", _PENALTIES)
def m5(spark, d):
    w = T.ridge_direction(_binary(spark, d), tuple(FEATURES[:3]), "y", (0.01, 0.1, 1.0, 10.0))
    return spark.createDataFrame([(f, round(x, 6)) for f, x in zip(FEATURES, w, strict=False)], "feature string, weight double")


@query("M6_candidates")
def m6(spark, d):
    rows = [(s, list(c)) for s in ("axis", "random", "modules") for c in T.candidates_for(FEATURES, s, [FEATURES[:3]])]
    return spark.createDataFrame(rows, "strategy string, features array<string>")


@query("M12_class_thresholds", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity / 50 >= 0.5 AS INTEGER) AS closed, CAST(l_quantity / 50 > 0.5 AS INTEGER) AS open FROM lineitem")
def m12(spark, d):
    p = F.col("l_quantity") / 50
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.to_class(p).alias("closed"), T.to_class(p, closed=False).alias("open"))


@query("M19_oblique_benefit")
def m19(spark, d):
    df = _binary(spark, d).withColumn("fold", (F.col("l_orderkey") % 5).cast("int"))
    both = {"axis": T.candidates_for(FEATURES, "axis"), "oblique": T.candidates_for(FEATURES, "modules", [FEATURES[:2]])}
    cv = T.cross_validate(df, both, "y", [2], folds=1)
    return rounded(R.paired(cv, "method", "axis", "oblique", ["max_splits", "fold"], "r2"), "a", "b", "delta")


@query("S1_read_array", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def s1(spark, d):
    path = shared(spark, "array")
    one = table(spark, d, "nation").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))).alias("value"))
    one.write.text(path)  # one document that is an array
    return N.read_array(spark, path, "k int, name string")


@query("S4_dataset_from_source", "SELECT p_partkey, regexp_extract(replace(p_name, ' ', '_'), '([^_]*)$', 1) AS dataset FROM part")
def s4(spark, d):
    return table(spark, d, "part").withColumn("source", F.replace("p_name", F.lit(" "), F.lit("_"))).select("p_partkey", N.dataset_from_source("source").alias("dataset"))


@query("S9_lines_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s9(spark, d):
    path = shared(spark, "lines")
    N.write_lines(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return N.read_lines(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query("S10_parts_round_trip", "SELECT o_orderkey, o_custkey FROM orders")
def s10(spark, d):
    path = shared(spark, "parts")
    N.write_parts(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey", 4000)
    return N.read_lines(spark, path, "o_orderkey bigint, o_custkey bigint")


@query("S11_mini", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3")
def s11(spark, d):
    return R.top_of_group(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", [], 3, descending=False).select("o_orderkey")


@query("S12_checkpoint_by_dataset", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def s12(spark, d):
    path = shared(spark, "checkpoint")
    N.write_by_dataset(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.parquet(path).where("o_orderstatus = 'F'")


@query("ST16_decay_fit")
def st16(spark, d):
    rows = runs(spark, d).groupBy("max_splits").agg(F.avg("score").alias("y")).orderBy("max_splits").collect()  # three settings
    a, b = H.decay_fit([r["max_splits"] for r in rows], [r["y"] for r in rows])
    return spark.createDataFrame([(round(a, 6), round(b, 8))], "a double, b double")


@query("ST17_sign_counts", f"WITH {PAIRS} SELECT dataset, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses FROM pairs GROUP BY 1")
def st17(spark, d):
    return pairs(spark, d).groupBy("dataset").agg(F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"))


@query("ST17_sign_test_p", f"WITH {PAIRS}, w AS (SELECT dataset, count(*) FILTER (delta > 0) AS w, count(*) FILTER (delta < 0) AS l FROM pairs GROUP BY 1) SELECT dataset, round(least(1.0, 2 * list_sum(list_transform(range(0, least(w, l) + 1), lambda i: exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1)))) / power(2.0, w + l)), 6) AS p FROM w")
def st17p(spark, d):
    rows = st17(spark, d).collect()  # a row for each dataset
    return rounded(spark.createDataFrame([(r["dataset"], sign_test(r["wins"], r["losses"])) for r in rows], "dataset string, p double"), "p")


@query("ST18_claims", f"WITH {METHOD_MEANS} SELECT dataset, count(*) FILTER (abs(0.42 - score) / abs(0.42) / 0.02 <= 1) AS n_match, count(*) AS n FROM means GROUP BY 1")
def st18(spark, d):
    from ..functions.scalar import claim_status

    status = claim_status(F.lit("relative"), F.lit(0.42), F.col("score"), F.lit(0.02))
    return means(spark, d).groupBy("dataset").agg(F.count_if(status == "MATCH").alias("n_match"), F.count(F.lit(1)).alias("n"))


@query("U6_distinct_subsets", "WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, list(event_type ORDER BY first) AS kinds FROM f GROUP BY 1")
def u6(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))  # one for each, so lists are short
    return first.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("first", "event_type")))["event_type"].alias("kinds"))


@query("U2_stacked_parts", "SELECT 0 AS part, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def u2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return R.stacked([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")])


@query("O5_top_gaps", f"WITH {RUNS}, m AS (SELECT method, avg(arity) AS v FROM runs GROUP BY 1), g AS (SELECT method, v - lag(v) OVER (ORDER BY v) AS gap FROM m) SELECT method, round(gap, 6) AS gap FROM g WHERE gap IS NOT NULL ORDER BY gap DESC LIMIT 3")
def o5(spark, d):
    m = runs(spark, d).groupBy("method").agg(F.avg("arity").alias("v"))
    gaps = R.gaps(m, ["v"], "v").where("gap IS NOT NULL").orderBy(F.desc("gap")).limit(3)
    return rounded(gaps.select("method", "gap"), "gap")


@query("O6_beam", f"WITH {COI}, s AS (SELECT i AS node, abs(coi) AS w FROM coi WHERE i < 3 AND j < 3 UNION ALL SELECT j, abs(coi) FROM coi WHERE i < 3 AND j < 3) SELECT node, round(sum(w), 6) AS strength FROM s GROUP BY 1 ORDER BY round(sum(w), 9) DESC, node LIMIT 2")
def o6(spark, d):
    inside = G.both_ways(edges(spark, d)).where("i < 3 and j < 3").groupBy(F.col("i").alias("node")).agg(F.sum(F.abs("w")).alias("strength"))
    return rounded(inside.orderBy(F.desc(F.round("strength", 9)), "node").limit(2), "strength")


@query("K7_feature_subsample", "SELECT n_nationkey FROM nation ORDER BY md5('42|' || n_nationkey), n_nationkey LIMIT 20")
def k7(spark, d):
    return C.uniform_sample(table(spark, d, "nation"), ["n_nationkey"], 20).select("n_nationkey")


