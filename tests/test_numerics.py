"""Invariants of the numerics and of operators that SQL can't say."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlake.functions import tails
from loomlake.operators import clean, hypothesis, information, linalg, metrics, results, trees
from loomlake.sources import nested, synthetic


def test_tails():
    assert tails.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_sf(37.10, 7) == pytest.approx(4.5e-6, rel=0.1)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert tails.sign_test(8, 2) == pytest.approx(0.109375)
    assert tails.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)
    assert tails.nemenyi_distance(8, 7) == pytest.approx(3.97, abs=0.01)


@given(st.integers(3, 9), st.integers(0, 10_000))
@settings(max_examples=30, deadline=None)
def test_laplacians(n, seed):
    w = np.random.default_rng(seed).normal(size=(n, n))
    w = np.triu(w, 1) + np.triu(w, 1).T
    g = linalg.SignedGraph.of(w)
    assert np.allclose(g.absolute_laplacian().sum(1), 0)
    assert np.linalg.eigvalsh(g.signed_laplacian())[0] > -1e-9
    values, vectors = linalg.sponge(w)
    assert np.all(np.diff(values) >= -1e-9) and vectors.shape == (n, n)
    assert linalg.frustration(w)["clipped_ratio"] >= 0


def test_clusters_of_two_blocks():
    w = np.full((6, 6), 0.02)
    w[:3, :3] = w[3:, 3:] = 1.0
    np.fill_diagonal(w, 0)
    truth = np.array([0, 0, 0, 1, 1, 1])
    assert linalg.rand_index(truth, linalg.spectral(w, 2)) == 1
    assert linalg.rand_index(truth, linalg.signed_clusters(-w, 2)) == 1
    assert linalg.subspace_similarity(np.eye(4)[:, :2], np.eye(4)[:, :2])["mean_cos2"] == pytest.approx(1)


def test_decay_fit():
    x = np.arange(1, 9.0)
    assert hypothesis.decay_fit(list(x), list(3 * np.exp(-0.5 * x))) == pytest.approx((3, 0.5))


def test_planted_xor_is_synergy(spark):
    t = synthetic.planted(spark, 4000, 4, [("xor", [0, 1])], 0.0)
    codes = clean.quantile_bins(t, ["X0", "X1", "X2"], 10)
    found = {(r.i, r.j): r.coi for r in information.co_information(codes, ["X0", "X1", "X2"], "output", 10).collect()}
    assert found[0, 1] < -0.3 and found[0, 1] < found[0, 2]
    knn = {(r.i, r.j): r.coi for r in information.knn_co_information(t, ["X0", "X1", "X2"], "output", most_rows=800).collect()}
    assert knn[0, 1] < -0.2 and abs(knn[0, 2]) < 0.15


def test_tree_leaves_are_means_and_gain_is_the_fall_of_errors(spark):
    t = synthetic.planted(spark, 2000, 3, [("and", [0, 1])], 0.1).withColumn("y", F.col("output").cast("double")).cache()
    m = trees.grow(t, trees.candidates_for(["X0", "X1", "X2"], "axis"), "y", 4)
    leaves = t.groupBy(F.round(m.predict(), 9).alias("p")).agg(F.round(F.avg("y"), 9).alias("y"), F.count(F.lit(1)).alias("n")).collect()
    assert all(math.isclose(r.p, r.y, abs_tol=1e-6) for r in leaves) and sum(r.n for r in leaves) == 2000
    best = trees.best_splits(trees.split_gains(t, {"X0": F.col("X0")}, "y")).first()
    left = F.col("X0") <= best["threshold"]
    sse = lambda df: df.agg(F.var_pop("y") * F.count(F.lit(1))).first()[0]
    assert best["gain"] == pytest.approx(sse(t) - sse(t.where(left)) - sse(t.where(~left)), rel=1e-6)


def test_ridge_direction(spark):
    t = spark.range(500).select(F.randn(1).alias("a"), F.randn(2).alias("b")).withColumn("y", 2 * F.col("a") - F.col("b"))
    assert trees.ridge_direction(t, ("a", "b"), "y", (0.01, 0.1, 1.0)) == pytest.approx((2, -1), abs=0.01)


def test_metrics_on_edge_cases(spark):
    t = spark.createDataFrame([(1, 0.2, 0), (1, 0.2, 1), (1, 0.9, 1)], "g int, s double, y int")
    assert metrics.roc_auc(t, F.col("y") == 1, "s", ["g"]).first()["auc"] == pytest.approx(0.75)
    assert metrics.adjusted_rand(t, "y", "y").first()["ari"] == 1
    assert metrics.roc_auc(t.where("y = 1"), F.col("y") == 1, "s", ["g"]).first()["auc"] is None


def test_nulls_and_empty_tables(spark):
    t = spark.createDataFrame([("a", None), ("b", 0.02), ("c", 0.01), ("d", float("nan"))], "m string, p double")
    assert {r.m: r.p_holm for r in results.holm(t, "p", ["m"]).collect()} == {"a": None, "b": 0.02, "c": 0.02, "d": None}
    empty = t.where("false")
    assert results.pareto(empty.withColumn("q", F.lit(1.0)), "p", "q").count() == 0
    assert clean.quantile_bins(t.where("m = 'b'"), ["p"], 4).first()["p"] == 0
    assert clean.first_by_index(spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "z")], "i int, v string"), [], "i", ["v"]).count() == 3


def test_nested_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"datasets":[{"dataset":"d","examples":[{"input":"{\\"x\\":1.5,\\"y\\":\\"oops\\"}","output":"1","metadata_fold":0,"metadata_row_index":7},{"input":"{}","output":"0","metadata_fold":1}]}]}')
    (tmp_path / "b.json").write_text('{"datasets":[{"dataset":"e","examples":[]}]}')
    rows = nested.parse_input(nested.read_examples(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]), ["x", "y"], lenient=True).orderBy("position").collect()
    assert [(r.dataset, r.x, r.y) for r in rows] == [("d", 1.5, 0.0), ("d", 0.0, 0.0)]
    (tmp_path / "l.jsonl").write_text('{"input":{"x":1.0},"output":1}\n\n{"broken\n')
    assert nested.read_lines(spark, str(tmp_path / "l.jsonl")).count() == 1


def test_large_documents_are_not_carried_by_each_example(spark, tmp_path):
    df = spark.range(0, 1000, 1, 3).select(F.when(F.col("id") % 10 > 0, F.lit("d")).alias("d"), "id")
    example = F.struct(F.lit("{}").alias("input"), F.col("id").alias("metadata_row_index"))
    docs = nested.example_documents(df, "d", example, 100)
    assert docs.agg(F.max(F.size(F.col("datasets")[0]["examples"]))).first()[0] <= 100
    docs.write.option("maxRecordsPerFile", 1).json(str(tmp_path / "docs"))
    (tmp_path / "docs" / "more.json").write_text('{"datasets":[{"dataset":"none"},{"dataset":"e","examples":[{"metadata_row_index":-1},{"metadata_row_index":-2}]}]}')
    every = nested.read_examples(spark, str(tmp_path / "docs"))
    rows = every.collect()
    assert sorted((r.metadata_row_index, r.dataset) for r in rows) == [(-2, "e"), (-1, "e"), *((i, "d" if i % 10 else None) for i in range(1000))]
    assert [r.position for r in rows if r.dataset == "e"] == [0, 1] and len({r.part for r in rows}) == docs.count() + 1
    plan = every.select("dataset", "metadata_row_index")._jdf.queryExecution().executedPlan().toString()
    kept = [x.split("), [")[1].split("]")[0] for x in plan.splitlines() if "Generate " in x and "), [" in x and "), [position" not in x]
    assert "Generate" in plan and not any(kept)  # beside the example
