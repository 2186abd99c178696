"""Results that SQL can't say, against plain numpy on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.operators import clean, graph, hypothesis, linalg, ranges, trees
from loomlake.plans import catalog
from loomlake.sources import nested, synthetic

SF = "/root/testdata/sf0.001"


def frame(spark, x, y, names="abcd"):
    columns = list(names[: x.shape[1]])
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns) + ", y double").cache(), columns


def test_running_sums_and_numbers_over_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(v), int(n)) for k, v, n in zip(rng.integers(0, 3, 500), rng.permutation(500), rng.integers(1, 9, 500), strict=True)]
    df = spark.createDataFrame(rows, "k int, v double, n long").repartition(5)
    for r in ranges.running(df, ["k"], ["v"], ["n"]).collect():
        assert r.run_n == sum(n for k, v, n in rows if k == r.k and v <= r.v) and r.all_n == sum(n for k, _, n in rows if k == r.k)
    order = sorted(range(500), key=lambda i: rows[i][1])
    assert [r.v for r in ranges.numbered(df, ["v"], "i").orderBy("i").collect()] == [rows[i][1] for i in order]
    assert ranges.numbered(df.where("false"), ["v"], "i").count() == 0


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40 + [1.0], list(range(101)), [None, 4.0, 4.0, 9.5]])
def test_exact_quantiles(spark, values):
    levels = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double").withColumn("none", F.lit(None).cast("double"))
    found = ranges.exact_quantiles(df, ["v", "none"], levels)
    assert found["none"] == [] and found["v"] == pytest.approx(np.quantile([v for v in values if v is not None], levels))


def plain_tree(x, y, splits, depth=6, least=5):
    leaves, nodes = {0: np.arange(len(y))}, {0: 0}
    sizes = []
    for _ in range(splits):
        best = (1e-10, None)
        for leaf in sorted(leaves):
            at = leaves[leaf]
            if nodes[leaf] >= depth:
                continue
            for f in range(x.shape[1]):
                for cut in np.unique(np.quantile(x[at, f], [i / 10 for i in range(1, 10)])):
                    a, b = y[at][x[at, f] <= cut], y[at][x[at, f] > cut]
                    if min(len(a), len(b)) >= least:
                        gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - y[at].sum() ** 2 / len(at)
                        if gain > best[0] + 1e-9:
                            best = (gain, (leaf, f, cut))
        if best[1] is None:
            break
        leaf, f, cut = best[1]
        at, n = leaves.pop(leaf), len(nodes)
        leaves[n], leaves[n + 1] = at[x[at, f] <= cut], at[x[at, f] > cut]
        nodes[n] = nodes[n + 1] = nodes[leaf] + 1
        sizes.append((f, cut))
    out = np.zeros(len(y))
    for at in leaves.values():
        out[at] = y[at].mean()
    return out, sizes, [nodes[i] for i in leaves]


def test_tree_equals_a_plain_greedy_one(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 3)), 2)
    y = (x[:, 0] > 0.3) * 2.0 + (x[:, 1] > 0) * (x[:, 0] < 0) + 0.1 * rng.normal(size=400)
    df, names = frame(spark, x, y)
    m = trees.grow(df, trees.candidates_for(names, "axis"), "y", 4)
    want, sizes, depths = plain_tree(x, y, 4)
    assert np.allclose([r.p for r in df.orderBy("id").select(m.predict().alias("p")).collect()], want)
    inner = [v for v in m.nodes.values() if v.features]
    assert sorted((names.index(v.features[0]), round(v.threshold, 9)) for v in inner) == sorted((f, round(float(c), 9)) for f, c in sizes)
    row = trees.complexity(m.table(spark)).first()
    assert (row.n_splits, row.max_arity, row.mean_arity) == (len(sizes), 1, 1) and row.mean_leaf_depth == pytest.approx(np.mean(depths))


def test_late_roots_open_only_when_no_leaf_splits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    df, names = frame(spark, x, (x[:, 0] > 0) + 2.0 * (x[:, 1] > 0.4))
    only = trees.candidates_for(names, "axis")
    assert len(trees.grow_sum(df, only, "y", 3, depth=6, late_roots=3)) == 1
    shallow = trees.grow_sum(df, only, "y", 3, depth=1, late_roots=3)
    assert len(shallow) == 3 and all(sum(bool(v.features) for v in m.nodes.values()) == 1 for m in shallow)
    assert trees.grow_sum(df.withColumn("y", F.lit(1.0)), only, "y", 3, late_roots=3)[0].nodes[0].value == 1.0


def test_probabilities_and_classes(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5), (800.0, 0.0, -800.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    scores = [F.col(c) for c in "abc"]
    rows = df.select(*[p.alias(f"p{i}") for i, p in enumerate(trees.softmax(scores))], trees.top_class(scores, ["x", "y", "z"]).alias("k")).collect()
    for r, s in zip(rows, ([1, 2, 0.5], [800, 0, -800], [0, 0, 0]), strict=True):
        e = np.exp(np.array(s) - max(s))
        assert np.allclose(r[:3], e / e.sum())
    assert [r.k for r in rows] == ["y", "x", "x"]


def test_beams():
    weights = {("a", "b"): 5.0, ("a", "c"): -4.0, ("b", "c"): 0.1}
    assert trees.beam_subsets(list("abcdef"), [["a", "b", "c"], ["d"]], 2, 4, weights) == [("a", "b")]
    assert all({"a", "b", "c"} < set(s) and len(s) == 4 for s in trees.beam_subsets(list("abcdef"), [["a", "b", "c"]], 4, 5))
    assert all(len(s) == 3 for s in trees.beam_subsets(list("abcdef"), [], 3, 5))


def test_ridge_by_moments_and_baselines(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2]
    y = x @ [1.0, -0.3, 2.0] + rng.normal(size=300) + 4
    df, names = frame(spark, x, y)
    xc, yc = x - x.mean(0), y - y.mean()

    def solve(a):
        return np.linalg.solve(xc.T @ xc + a * np.eye(3), xc.T @ yc)

    assert np.allclose(trees.ridge_direction(df, tuple(names), "y"), solve(1.0))

    def gcv(a):
        hat = np.trace(xc @ np.linalg.inv(xc.T @ xc + a * np.eye(3)) @ xc.T)
        return ((yc - xc @ solve(a)) ** 2).sum() / 300 / (1 - (1 + hat) / 300) ** 2

    alphas = (0.01, 0.1, 1.0, 10.0)
    assert np.allclose(trees.ridge_direction(df, tuple(names), "y", alphas), solve(min(alphas, key=gcv)))
    w, at = trees.ridge_line(df, tuple(names), "y")
    assert np.allclose(w, solve(1.0)) and at == pytest.approx(y.mean() - x.mean(0) @ solve(1.0))
    two = df.withColumn("y", (F.col("y") > 4).cast("double"))
    m = trees.baseline(two, names, "y", "logistic").stages[-1]
    w, p = m.coefficients.toArray(), 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
    assert np.allclose(x.T @ ((y > 4) - p) - w, 0, atol=0.05)  # where the penalised likelihood is flat
    found = trees.baseline(two, names, "y", "forest", trees=20).transform(two)
    assert found.where("prediction = y").count() > 240


def planted_graph():
    w = np.full((9, 9), -0.05)
    for k in range(3):
        w[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] = 1.0
    np.fill_diagonal(w, 0)
    return w, np.repeat([0, 1, 2], 3)


def test_clusterings_find_three_blocks(spark):
    w, truth = planted_graph()
    for label in (linalg.signed_clusters(w, 3, sign=1), linalg.signed_clusters(w, 3, sign=1, normalised=False), linalg.signed_clusters(-w, 3), linalg.spectral(w, 3)):
        assert linalg.rand_index(truth, label) == 1
    values, vectors = np.linalg.eigh(linalg.SignedGraph.laplacian(np.maximum(w, 0), True))
    for first in (0, 1):
        k, label = linalg.choose_k_near(values, vectors, 6, first)
        assert k == 3 and linalg.rand_index(truth, label) == 1
    found = linalg.k_strategies(w, 3)
    assert set(found) == {"eigengap", "silhouette", "stability", "oracle"} and found["silhouette"] == found["oracle"] == 3
    assert linalg.signed_clusters(-w).max() == 2  # the count is chosen
    fixes = linalg.high_dim_fixes(-w, truth, 3)
    assert len(fixes) == 15 and max(a for _, _, a in fixes) == 1 and {f for f, _, _ in fixes} == {"sparsify", "tau", "threshold", "sparsify_and_tau", "threshold_and_tau"}
    grid, at = linalg.tau_grid(-w, truth, 3)
    assert grid.shape == (7, 7) and grid.max() == 1 and at[0] in (0.01, 0.1, 0.5, 1, 5, 10, 100)
    edges = spark.createDataFrame([(i, j, float(-w[i, j])) for i in range(9) for j in range(i + 1, 9)], "i int, j int, coi double")
    label = np.array([r.label for r in graph.cluster(edges, 9, "signed", 3).orderBy("node").collect()])
    assert linalg.rand_index(truth, label) == 1


def test_graph_report_by_plain_eigenvalues(spark):
    rng = np.random.default_rng(4)
    w = np.triu(rng.normal(size=(6, 6)), 1)
    w += w.T
    signed = np.diag(np.abs(w).sum(1)) - w
    e = np.linalg.eigvalsh(signed)
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(6) for j in range(i + 1, 6)], "i int, j int, coi double")
    found = {r.measure: r.value for r in graph.graph_report(edges, 6).collect()}
    low = max(0.0, e[0])
    want = {"raw": e[0], "ratio": e[0] / e[-1], "clipped_ratio": low / e[-1], "per_node": low / 6, "raw_per_node": e[0] / 6}
    for k, v in want.items():
        assert found[f"frustration_{k}"] == pytest.approx(v)
    neg = np.maximum(-w, 0)
    d = neg.sum(1)
    lap = np.eye(6) - neg / np.sqrt(np.outer(d, d))
    assert found["condition_0.1"] == pytest.approx(np.linalg.cond(lap + 0.1 * np.eye(6)))
    assert found["spectrum_positive_mass"] == pytest.approx(np.maximum(w, 0).sum() / np.abs(w).sum())
    values, vectors = linalg.sponge(w)
    pos = np.maximum(w, 0)
    a = np.eye(6) - pos / np.sqrt(np.outer(pos.sum(1), pos.sum(1))) + np.eye(6)
    assert np.allclose(a @ vectors, (lap + np.eye(6)) @ vectors * values, atol=1e-6)


def test_byte_parts_equal_a_plain_loop(spark):
    rows = [(f"d{k}", i, "x" * (i % 7)) for k, n in enumerate([30, 5, 400, 12, 0, 80]) for i in range(n)]
    df = spark.createDataFrame(rows, "d string, i long, t string")
    most, found = 1500, {(r.d, r.i): r.part for r in nested.byte_parts(df, "d", ["i"], 1500).collect()}
    size = lambda some: sum(len(json.dumps({"d": d, "i": i, "t": t}, separators=(",", ":"))) + 1 for d, i, t in some)
    parts, used = [[]], 50
    for name in sorted({r[0] for r in rows}):
        some = [r for r in rows if r[0] == name]
        if used + size(some) >= most and parts[-1]:
            parts, used = [*parts, []], 50
        if 50 + size(some) < most:
            parts[-1] += some
            used += size(some)
        else:
            step = len(some) // (size(some) // most + 1)
            parts[-1:] = [some[a : a + step] for a in range(0, len(some), step)] + [[]]
    assert found == {(d, i): n for n, part in enumerate(parts) for d, i, _ in part}


@pytest.mark.parametrize("name", ["easy_2mod_xor", "no_structure_control"])
def test_planted_tables_pass_their_checks(spark, name):
    t = synthetic.variant(spark, name)
    bad = synthetic.validate_variant(t, name).where("not ok").collect()
    assert [(r.check_name, r.item) for r in bad] in ([], [("module_term", "T4")])
    again = synthetic.variant(spark, name).repartition(7)
    assert again.agg(F.sum("X3"), F.sum("output")).first() == pytest.approx(tuple(t.agg(F.sum("X3"), F.sum("output")).first()))


def test_bayesian_shares_and_subsamples(spark):
    up = spark.createDataFrame([(0.05 + i / 1000,) for i in range(30)], "delta double")
    r = hypothesis.bayesian_signed_rank(up, draws=300).first()
    assert r.left + r.rope + r.right == pytest.approx(1) and r.right > 0.99
    for name, column in (("A14_subsample_clusters", "ari"), ("A15_seed_clusters", "mean_ari")):
        assert -1 <= catalog.queries()[name](spark, SF).first()[column] <= 1
    assert clean.uniform_sample(spark.range(50), ["id"], 7).count() == 7


def test_every_query_without_sql_gives_rows(spark):
    slow = {"M18_cross_validate", "M19_oblique_benefit", "A8_knn_co_information", "A9_knn_clipped_bits"}
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - slow):
        assert catalog.queries()[name](spark, SF).count() > 0, name
