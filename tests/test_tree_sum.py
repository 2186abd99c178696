"""The sum of trees against a plain joint greedy loop."""

import numpy as np
from pyspark.sql import functions as F

from loomlake.operators import trees

LEVELS = [i / 10 for i in range(1, 10)]


def route(tree, x):
    """Leaf of each row; a node is [value, feature, threshold, left, right]."""
    at = np.zeros(len(x), int)
    for i, (_, f, cut, left, right) in enumerate(tree):
        if f is not None:
            here = at == i
            at[here] = np.where(x[here, f] <= cut, left, right)
    return at


def plain_sum(x, y, splits, least=5):
    forest = [[[y.mean(), None, 0, 0, 0]]]
    predict = lambda t: np.array([v[0] for v in t])[route(t, x)]
    for _ in range(splits):
        r = y - sum(map(predict, forest))
        best = (1e-10, None)
        for k, tree in enumerate([*forest, None]):
            at = route(tree, x) if tree else np.zeros(len(x), int)
            for leaf in np.unique(at):
                for f in range(x.shape[1]):
                    v, rv = x[at == leaf, f], r[at == leaf]
                    for cut in np.unique(np.quantile(v, LEVELS)):
                        a, b = rv[v <= cut], rv[v > cut]
                        if min(len(a), len(b)) >= least:
                            gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - rv.sum() ** 2 / len(rv)
                            if gain > best[0] + 1e-9:
                                best = (gain, (k, leaf, f, cut, a.mean(), b.mean()))
        if best[1] is None:
            break
        k, leaf, f, cut, a, b = best[1]
        if k == len(forest):
            forest.append([[0.0, None, 0, 0, 0]])
        tree = forest[k]
        tree[leaf][1:] = [f, cut, len(tree), len(tree) + 1]
        tree += [[a, None, 0, 0, 0], [b, None, 0, 0, 0]]
    for k, tree in enumerate(forest):
        rest = y - sum(predict(t) for i, t in enumerate(forest) if i != k)
        at = route(tree, x)
        for leaf in np.unique(at):
            tree[leaf][0] = rest[at == leaf].mean()
    return sum(map(predict, forest)), [sum(v[1] is not None for v in t) for t in forest]


def test_sum_of_trees_is_grown_jointly(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (300, 3))
    y = 3.0 * (x[:, 0] > 0.2) * (x[:, 1] > 0) + 1.2 * (x[:, 2] > 0.5) + rng.normal(0, 0.1, 300)
    want, sizes = plain_sum(x, y, 5)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double").cache()
    models = trees.grow_sum(df, [("a",), ("b",), ("c",)], "y", 5)
    assert [sum(bool(v.features) for v in m.nodes.values()) for m in models] == sizes and sum(sizes) == 5 and len(sizes) > 1
    got = [r.p for r in df.orderBy("id").select(trees.predict_sum(models).alias("p")).collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_oblique_sum_takes_weights_of_each_leaf(spark):
    df = spark.range(200).select((F.col("id") % 20).cast("double").alias("a"), F.floor(F.col("id") / 20).cast("double").alias("b"))
    df = df.withColumn("y", (F.col("a") + 2 * F.col("b") > 18).cast("double"))
    models = trees.grow_sum(df, [("a",), ("b",), ("a", "b")], "y", 2)
    assert any(len(v.features) == 2 for m in models for v in m.nodes.values())
    assert df.where(trees.to_class(trees.predict_sum(models)) != F.col("y")).count() <= 20
