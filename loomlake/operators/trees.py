"""Greedy trees over distributed sufficient statistics: each round is one aggregation over all leaves and candidates."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import at_quantiles, running

DECILES = tuple(i / 10 for i in range(1, 10))


@dataclass(frozen=True)
class Node:
    """A row of the model table; a leaf has no features."""

    tree: int
    node: int
    depth: int
    value: float
    n: int = 0
    features: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    threshold: float = 0.0
    left: int = -1
    right: int = -1


@dataclass
class Model:
    nodes: dict[int, Node] = field(default_factory=dict)

    def leaf_of(self) -> Column:
        """The leaf that a row falls in, as nested conditions, so that scoring stays in generated code."""

        def at(i: int) -> Column:
            x = self.nodes[i]
            return F.when(projection(x.features, x.weights) <= x.threshold, at(x.left)).otherwise(at(x.right)) if x.features else F.lit(i)

        return at(0)

    def predict(self) -> Column:
        """M11."""

        def at(i: int) -> Column:
            x = self.nodes[i]
            return F.when(projection(x.features, x.weights) <= x.threshold, at(x.left)).otherwise(at(x.right)) if x.features else F.lit(x.value)

        return at(0)

    def table(self, spark) -> DataFrame:
        rows = [(x.tree, x.node, x.depth, x.value, x.n, list(x.features), list(x.weights), x.threshold, x.left, x.right) for x in self.nodes.values()]
        return spark.createDataFrame(rows, "tree int, node int, depth int, value double, n long, features array<string>, weights array<double>, threshold double, left int, right int")


def projection(features: tuple[str, ...], weights: tuple[float, ...]) -> Column:
    total = F.col(features[0]).cast("double") * weights[0] if weights else F.col(features[0]).cast("double")
    for f, w in zip(features[1:], weights[1:], strict=True):
        total = total + F.col(f).cast("double") * w
    return total


def gain_of(n: Column, s: Column, q: Column, nl: Column, sl: Column) -> Column:
    """Fall of the sum of squared errors when (nl, sl) is split off (n, s)."""
    return sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n


def best_stump(df: DataFrame, feature: str, y: str, least: int = 5) -> DataFrame:
    """M1: threshold, gain, n_left over all exact thresholds of a feature: equal values are summed first, then run."""
    known = df.where(F.col(feature).isNotNull())
    cells = known.groupBy(F.col(feature).cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"))
    run = running(cells, [], ["x"], ["n", "s"]).select("x", F.col("run_n").alias("nl"), F.col("run_s").alias("sl"), F.col("all_n").alias("n"), F.col("all_s").alias("s"))
    cut = run.where((F.col("nl") >= least) & (F.col("n") - F.col("nl") >= least)).withColumn("gain", gain_of(F.col("n"), F.col("s"), F.lit(0), F.col("nl"), F.col("sl")))
    best = cut.orderBy(F.desc(F.round("gain", 6)), "x").limit(1)
    above = known.select(F.col(feature).cast("double").alias("next")).join(F.broadcast(best), F.col("next") > F.col("x"))  # one row
    return above.groupBy("x", "gain", "nl").agg(F.min("next").alias("next")).select(((F.col("x") + F.col("next")) / 2).alias("threshold"), "gain", F.col("nl").cast("long").alias("n_left"))


def split_gains(df: DataFrame, candidates: dict[str, Column], y: str, leaf: Column | None = None, levels: tuple[float, ...] = DECILES, least: int = 5) -> DataFrame:
    """Leaf, candidate, threshold, gain, n, n_left: all thresholds at quantiles of each leaf and candidate.

    One aggregation whatever the leaves, candidates and thresholds: rows and sums for each distinct value. Running sums
    over them give both the exact quantiles and what lies at or below each.
    """
    names = list(candidates)
    values = F.array(*[candidates[k].cast("double") for k in names])
    rows = df.select((leaf if leaf is not None else F.lit(0)).alias("leaf"), F.col(y).cast("double").alias("y"), F.posexplode(values).alias("k", "x"))
    cells = rows.where("x is not null").groupBy("leaf", "k", "x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"))
    at = at_quantiles(cells, ["leaf", "k"], "x", list(levels), ["n", "s"])
    sums = at.groupBy("leaf", "k", F.col("quantile").alias("threshold")).agg(F.max("run_n").alias("nl"), F.max_by("run_s", "run_n").alias("sl"), F.max("all_n").alias("n"), F.max("all_s").alias("s"))
    kept = sums.where((F.col("nl") >= least) & (F.col("n") - F.col("nl") >= least))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    gain = gain_of(F.col("n"), F.col("s"), F.lit(0), F.col("nl"), F.col("sl"))
    return kept.select("leaf", name.alias("candidate"), "threshold", gain.alias("gain"), F.col("n").cast("long").alias("n"), F.col("nl").cast("long").alias("n_left"), "s", "sl")


def best_splits(gains: DataFrame) -> DataFrame:
    """The best split of each leaf; of equals the first candidate, then the smallest threshold."""
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc(F.round("gain", 9)), "candidate", "threshold"))
    return gains.withColumn("__r", rank).where("__r = 1").drop("__r")


def candidates_for(features: list[str], strategy: str, modules: list[list[str]] | None = None, seed: int = 42, most: int = 50) -> list[tuple[str, ...]]:
    """Axis: single features; random: also subsets of 2 to 5; modules: also modules and the pairs of small ones."""
    out = [(f,) for f in features]
    if strategy == "random":
        rng = np.random.default_rng(seed)
        out += [tuple(sorted(rng.choice(features, size=int(rng.integers(2, min(5, len(features)) + 1)), replace=False).tolist())) for _ in range(min(most, 2 * len(features)))]
    elif strategy == "modules":
        for m in modules or []:
            out.append(tuple(sorted(m)))
            out += list(itertools.combinations(sorted(m), 2)) if len(m) <= 6 else []
    return list(dict.fromkeys(out))


def beam_subsets(features: list[str], modules: list[list[str]], beam: int, rounds: int = 1, weights: dict[tuple[str, str], float] | None = None, seed: int = 42) -> list[tuple[str, ...]]:
    """M7: subsets of ``beam`` features, one a round: a module drawn from those of two and more. Of a larger one the
    features with the greatest sum of abs weights to the others in it, or without weights drawn ones; a smaller one
    is filled up with drawn features. Without a module all are drawn.
    """
    rng, beam = np.random.default_rng(seed), min(beam, len(features))
    valid = [m for m in modules if len(m) >= 2]
    drawn = lambda some, n: rng.choice(sorted(some), n, replace=False).tolist()
    size = lambda a, b: abs((weights or {}).get((a, b), (weights or {}).get((b, a), 0.0)))
    out = []
    for _ in range(rounds):
        chosen = list(valid[rng.integers(len(valid))]) if valid else []
        if len(chosen) > beam:
            chosen = sorted(chosen, key=lambda f: (-sum(size(f, g) for g in chosen if g != f), f))[:beam] if weights else drawn(chosen, beam)  # noqa: B023
        chosen += drawn(set(features) - set(chosen), beam - len(chosen))
        out.append(tuple(sorted(chosen)))
    return list(dict.fromkeys(out))


def ridge_direction(df: DataFrame, features: tuple[str, ...], y: str, alphas: tuple[float, ...] = (1.0,)) -> tuple[float, ...]:
    """M4, M5: ridge weights from one aggregation of moments; of several penalties the one with the least GCV error."""
    f = [F.col(x).cast("double") for x in features]
    t = F.col(y).cast("double")
    moments = [F.count(F.lit(1)), F.sum(t), F.sum(t * t), *[F.sum(x) for x in f], *[F.sum(x * t) for x in f], *[F.sum(f[i] * f[j]) for i in range(len(f)) for j in range(i, len(f))]]
    row = [float(v or 0) for v in df.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first()]
    n, sy, syy, d = row[0], row[1], row[2], len(f)
    sx, sxy = np.array(row[3 : 3 + d]), np.array(row[3 + d : 3 + 2 * d])
    gram = np.zeros((d, d))
    gram[np.triu_indices(d)] = row[3 + 2 * d :]
    gram = gram + np.triu(gram, 1).T - np.outer(sx, sx) / n
    target = sxy - sx * sy / n
    best = (np.inf, np.zeros(d))
    for a in alphas:
        inverse = np.linalg.inv(gram + a * np.eye(d))
        w = inverse @ target
        error = syy - sy * sy / n - 2 * w @ target + w @ gram @ w
        free = max(1e-9, 1 - (1 + np.trace(inverse @ gram)) / n)
        best = min(best, (error / n / free**2, w), key=lambda b: b[0])
    return tuple(float(x) for x in best[1])


def grow(df: DataFrame, subsets: list[tuple[str, ...]], y: str, splits: int = 10, depth: int = 6, least: int = 5, levels: tuple[float, ...] = DECILES) -> Model:
    """A greedy tree: each round one pass scores every candidate at every open leaf, the greatest gain is taken.

    Scores of leaves that didn't change are kept, so a round aggregates the two new leaves only. Each round reads ``df``
    anew with the model's literal conditions; cache it, or let it be a scan.
    """
    weights = {s: (ridge_direction(df, s, y) if len(s) > 1 else (1.0,)) for s in subsets}
    names = {"+".join(s): s for s in subsets}
    candidates = {k: projection(s, weights[s]) for k, s in names.items()}
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.col(y).cast("double"))).first()
    model = Model({0: Node(0, 0, 0, float(total) / n if n else 0.0, n)})
    scored: dict[int, object] = {}
    fresh = [0]
    for _ in range(splits):
        open_ = [i for i in fresh if model.nodes[i].n >= 2 * least and model.nodes[i].depth < depth]
        if open_:
            part = df.withColumn("__leaf", model.leaf_of()).where(F.col("__leaf").isin(open_))
            scored |= {r["leaf"]: r for r in best_splits(split_gains(part, candidates, y, F.col("__leaf"), levels, least)).collect()}
        best = max(scored.values(), key=lambda r: (round(r["gain"], 9), -r["leaf"]), default=None)
        if best is None or best["gain"] <= 1e-10:
            break
        at = model.nodes[best["leaf"]]
        i = len(model.nodes)
        s = names[best["candidate"]]
        model.nodes[at.node] = replace(at, features=s, weights=weights[s], threshold=best["threshold"], left=i, right=i + 1)
        nl, n = best["n_left"], best["n"]
        model.nodes[i] = Node(0, i, at.depth + 1, best["sl"] / nl, nl)
        model.nodes[i + 1] = Node(0, i + 1, at.depth + 1, (best["s"] - best["sl"]) / (n - nl), n - nl)
        del scored[at.node]
        fresh = [i, i + 1]
    return model


def grow_sum(
    df: DataFrame, subsets: list[tuple[str, ...]], y: str, splits: int = 10, least: int = 5, levels: tuple[float, ...] = DECILES, depth: int | None = None, late_roots: int = 0
) -> list[Model]:
    """A sum of trees grown jointly: each round scores every leaf of all trees and the root of a new one on
    the current residuals and takes the greatest gain, of equals the first leaf; a new root comes last. Leaves at
    ``depth`` aren't split. With ``late_roots`` (M9: 3) a new root, which starts as the residuals' mean, is opened only
    when no leaf can be split, so many times in a row at most.

    The two new leaves get the means of the residuals in place of their parent's value, as in the surveyed system, and
    at the end the leaves of each tree in turn are set to the means of what the other trees leave. Residuals of all rows
    change, so a round is one aggregation over rows times trees; subsets of features get ridge weights for each leaf.
    """
    t = F.col(y).cast("double")
    n, total = df.agg(F.count(F.lit(1)), F.sum(t)).first()
    models = [Model({0: Node(0, 0, 0, float(total) / n if n else 0.0, n)})]
    names = {"+".join(s): s for s in subsets}
    width, made, tries = 2 * splits + 1, 0, 0
    while made < splits:
        open_ = [k * width + i for k, m in enumerate(models) for i, x in m.nodes.items() if not x.features and x.n >= 2 * least and (depth is None or x.depth < depth)]
        open_ += [len(models) * width] if n >= 2 * least and not late_roots else []
        if not open_ and not late_roots:
            break
        places = F.array(*[m.leaf_of() + F.lit(k * width) for k, m in enumerate(models)], F.lit(len(models) * width))
        part = df.withColumn("__residual", t - predict_sum(models)).withColumn("__leaf", F.explode(places)).where(F.col("__leaf").isin(open_))
        weights = {(s, i): ridge_direction(part.where(F.col("__leaf") == i), s, "__residual") if len(s) > 1 else (1.0,) for s in subsets for i in open_}
        candidates = {k: F.coalesce(*[F.when(F.col("__leaf") == i, projection(s, weights[s, i])) for i in open_]) if len(s) > 1 else projection(s, (1.0,)) for k, s in names.items()}
        scored = best_splits(split_gains(part, candidates, "__residual", F.col("__leaf"), levels, least)).collect() if open_ else []
        best = max(scored, key=lambda r: (round(r["gain"], 9), -r["leaf"]), default=None)
        if best is None or best["gain"] <= 1e-10:
            tries += 1
            if tries > late_roots:
                break
            k = len(models)
            models.append(Model({0: Node(k, 0, 0, float(df.agg(F.avg(t - predict_sum(models))).first()[0] or 0.0), n)}))
            continue
        made, tries = made + 1, 0
        k, leaf = divmod(best["leaf"], width)
        if k == len(models):
            models.append(Model({0: Node(k, 0, 0, 0.0, n)}))
        nodes, s = models[k].nodes, names[best["candidate"]]
        at, i, nl = nodes[leaf], len(nodes), best["n_left"]
        nodes[leaf] = replace(at, features=s, weights=weights[s, best["leaf"]], threshold=best["threshold"], left=i, right=i + 1)
        nodes[i] = Node(k, i, at.depth + 1, best["sl"] / nl, nl)
        nodes[i + 1] = Node(k, i + 1, at.depth + 1, (best["s"] - best["sl"]) / (best["n"] - nl), best["n"] - nl)
    for m in models:
        others = [o for o in models if o is not m]
        left = t - predict_sum(others) if others else t
        found = dict(df.groupBy(m.leaf_of().alias("leaf")).agg(F.avg(left)).collect())
        m.nodes.update({i: replace(x, value=float(found.get(i) or 0.0)) for i, x in m.nodes.items() if not x.features})
    return models


def predict_sum(models: list[Model]) -> Column:
    out = models[0].predict()
    for m in models[1:]:
        out = out + m.predict()
    return out


def to_class(p: Column, closed: bool = True) -> Column:
    """1 from a half on, or above it."""
    return (p >= 0.5 if closed else p > 0.5).cast("int")


def one_vs_rest_scores(df: DataFrame, subsets: list[tuple[str, ...]], y: str, classes: list, splits: int, **options) -> list[Column]:
    """The score of a tree for each class against the rest; the budget of splits is shared."""
    one = lambda c: df.withColumn("__one", (F.col(y) == F.lit(c)).cast("double"))
    return [grow(one(c), subsets, "__one", max(1, splits // len(classes)), **options).predict() for c in classes]


def top_class(scores: list[Column], classes: list) -> Column:
    """The class with the greatest score, of equals the first."""
    every = F.array(*scores)
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(every, F.array_max(every)).cast("int"))


def softmax(scores: list[Column]) -> list[Column]:
    """Probabilities of the classes, from the scores less their greatest one."""
    top = F.greatest(*scores)
    total = sum((F.exp(s - top) for s in scores[1:]), F.exp(scores[0] - top))
    return [F.exp(s - top) / total for s in scores]


def one_vs_rest(df: DataFrame, subsets: list[tuple[str, ...]], y: str, classes: list, splits: int, **options) -> Column:
    """The predicted class."""
    return top_class(one_vs_rest_scores(df, subsets, y, classes, splits, **options), classes)


def ridge_line(df: DataFrame, features: tuple[str, ...], y: str, alpha: float = 1.0) -> tuple[tuple[float, ...], float]:
    """Weights and intercept of a ridge regression, the penalty on the sum of squares, from two aggregations."""
    weights = ridge_direction(df, features, y, (alpha,))
    return weights, float(df.agg(F.avg(F.col(y).cast("double") - projection(features, weights))).first()[0])


def baseline(df: DataFrame, features: list[str], y: str, kind: str, trees: int = 100, seed: int = 42):
    """A fitted Spark ML pipeline: logistic (C = 1, 1000 rounds) or forest; ``y`` holds classes from 0.

    The logistic penalty is 1 on the sum of losses, so it is divided by the rows here.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n = max(1, df.count())
    models = {
        "logistic": lambda: LogisticRegression(featuresCol="__x", labelCol=y, regParam=1.0 / n, standardization=False, maxIter=1000),
        "forest": lambda: RandomForestClassifier(featuresCol="__x", labelCol=y, numTrees=trees, seed=seed),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), models[kind]()]).fit(df)


def complexity(nodes: DataFrame) -> DataFrame:
    """n_splits, mean and greatest arity (weights beyond 1e-10), mean leaf depth."""
    inner = F.size("features") > 0
    arity = F.when(inner, F.size(F.filter("weights", lambda w: F.abs(w) > 1e-10)))
    return nodes.agg(F.count_if(inner).alias("n_splits"), F.avg(arity).alias("mean_arity"), F.max(arity).alias("max_arity"), F.avg(F.when(~inner, F.col("depth"))).alias("mean_leaf_depth"))


def cross_validate(df: DataFrame, subsets: dict[str, list[tuple[str, ...]]], y: str, sizes: list[int], folds: int = 5, fold: str = "fold") -> DataFrame:
    """Method, max_splits, fold, n_train, n_test, r2, total_splits, error; a fit that fails is a row."""
    rows = []
    for (method, some), size, k in itertools.product(subsets.items(), sizes, range(folds)):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        try:
            m = grow(train, some, y, size)
            t, p = F.col(y).cast("double"), m.predict()
            n, r2 = test.agg(F.count(F.lit(1)), 1 - F.avg((t - p) * (t - p)) / F.var_pop(t)).first()
            rows.append((method, size, k, train.count(), n, r2, sum(bool(x.features) for x in m.nodes.values()), None))
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:  # a lost executor is no result
            rows.append((method, size, k, None, None, None, None, str(e)[:200]))
    return df.sparkSession.createDataFrame(rows, "method string, max_splits int, fold int, n_train long, n_test long, r2 double, total_splits int, error string")
