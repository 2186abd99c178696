"""Metrics of predictions and of clusterings, as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running


def balanced_accuracy(df: DataFrame, truth: str, prediction: str, keys: list[str]) -> DataFrame:
    """Mean recall of the classes that occur."""
    recall = df.groupBy(*keys, truth).agg(F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("__r"))
    return recall.groupBy(*keys).agg(F.avg("__r").alias("balanced_accuracy"))


def roc_auc(df: DataFrame, positive: Column, score: str, keys: list[str]) -> DataFrame:
    """Mann-Whitney by average ranks; null with one class. Distinct scores are counted before they are ranked."""
    counts = df.groupBy(*keys, F.col(score).alias("__s")).agg(F.count(F.lit(1)).alias("__n"), F.count_if(positive).alias("__p"))
    ranked = running(counts, keys, ["__s"], ["__n"]).withColumn("__rank", F.col("run___n") - F.col("__n") + (F.col("__n") + 1) / F.lit(2.0))
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("__rank") * F.col("__p")).alias("r"), F.sum("__p").cast("double").alias("p"), F.sum("__n").cast("double").alias("n"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.expr("(r - p * (p + 1) / 2) / (p * (n - p))")).alias("auc"))


def weighted_auc(df: DataFrame, truth: str, scores: dict[str, str], keys: list[str]) -> DataFrame:
    """For more than two classes: each class against the rest by its own score, weighted by the class's rows.

    scores: a column for each class. Null where a class has no rows, or all of them.
    """
    classes = F.array(*[F.struct(F.lit(c).alias("c"), F.col(s).cast("double").alias("s")) for c, s in scores.items()])
    spread = df.select(*keys, F.col(truth).alias("__t"), F.explode(classes).alias("x")).select(*keys, "__t", F.col("x.c").alias("__c"), F.col("x.s").alias("__score"))
    each = roc_auc(spread, F.col("__t") == F.col("__c"), "__score", [*keys, "__c"])
    sizes = spread.where("__t = __c").groupBy(*keys, "__c").agg(F.count(F.lit(1)).alias("__n"))
    both = each.join(sizes, [*keys, "__c"], "left").groupBy(*keys)
    found = both.agg((F.sum(F.col("auc") * F.col("__n")) / F.sum("__n")).alias("auc"), F.count_if(F.col("auc").isNull()).alias("__none"))
    return found.select(*keys, F.when(F.col("__none") == 0, F.col("auc")).alias("auc"))


def r_squared(df: DataFrame, truth: str, prediction: str, keys: list[str]) -> DataFrame:
    """From sums in one pass; null where the truth is constant."""
    y, p = F.col(truth), F.col(prediction)
    return df.groupBy(*keys).agg(F.when(F.var_pop(y) > 0, 1 - F.avg((y - p) * (y - p)) / F.var_pop(y)).alias("r2"))


def adjusted_rand(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Over the contingency table."""
    k = keys or []
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = df.groupBy(*k, a, b).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, out: cells.groupBy(*k, c).agg(F.sum("n").alias("n")).groupBy(*k).agg(F.sum(pairs("n")).alias(out))
    both = cells.groupBy(*k).agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("n"))
    joined = both.join(side(a, "of_a"), k).join(side(b, "of_b"), k) if k else both.crossJoin(side(a, "of_a")).crossJoin(side(b, "of_b"))  # one row each
    chance = F.col("of_a") * F.col("of_b") / pairs("n")
    top = (F.col("of_a") + F.col("of_b")) / 2
    return joined.select(*k, F.when(top == chance, 1.0).otherwise((F.col("both") - chance) / (top - chance)).alias("ari"))


def same_label_pairs(labels: DataFrame, item: str = "feature", label: str = "label") -> DataFrame:
    """i, j (i < j) of items with the same label; items are features, so lists are short."""
    a, b = labels.select(F.col(item).alias("i"), F.col(label).alias("l")), labels.select(F.col(item).alias("j"), F.col(label).alias("l"))
    return a.join(b, "l").where("i < j").select("i", "j")


def pair_jaccard(predicted: DataFrame, truth: DataFrame, only_truth_items: bool, item: str = "feature", label: str = "label") -> DataFrame:
    """Jaccard of the sets of pairs that share a label; predicted pairs among truth's items only, or all."""
    if only_truth_items:
        predicted = predicted.join(truth.select(item).distinct(), item, "left_semi")
    p, t = same_label_pairs(predicted, item, label), same_label_pairs(truth, item, label)
    both, either = p.intersect(t).agg(F.count(F.lit(1)).alias("n_both")), p.union(t).distinct().agg(F.count(F.lit(1)).alias("n_either"))
    return both.crossJoin(either).withColumn("jaccard", F.when(F.col("n_either") > 0, F.col("n_both") / F.col("n_either")).otherwise(0.0))  # one row each


def whole_modules(modules: DataFrame, labels: DataFrame, item: str = "feature", label: str = "label") -> DataFrame:
    """Share of modules that lie in one cluster."""
    one = modules.join(labels, item).groupBy("module").agg(F.count_distinct(label).alias("k"))
    return one.agg(F.avg((F.col("k") == 1).cast("double")).alias("recovered"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Pearson of average ranks. Distinct values are counted and numbered by ranges; keys aren't null."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("__vx"), F.col(y).alias("__vy"))
    for c in ("x", "y"):
        cells = running(ranked.groupBy(*keys, f"__v{c}").agg(F.count(F.lit(1)).alias("__n")), keys, [f"__v{c}"], ["__n"])
        place = cells.select(*keys, f"__v{c}", (F.col("run___n") - (F.col("__n") - 1) / F.lit(2.0)).alias(f"__{c}"))
        ranked = ranked.join(place, [*keys, f"__v{c}"])
    return ranked.groupBy(*keys).agg(F.corr("__x", "__y").alias("rho"), F.count(F.lit(1)).alias("n"))


def _signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i w_j sign(x_i - x_j) sign(y_i - y_j) over pairs of distinct points, in n log^2 n steps.

    Discordant pairs are the inversions of y's ranks in order of (x, y), counted bit by bit.
    """
    order = np.lexsort((y, x))
    x, y, w = x[order], np.unique(y[order], return_inverse=True)[1], w[order]
    discordant = 0.0
    for bit in range(int(y.max(initial=0)).bit_length()):
        at = np.argsort(y >> (bit + 1), kind="stable")
        group, one, v = y[at] >> (bit + 1), (y[at] >> bit & 1).astype(bool), w[at]
        before = np.cumsum(np.where(one, v, 0.0))
        first = np.searchsorted(group, group)
        discordant += float((v * (before - np.where(first > 0, before[first - 1], 0.0)))[~one].sum())
    tied = sum(float((np.bincount(np.unique(c, return_inverse=True)[1], w) ** 2).sum() - (w * w).sum()) / 2 for c in (x, y))
    return float(w.sum() ** 2 - (w * w).sum()) / 2 - tied - 2 * discordant


def kendall_tau(df: DataFrame, x: str, y: str, block_rows: int = 50_000) -> DataFrame:
    """Tau-b over all pairs of rows without nulls, by sorting.

    Distinct points are dealt to blocks of x and blocks of y, whose ends are quantiles; an end is a block by itself and
    has no pairs that differ. Pairs in one block of x are counted there, those in one block of y there, and all others
    from the counts of the cells, at most 513 * 513.
    """
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    n = points.count()
    cuts = min(256, n // block_rows)
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    ends = points.agg(F.percentile_approx("x", shares), F.percentile_approx("y", shares)).first() if cuts else ([], [])

    def block(c: str, at: list[float]) -> Column:
        values = F.array(*map(F.lit, sorted(set(at)))).cast("array<double>")
        return (F.size(F.filter(values, lambda v: v < F.col(c))) + F.size(F.filter(values, lambda v: v <= F.col(c)))).cast("int")

    dealt = points.withColumn("bx", block("x", ends[0] or [])).withColumn("by", block("y", ends[1] or []))

    def in_x(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [_signed_pairs(*(pdf[c].to_numpy() for c in "xyw"))]})

    def in_y(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [in_x(pdf)["s"][0] - sum(in_x(part)["s"][0] for _, part in pdf.groupby("bx"))]})

    s = sum(r["s"] for r in dealt.where("bx % 2 = 0").groupBy("bx").applyInPandas(in_x, "s double").collect())
    if cuts:
        s += sum(r["s"] for r in dealt.where("by % 2 = 0").groupBy("by").applyInPandas(in_y, "s double").collect())
        cells = np.zeros((2 * cuts + 1, 2 * cuts + 1))
        for r in dealt.groupBy("bx", "by").agg(F.sum("w").alias("w")).collect():
            cells[r["bx"], r["by"]] = r["w"]
        below = np.zeros((2 * cuts + 2, 2 * cuts + 2))
        below[1:, 1:] = cells.cumsum(0).cumsum(1)
        left = below[:-1]
        s += float((cells * (left[:, :-1] - (left[:, -1:] - left[:, 1:]))).sum())
    untied = lambda c: points.groupBy(c).agg(F.sum("w").alias("t")).agg((F.sum("t") * F.sum("t") - F.sum(F.col("t") * F.col("t"))).alias("u")).select((F.col("u") / 2).alias(f"u{c}"))
    sides = untied("x").crossJoin(untied("y"))  # one row each
    return sides.select(F.when((F.col("ux") > 0) & (F.col("uy") > 0), F.lit(float(s)) / F.sqrt(F.col("ux") * F.col("uy"))).alias("tau"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, by one matrix product; near pairs, where the product cancels, again by differences."""
    sizes = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
    square = np.maximum(sizes - 2 * a @ b.T, 0.0)
    i, j = np.nonzero(square <= 1e-6 * sizes)
    for at in range(0, len(i), 65_536):
        p, q = i[at : at + 65_536], j[at : at + 65_536]
        square[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return np.sqrt(square)


def silhouette(points: DataFrame, label: str, vector: str, key: str, block_rows: int = 2048) -> DataFrame:
    """Mean Euclidean silhouette over all points with a label and a vector; single members count 0.

    Every point meets every other, so time grows with the square of the points. They are packed into blocks of about
    ``block_rows``, blocks meet blocks, and a meeting gives for each point the sums of its distances to each label.
    """
    usable = points.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(label).alias("l"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-usable.count() // block_rows))
    sizes = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, counts = list(sizes), np.array([float(n) for n in sizes.values()])
    number = F.create_map(*[c for i, name in enumerate(names) for c in (F.lit(name), F.lit(i))]) if names else F.lit(None).cast("map<string,int>")
    packed = usable.select(F.pmod("h", F.lit(blocks)).cast("int").alias("b"), "h", number[F.col("l")].alias("l"), "v").groupBy("b").agg(F.sort_array(F.collect_list(F.struct("h", "l", "v"))).alias("p"))
    packed = packed.select("b", F.col("p.l").alias("l"), F.flatten("p.v").alias("v")).coalesce(min(blocks, 64))
    a, b = (packed.select(*[F.col(c).alias(f"{c}{i}") for c in "blv"]) for i in (1, 2))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                l1, l2 = np.asarray(r.l1), np.asarray(r.l2)
                v1, v2 = np.asarray(r.v1).reshape(len(l1), -1), np.asarray(r.v2).reshape(len(l2), -1)
                sums = _distances(v1, v2) @ np.eye(len(names))[l2]
                yield pd.DataFrame({"b": [r.b1], "l": [l1], "s": [sums.ravel()]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.asarray(pdf["l"].iloc[0])
        sums = np.sum(np.stack(pdf["s"].to_numpy()), 0).reshape(len(own), -1)
        at = np.arange(len(own))
        others = np.where(np.arange(len(names)) == own[:, None], np.inf, sums / counts)
        near, mine = others.min(1), sums[at, own] / np.maximum(counts[own] - 1, 1)
        top = np.maximum(near, mine)
        value = np.where((counts[own] > 1) & (top > 0), (near - mine) / np.where(top > 0, top, 1), 0.0)
        return pd.DataFrame({"s": [value.sum()], "n": [len(own)]})

    if len(names) < 2:
        return usable.sparkSession.createDataFrame([(None,)], "silhouette double")
    met = a.crossJoin(b).mapInPandas(meet, "b int, l array<int>, s array<double>")  # blocks, not points
    return met.groupBy("b").applyInPandas(finish, "s double, n long").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
