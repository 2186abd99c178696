"""Signed feature graphs as edge tables (i < j, weight): relational parts in Spark, dense algebra by linalg."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import linalg

#: Nodes of a graph that may come to the driver as a dense matrix.
MOST_NODES = 2000


def both_ways(edges: DataFrame, value: str = "coi") -> DataFrame:
    e = edges.select("i", "j", F.col(value).alias("w"))
    return e.union(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def degrees(edges: DataFrame, value: str = "coi") -> DataFrame:
    """G1: node, d_pos, d_neg, d_abs."""
    pos, neg = F.sum(F.greatest(F.col("w"), F.lit(0.0))), F.sum(F.greatest(-F.col("w"), F.lit(0.0)))
    return both_ways(edges, value).groupBy(F.col("i").alias("node")).agg(pos.alias("d_pos"), neg.alias("d_neg"), F.sum(F.abs("w")).alias("d_abs"))


def laplacians(edges: DataFrame, value: str = "coi") -> DataFrame:
    """G1: i, j, l_pos, l_neg, l_abs, l_signed: entries of all four Laplacians, the diagonal included."""
    both = both_ways(edges, value)
    off = both.select("i", "j", -F.greatest(F.col("w"), F.lit(0.0)), -F.greatest(-F.col("w"), F.lit(0.0)), -F.abs("w"), -F.col("w"))
    d = degrees(edges, value)
    return off.toDF("i", "j", "l_pos", "l_neg", "l_abs", "l_signed").union(d.select("node", "node", "d_pos", "d_neg", "d_abs", "d_abs"))


def dense(edges: DataFrame, nodes: int, value: str = "coi") -> np.ndarray:
    """The symmetric matrix on the driver, for at most MOST_NODES nodes."""
    if nodes > MOST_NODES:
        raise ValueError(f"{nodes} nodes; dense algebra is for {MOST_NODES}")
    w = np.zeros((nodes, nodes))
    for i, j, v in edges.select("i", "j", value).toPandas().itertuples(index=False):
        w[i, j] = w[j, i] = v
    return w


def strong_components(edges: DataFrame, nodes: DataFrame, percentile: float = 0.9, value: str = "coi", mode: str = "absolute") -> DataFrame:
    """Node, label: the smallest node that edges at or above the percentile reach.

    absolute: of the non-zero |weights|; synergy: of -weight where negative; synergy_all: of -weight, zeros included.
    Nodes are features: their links come to the driver, for at most MOST_NODES nodes.
    """
    strength = {"absolute": F.abs(F.col(value)), "synergy": -F.col(value), "synergy_all": F.greatest(-F.col(value), F.lit(0.0))}[mode]
    rows = edges.withColumn("__s", strength)
    rows = rows.where("__s > 0") if mode != "synergy_all" else rows
    cut = rows.agg(F.percentile("__s", F.lit(percentile)).alias("__cut"))
    strong = rows.crossJoin(F.broadcast(cut)).where("__s >= __cut and __s > 0")  # one row
    label = {r[0]: r[0] for r in nodes.select("node").limit(MOST_NODES + 1).collect()}
    if len(label) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    links = both_ways(strong, value).select("i", "j").collect()  # features, not rows: at most MOST_NODES^2

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return nodes.sparkSession.createDataFrame([(int(n), int(find(n))) for n in label], "node int, label int")


def random_labels(nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """md5 of seed and node modulo k."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string"))), 1, 8), 16, 10)
    return nodes.select("node", (digits.cast("long") % k).cast("int").alias("label"))


def modules_of(labels: DataFrame, least: int = 2, item: str = "node") -> DataFrame:
    """Label, features of labels with enough members; without any one module of all."""
    found = labels.groupBy("label").agg(F.array_sort(F.collect_list(item)).alias("features"))
    kept = found.where(F.size("features") >= least)
    every = labels.agg(F.lit(-1).alias("label"), F.array_sort(F.collect_list(item)).alias("features"))
    return kept.unionByName(every) if kept.isEmpty() else kept


def truth_labels(nodes: DataFrame, modules: DataFrame, redundant: DataFrame | None = None, noise: str = "single") -> DataFrame:
    """Node, label: its first module; a redundant copy (copy, of) inherits; others are single or -1."""
    own = modules.select("module", F.explode("features").alias("node")).groupBy("node").agg(F.min("module").alias("label"))
    out = nodes.join(own, "node", "left")
    if redundant is not None:
        heirs = redundant.join(own.withColumnRenamed("node", "of").withColumnRenamed("label", "__of"), "of").groupBy(F.col("copy").alias("node")).agg(F.min("__of").alias("__of"))
        out = out.join(heirs, "node", "left").withColumn("label", F.coalesce("label", "__of")).drop("__of")
    rest = 1000 + F.col("node") if noise == "single" else F.lit(-1)
    return out.withColumn("label", F.coalesce("label", rest).cast("int"))


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Node, differs: raw labels are compared, so renamed clusters differ."""
    return a.select("node", F.col("label").alias("__a")).join(b.select("node", F.col("label").alias("__b")), "node").select("node", (F.col("__a") != F.col("__b")).alias("differs"))


def inject_edges(edges: DataFrame, how: str, value: str = "coi", known: DataFrame | None = None) -> DataFrame:
    """Median: |w| for weights above the median; shift: the lower quartile is taken off; known: |w| at known pairs."""
    if how == "known":
        marked = edges.join(known.select("i", "j", F.lit(True).alias("__k")), ["i", "j"], "left")
        return marked.withColumn(value, F.when(F.col("__k"), F.abs(F.col(value))).otherwise(F.col(value))).drop("__k")
    level = F.percentile(value, F.lit(0.5 if how == "median" else 0.25))
    one = edges.crossJoin(F.broadcast(edges.agg(level.alias("__l"))))  # one row
    new = F.when(F.col(value) > F.col("__l"), F.abs(F.col(value))).otherwise(F.col(value)) if how == "median" else F.col(value) - F.col("__l")
    return one.withColumn(value, new).drop("__l")


def degenerate(edges: DataFrame, value: str = "coi", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: share of positive edges, and whether nearly all have one sign (then cluster unsigned)."""
    share = F.avg((F.col(value) > 0).cast("double"))
    return edges.agg(share.alias("frac_pos"), ((share > high) | (share < low)).alias("is_degenerate"))


def strongest_edges(edges: DataFrame, k: int = 3, value: str = "coi") -> DataFrame:
    """Node, other, w, place."""
    both = both_ways(edges, value)
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(F.round(F.abs("w"), 9)), "j"))
    return both.withColumn("place", rank).where(F.col("place") <= k).select(F.col("i").alias("node"), F.col("j").alias("other"), "w", "place")


def cluster(edges: DataFrame, nodes: int, method: str = "signed", k: int | None = None, value: str = "coi", **options) -> DataFrame:
    """Node, label by signed or unsigned spectral clustering."""
    w = dense(edges, nodes, value)
    label = linalg.signed_clusters(w, k, **options) if method == "signed" else linalg.spectral(w, k or 3, **options)
    return edges.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(label)], "node int, label int")


def graph_report(edges: DataFrame, nodes: int, value: str = "coi") -> DataFrame:
    """Measure, value."""
    w = dense(edges, nodes, value)
    found = {f"frustration_{k}": v for k, v in linalg.frustration(w).items()} | {f"spectrum_{k}": v for k, v in linalg.spectra(w).items()}
    found |= {f"condition_{t:g}": v for t, v in linalg.conditions(w).items()}
    return edges.sparkSession.createDataFrame(sorted(found.items()), "measure string, value double")
