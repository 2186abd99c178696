"""Statistical tests and effect sizes over paired results. Statistics are aggregates; tails are applied to single rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import NEMENYI_Q, chi2_sf, normal_sf, sign_test, t_two_sided
from .results import average_rank


def friedman(df: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """ST1, ST3, ST4: one row: k, n (complete blocks), chi2 with ties, Kendall's W, p, critical distance at .05."""
    k = df.agg(F.count_distinct(method).alias("k"))
    full = df.where(F.col(value).isNotNull()).groupBy(block).agg(F.count_distinct(method).alias("have")).crossJoin(F.broadcast(k)).where("have = k")  # one row
    ranked = df.join(full.select(block, "k"), block).withColumn("r", average_rank(value, [block]))
    ties = ranked.groupBy(block, "r").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.expr("t * t * t - t")).cast("double").alias("ties"))
    sums = ranked.groupBy(method).agg(F.sum("r").alias("s"), F.count(F.lit(1)).cast("double").alias("n"), F.max("k").cast("double").alias("k"))
    stat = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"), F.max("k").alias("k")).crossJoin(ties)  # one row each
    plain = F.expr("12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)")
    chi2 = plain / F.expr("1 - ties / (n * k * (k * k - 1))")
    q = F.create_map(*[F.lit(x) for kv in NEMENYI_Q.items() for x in kv])

    @F.pandas_udf("double")
    def tail(x: pd.Series, df_: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(a, b) for a, b in zip(x, df_, strict=True)])

    out = stat.select(F.col("k").cast("int").alias("k"), F.col("n").cast("int").alias("n"), chi2.alias("chi2"))
    distance = q[F.col("k")] * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))
    return out.select("*", (F.col("chi2") / (F.col("n") * (F.col("k") - 1))).alias("kendall_w"), tail("chi2", F.col("k") - 1.0).alias("p"), distance.alias("critical_distance"))


def rank_gaps(df: DataFrame, block: str, method: str, value: str, distance: float) -> DataFrame:
    """ST5: a, b, gap of mean ranks, significant."""
    means = df.withColumn("r", average_rank(value, [block])).groupBy(method).agg(F.avg("r").alias("r"))
    a, b = means.select(F.col(method).alias("a"), F.col("r").alias("ra")), means.select(F.col(method).alias("b"), F.col("r").alias("rb"))
    gap = F.abs(F.col("ra") - F.col("rb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", gap.alias("gap"), (gap > distance).alias("significant"))


def wilcoxon(pairs: DataFrame, keys: list[str], least: int = 6, eps: float = 1e-15) -> DataFrame:
    """ST6, ST17: n non-zero deltas, w (smaller rank sum), z, p (normal, with ties); fewer than ``least``: the sign test's p."""
    rows = pairs.where(F.abs("delta") > eps).withColumn("m", F.round(F.abs("delta"), 12))
    ranked = rows.withColumn("r", average_rank("m", keys, False)).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy(*keys, "m")))
    d = F.col("delta")
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(d > 0, F.col("r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(d < 0, F.col("r")).otherwise(0.0)).alias("w_minus"),
        F.count_if(d > 0).alias("wins"),
        F.sum(F.expr("t * t - 1")).alias("ties"),
    )
    z = F.expr("(least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)")

    @F.pandas_udf("double")
    def tail(z: pd.Series, n: pd.Series, wins: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * normal_sf(abs(a))) if b >= least else sign_test(int(w), int(b - w)) for a, b, w in zip(z, n, wins, strict=True)])

    return sums.select(*keys, "n", F.least("w_plus", "w_minus").alias("w"), z.alias("z"), tail(z, "n", "wins").alias("p"))


def paired_t(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """ST7: n, mean, t, p; null without spread."""
    s = pairs.groupBy(*keys).agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"))

    @F.pandas_udf("double")
    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else t_two_sided(a, b - 1) for a, b in zip(t, n, strict=True)], dtype="float64")

    t = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return s.select(*keys, "n", "mean", t.alias("t")).withColumn("p", tail("t", "n"))


def effect_sizes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """ST8, ST9: of b over a: paired dz; d by root mean variance; d pooled; Hedges' g of each kind."""
    s = pairs.groupBy(*keys).agg(
        F.count("delta").cast("double").alias("n"), F.avg("delta").alias("m"), F.stddev_samp("delta").alias("sd"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb")
    )
    guard = lambda top, bottom: F.when(F.expr(bottom) > 0, F.expr(top) / F.expr(bottom))
    dz, d = guard("m", "sd"), guard("m", "sqrt((va + vb) / 2)")
    pooled_j, paired_j = F.expr("1 - 3 / (4 * (2 * n) - 9)"), F.expr("CASE WHEN n > 3 THEN 1 - 3 / (4 * n - 5) ELSE 1 END")
    return s.select(*keys, F.col("n").cast("long").alias("n"), dz.alias("dz"), d.alias("d"), (d * pooled_j).alias("g"), (dz * paired_j).alias("g_paired"))


def bootstrap_mean(pairs: DataFrame, order: list[str], resamples: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """ST12: mean, lo, hi of the mean delta's percentile interval. Draws are md5 of (seed, resample, place) modulo n.

    The table is one of results, some hundred rows: places are joined to places, so rows meet no other rows.
    """
    w = Window.partitionBy()
    rows = pairs.select("delta", (F.row_number().over(Window.orderBy(*order)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    draws = rows.select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10)
    drawn = draws.select("b", (digits.cast("long") % F.col("n")).alias("i"))
    means = drawn.join(rows.select("i", "delta"), "i").groupBy("b").agg(F.avg("delta").alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))


def permutation_p(df: DataFrame, x: str, y: str, order: list[str], rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """ST13: rho and the share of permutations (md5 order) with a correlation of ranks as great."""
    ranked = df.select(average_rank(x, [], False).alias("x"), average_rank(y, [], False).alias("y"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("i"))
    turns = ranked.select("i", "y", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("b"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string")))
    shuffled = turns.select("b", "y", (F.row_number().over(Window.partitionBy("b").orderBy(key)) - 1).alias("i"))
    rho = ranked.agg(F.corr("x", "y").alias("rho"))
    each = shuffled.join(ranked.select("i", "x"), "i").groupBy("b").agg(F.corr("x", "y").alias("r"))
    return each.crossJoin(F.broadcast(rho)).groupBy("rho").agg(F.avg((F.abs("r") >= F.abs("rho") - 1e-12).cast("double")).alias("p"))  # one row


def friedman_plain(df: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """ST2: k, n, chi2 without a correction of ties: 12 n / (k (k + 1)) times the squared gaps of mean ranks to (k + 1) / 2."""
    ranked = df.withColumn("__r", average_rank(value, [block]))
    mean = ranked.groupBy(method).agg(F.avg("__r").alias("r"), F.count(F.lit(1)).alias("n"))
    total = mean.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    gaps = F.expr("ss - s * (k + 1) + k * (k + 1) * (k + 1) / 4D")
    return total.select(F.col("k").cast("int").alias("k"), F.col("n").cast("int").alias("n"), (F.expr("12D * n / (k * (k + 1))") * gaps).alias("chi2"))


def required_n(r: Column, alpha_z: float = 1.96, power_z: float = 0.842) -> Column:
    """ST14: rows for a correlation r to be found."""
    return F.ceil((alpha_z + power_z) ** 2 / (F.atanh(r) * F.atanh(r)) + 3)


def detectable(n: Column, alpha_z: float = 1.96, power_z: float = 0.84) -> Column:
    """ST22: on the z scale."""
    return F.lit(alpha_z + power_z) / F.sqrt(n - 3)


def bonferroni(p: Column, tests: Column) -> Column:
    """ST20."""
    return F.least(F.lit(1.0), p * tests)


def g_difference_z(g1: Column, n1: Column, g2: Column, n2: Column) -> Column:
    """ST21: with SE = sqrt(2 / n + g^2 / 2n) of each."""
    var = lambda g, n: 2 / n + g * g / (2 * n)
    return (g1 - g2) / F.sqrt(var(g1, n1) + var(g2, n2))


def rope_shares(pairs: DataFrame, keys: list[str], rope: float = 0.01, closed: bool = False) -> DataFrame:
    """ST11: shares of deltas left of, in and right of the region; ``closed`` puts its ends inside."""
    d = F.col("delta")
    inside = F.abs(d) <= rope if closed else F.abs(d) < rope
    share = lambda c: F.avg(c.cast("double"))
    return pairs.groupBy(*keys).agg(share(~inside & (d < 0)).alias("left"), share(inside).alias("rope"), share(~inside & (d > 0)).alias("right"))


def bayesian_signed_rank(pairs: DataFrame, rope: float = 0.01, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """ST10: left, rope, right: Monte-Carlo shares under a Dirichlet prior with a pseudo-row of 0, for some hundred rows."""
    rows = pairs.select("delta", F.lit(1).alias("all"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = np.append(np.sort(pdf["delta"].to_numpy()), 0.0)
        mean = x[:, None] + x[None]
        rng = np.random.default_rng(seed)
        won = np.zeros(3)
        for _ in range(draws):
            w = rng.dirichlet(np.append(np.ones(len(x) - 1), 0.5))
            outer = w[:, None] * w[None]
            shares = [outer[mean < -2 * rope].sum(), outer[abs(mean) <= 2 * rope].sum(), outer[mean > 2 * rope].sum()]
            won[int(np.argmax(shares))] += 1
        return pd.DataFrame([won / draws], columns=["left", "rope", "right"])

    return rows.groupBy("all").applyInPandas(run, "left double, rope double, right double")


def decay_fit(x: list[float], y: list[float], rounds: int = 100) -> tuple[float, float]:
    """ST16: y = a exp(-b x) by Gauss-Newton from the log-linear fit; (a, b)."""
    import numpy as np

    xs, ys = np.asarray(x, float), np.asarray(y, float)
    b, log_a = np.polyfit(xs, np.log(np.maximum(ys, 1e-12)), 1)
    a, b = math.exp(log_a), -b
    for _ in range(rounds):
        e = np.exp(-b * xs)
        step = np.linalg.lstsq(np.stack([e, -a * xs * e], 1), ys - a * e, rcond=None)[0]
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-12:
            break
    return float(a), float(b)


