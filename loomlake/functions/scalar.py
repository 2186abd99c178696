"""Scalar rules of the analytics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def zero_if_not_finite(x: Column) -> Column:
    """NaN, infinities and null count as 0."""
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


def null_if_not_finite(x: Column, sentinel: float | None = None) -> Column:
    """For sinks: what JSON can't hold becomes null, or the sentinel."""
    return F.when(is_finite(x), x).otherwise(F.lit(sentinel).cast("double"))


def to_number(x: Column) -> Column:
    """A number, or null where the text is none."""
    return x.try_cast("double")


def near_zero_sign(x: Column, eps: float) -> Column:
    return F.when(x > eps, 1).when(x < -eps, -1).otherwise(0)


def effect_size_label(x: Column) -> Column:
    a = F.abs(x)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def equi_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0..bins-1; a constant column is bin 0, the maximum is in the last bin."""
    place = F.floor((x - low) / (high - low) * bins)
    return F.when(high > low, F.least(F.lit(bins - 1), F.greatest(F.lit(0), place))).otherwise(0).cast("int")


def edges_bin(x: Column, edges: Column) -> Column:
    """Number of inner edges at or below x; edges has both ends. Ties share a bin."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= x)).cast("int")


def claim_status(kind: Column, expected: Column, found: Column, tolerance: Column) -> Column:
    """MATCH within the tolerance, APPROXIMATE within five times of it (orders: half, then one), else MISMATCH."""
    gap = F.abs(expected - found)
    relative = F.when(expected != 0, gap / F.abs(expected)).otherwise(gap)
    orders = F.when((expected > 0) & (found > 0), F.abs(F.log10(expected) - F.log10(found)))
    size = F.when(kind == "absolute", gap / tolerance).when(kind == "relative", relative / tolerance).otherwise(F.when(orders <= 0.5, 0.0).when(orders <= 1, 2.0).otherwise(9.0))
    return F.when(found.isNull(), "MISSING").when(size <= 1, "MATCH").when(size <= 5, "APPROXIMATE").otherwise("MISMATCH")


def is_correct(task: Column, truth: Column, prediction: Column) -> Column:
    """Classes by equal text, numbers by a relative error under a tenth."""
    t, p = truth.try_cast("double"), prediction.try_cast("double")
    return F.when(task == "regression", F.abs(t - p) / F.greatest(F.abs(t), F.lit(1e-8)) < 0.1).otherwise(truth == prediction)


def fisher_z(r: Column, limit: float = 0.9999) -> Column:
    return F.atanh(F.greatest(F.lit(-limit), F.least(F.lit(limit), r)))


def order_key(seed: int, *keys: str) -> Column:
    """A reproducible random order: md5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def dot(xs: Column, ws: Column) -> Column:
    return F.aggregate(F.zip_with(xs, ws, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
