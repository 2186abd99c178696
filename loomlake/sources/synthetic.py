"""Planted synthetic tables from seeded columns, and checks that what was planted can be found."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import equi_width, quantile_bins, stratified_folds
from ..operators.information import pair_information


@dataclass(frozen=True)
class Variant:
    """rows, features, modules (kind, members, weight), noise, copies (of, copy) and their spread."""

    rows: int
    features: int
    modules: tuple[tuple[str, tuple[int, ...], float], ...]
    noise: float
    copies: tuple[tuple[int, int], ...] = ()
    spread: float = 0.0
    centred: bool = True


# The six planted tables.
VARIANTS = {
    "easy_2mod_xor": Variant(10_000, 10, (("xor", (0, 1), 1.0), ("xor", (2, 3), 1.0)), 0.1, ((0, 4), (2, 5)), 0.3),
    "medium_4mod_mixed": Variant(
        20_000, 18, (("xor", (0, 1), 1.0), ("xor", (2, 3), 1.0), ("and", (4, 5), 2.5), ("and", (6, 7), 2.5)), 0.2, ((0, 8), (2, 9), (4, 10), (6, 11)), 0.3
    ),
    "hard_4mod_unequal": Variant(
        20_000,
        31,
        (("xor", (0, 1), 1.5), ("xor", (2, 3, 4), 1.5), ("xor_sum", (5, 6, 7, 8), 0.8), ("and", (9, 10, 11, 12, 13), 8.0)),
        0.5,
        ((0, 14), (2, 15), (5, 16), (9, 17), (11, 18)),
        0.5,
    ),
    "overlapping_modules": Variant(
        20_000, 18, (("xor", (0, 1), 1.0), ("and", (2, 3), 2.5), ("xor", (4, 5), 1.0), ("and", (6, 7), 2.5)), 0.2, ((0, 8), (3, 9), (5, 10)), 0.3
    ),
    "no_structure_control": Variant(
        10_000, 20, (("linear", (0,), 0.8), ("linear", (1,), 0.6), ("linear", (2,), 0.5), ("linear", (3,), 0.4), ("linear", (4,), 0.3)), 0.3, centred=False
    ),
    "highdim_8mod": Variant(
        50_000,
        200,
        (
            *(("xor_linear", (3 * m, 3 * m + 1, 3 * m + 2), 1.0) for m in range(4)),
            *(("and", (3 * m, 3 * m + 1, 3 * m + 2), 3.0) for m in range(4, 8)),
        ),
        0.3,
        tuple((i, 24 + i) for i in range(24)),
        0.5,
    ),
}


def normal(key: str, seed: int) -> Column:
    """A standard normal value that is a hash of the row's key and the seed, so a row has it wherever it is made again."""
    uniform = lambda s: (F.pmod(F.xxhash64(key, F.lit(s)), F.lit(1 << 32)) + 0.5) / (1 << 32)
    return F.sqrt(-2 * F.log(uniform(2 * seed))) * F.cos(2 * math.pi * uniform(2 * seed + 1))


def xor_term(features: list[str]) -> Column:
    """Product of signs."""
    out = F.signum(features[0])
    for f in features[1:]:
        out = out * F.signum(f)
    return out


def and_term(features: list[str]) -> Column:
    """1 where all are positive, else -1."""
    return F.when(F.forall(F.array(*features), lambda x: x > 0), 1.0).otherwise(-1.0)


def term(kind: str, members: tuple[int, ...]) -> Column:
    """What a module adds to the score: xor, xor_sum (of pairs), xor_linear, and (1 or 0), linear."""
    names = [f"X{i}" for i in members]
    if kind == "linear":
        return F.col(names[0])
    if kind == "xor":
        return xor_term(names)
    if kind == "xor_sum":
        return xor_term(names[:2]) + xor_term(names[2:])
    if kind == "xor_linear":
        return xor_term(names[:2]) + 0.3 * F.col(names[2])
    return (and_term(names) > 0).cast("double")


def variant(spark: SparkSession, name: str, rows: int | None = None, seed: int = 42) -> DataFrame:
    """row_index, X0.., output, fold of a planted table; each table has its own stream of the master seed.

    The terms are centred by their means, so that the classes are about even.
    """
    v = VARIANTS[name]
    base = 100_003 * seed + 1009 * list(VARIANTS).index(name)
    df = spark.range(rows or v.rows).select(F.col("id").alias("row_index"), *[normal("id", base + i).alias(f"X{i}") for i in range(v.features)])
    df = df.withColumns({f"X{copy}": F.col(f"X{of}") + v.spread * normal("row_index", base + 500 + copy) for of, copy in v.copies})
    terms = [term(kind, members) for kind, members, _ in v.modules]
    means = df.agg(*[F.avg(t) for t in terms]).first() if v.centred else [0.0] * len(terms)
    score = v.noise * normal("row_index", base + 900)
    for t, mean, (_, _, weight) in zip(terms, means, v.modules, strict=True):
        score = score + weight * (t - F.lit(mean))
    return stratified_folds(df.withColumn("output", (score > 0).cast("int")), "output", ["row_index"])


def validate_variant(df: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """Check, item, value, ok: counts, class balance, information of xor members and noise (none), of each module's
    term (some), and correlation of copies. Information is of binned values, whose bias is taken off the bounds.
    """
    v = VARIANTS[name]
    n, balance = df.agg(F.count(F.lit(1)), F.avg("output")).first()
    used = {i for _, members, _ in v.modules for i in members} | {copy for _, copy in v.copies}
    noise = [i for i in range(v.features) if i not in used]
    xor = sorted({i for kind, members, _ in v.modules if kind in ("xor", "xor_sum") for i in members})
    terms = {f"T{m}": term(kind, members) for m, (kind, members, _) in enumerate(v.modules)}
    names = [f"X{i}" for i in [*xor, *noise]]
    wide = df.select("output", *names, *[F.col(f"X{i}") for i in {i for p in v.copies for i in p} - {*xor, *noise}], *[t.alias(k) for k, t in terms.items()])
    coded = equi_width(quantile_bins(wide, names, bins), list(terms), bins)  # terms may have two values
    own = {}
    for c in [*names, *terms]:  # a feature alone: its diagonal
        own[c] = pair_information(coded, [c], "output", bins).first()["mi"]
    bias = (bins - 1) / (2 * n)
    zero = max(0.01, 0.5 / math.sqrt(n)) + bias
    rows = [("sample_count", name, float(n), n == v.rows), ("feature_count", name, float(v.features), sum(c.startswith("X") for c in df.columns) == v.features), ("class_balance", name, balance, 0.35 <= balance <= 0.65)]
    rows += [("xor_marginal", f"X{i}", own[f"X{i}"], own[f"X{i}"] < zero) for i in xor]
    rows += [("module_term", k, own[k], own[k] > 0.02 - bias) for k in terms]
    rows += [("noise", f"X{i}", own[f"X{i}"], own[f"X{i}"] < zero) for i in noise]
    if v.copies:
        found = df.agg(*[F.corr(f"X{of}", f"X{copy}") for of, copy in v.copies]).first()
        rows += [("copy", f"X{copy}", r, abs(r) > 0.5) for (_, copy), r in zip(v.copies, found, strict=True)]
    return df.sparkSession.createDataFrame([(a, b, float(c), bool(d)) for a, b, c, d in rows], "check_name string, item string, value double, ok boolean")


def planted(spark: SparkSession, rows: int, features: int, modules: list[tuple[str, list[int]]], noise: float, redundant: list[tuple[int, int]] | None = None, seed: int = 42) -> DataFrame:
    """row_index, X0.., output, fold: a noisy sum of module terms, cut at 0; a redundant (copy, of) is a noisy copy."""
    df = spark.range(rows).select(F.col("id").alias("row_index"), *[normal("id", seed + i).alias(f"X{i}") for i in range(features)])
    for copy, of in redundant or []:
        df = df.withColumn(f"X{copy}", F.col(f"X{of}") + 0.1 * normal("row_index", seed + 1000 + copy))
    total = noise * normal("row_index", seed + 5000)
    for kind, members in modules:
        total = total + (xor_term if kind == "xor" else and_term)([f"X{i}" for i in members])
    df = df.withColumn("output", (total > 0).cast("int"))
    return df.withColumns({f"X{i}": F.round(f"X{i}", 6) for i in range(features)}).withColumn("fold", (F.col("row_index") % 5).cast("int"))
