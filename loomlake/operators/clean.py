"""Cleaning and encoding of tabular data. Each operator takes a DataFrame and names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import edges_bin, equi_width_bin, is_finite, order_key, to_number, zero_if_not_finite
from ..functions.shared import small_or_merge
from .ranges import exact_quantiles, numbered


def keep_columns(df: DataFrame, keep: list[str], target: str) -> DataFrame:
    """The listed columns that there are, and the target."""
    return df.select(*[c for c in keep if c in df.columns and c != target], target)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text that is no number becomes null."""
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with a null (or NaN) in any of the columns go."""
    return df.dropna("any", subset=columns)


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """P4."""
    return df.withColumns({c: zero_if_not_finite(F.col(c)) for c in columns})


def count_sentinels(df: DataFrame, columns: list[str], sentinel: str = "?") -> DataFrame:
    """P5: column_name, n: rows whose trimmed text is the sentinel; every column has a row."""
    counts = df.agg(*[F.count_if(F.trim(F.col(c)) == sentinel).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n")


def map_encode(df: DataFrame, column: str, codes: dict[str, int], out: str) -> DataFrame:
    """Trimmed text to its code; rows without one go."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return df.withColumn(out, table[F.trim(F.col(column))].cast("int")).where(F.col(out).isNotNull())


def ordinal_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Place among the sorted distinct values, from 0. The distinct values are ranked, not the rows."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = numbered(values, [column], out).withColumn(out, F.col(out).cast("int"))
    return df.join(small_or_merge(ranked), column, "left")


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """One row (n_distinct, task)."""
    n = F.count_distinct(target)
    task = F.when(n == 2, "binary_classification").when(n <= 100, "multiclass_classification").otherwise("regression")
    return df.agg(n.alias("n_distinct"), task.alias("task"))


def normalise_task(column):
    return F.when(F.lower(column).contains("regression"), "regression").when(F.lower(column) == "classification", "binary_classification").otherwise(F.lower(column))


def equi_width(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """P10: codes 0..bins-1 between each column's least and greatest value."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    coded = df.crossJoin(F.broadcast(ends))  # one row
    return coded.withColumns({c: equi_width_bin(F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}"), bins) for c in columns}).drop(*ends.columns)


def quantile_edges(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Of each column its distinct exact quantiles, both ends included."""
    found = exact_quantiles(df, columns, [i / bins for i in range(bins + 1)])
    return {c: list(dict.fromkeys(e)) for c, e in found.items()}


def _literal(edges: list[float]):
    return F.array(*map(F.lit, edges)).cast("array<double>")


def quantile_bins(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Equal values share a bin; a constant column is bin 0."""
    edges = quantile_edges(df, columns, bins)
    return df.withColumns({c: edges_bin(F.col(c).cast("double"), _literal(edges[c])) for c in columns})


def discretise_target(df: DataFrame, target: str, out: str, most: int = 20, bins: int = 10) -> DataFrame:
    """More distinct values than ``most``: quantile bins, else the value as an integer."""
    if df.select(target).distinct().limit(most + 2).where(F.col(target).isNotNull()).count() <= most:
        return df.withColumn(out, F.col(target).cast("int"))
    return df.withColumn(out, edges_bin(F.col(target).cast("double"), _literal(quantile_edges(df, [target], bins)[target])))


def constant_columns(df: DataFrame, columns: list[str], eps: float = 1e-10) -> DataFrame:
    """column_name, sd, is_constant; one pass over all columns."""
    sd = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "sd")
    return sd.withColumn("is_constant", F.col("sd") <= eps)


def split_fold(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training and test rows."""
    return df.where(F.col(column) != fold), df.where(F.col(column) == fold)


def first_by_index(df: DataFrame, keys: list[str], index: str, order: list[str]) -> DataFrame:
    """Of rows with the same keys and index the first; rows without an index stay."""
    rank = F.row_number().over(Window.partitionBy(*keys, index).orderBy(*order))
    have = df.where(F.col(index).isNotNull()).withColumn("__r", rank).where("__r = 1").drop("__r")
    return have.unionByName(df.where(F.col(index).isNull()))


def enumerate_rows(df: DataFrame, order: list[str], out: str, groups: list[str] | None = None) -> DataFrame:
    """Numbers from 0 in a stable order, for each group; by ranges, so that no group meets in one task."""
    return numbered(df, order, out, groups)


def stratified_folds(df: DataFrame, label: str | None, keys: list[str], folds: int = 5, seed: int = 42, parts: int = 64) -> DataFrame:
    """K1, K2: fold 0..folds-1, sizes of a class differ by one at most.

    The random order is cut into ``parts`` ranges of its first hex digits, each is ranked by itself and starts at the
    rows before it, so no class meets in one task.
    """
    digits = F.conv(F.substring("__key", 1, 4), 16, 10).cast("int")
    class_of = [label] if label else []
    rows = df.withColumn("__key", order_key(seed, *keys)).withColumn("__part", F.floor(digits * parts / 65_536).cast("int"))
    sizes = rows.groupBy(*class_of, "__part").count()
    before = F.sum("count").over(Window.partitionBy(*class_of).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*class_of, "__part", F.coalesce(before, F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy(*class_of, "__part").orderBy("__key", *keys)) - 1
    placed = rows.withColumn("__rank", rank).join(F.broadcast(starts), [*class_of, "__part"])
    return placed.withColumn("fold", ((F.col("__rank") + F.col("__start")) % folds).cast("int")).drop("__key", "__part", "__rank", "__start")


def stratified_sample(df: DataFrame, label: str, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """K3: exactly n rows (all if fewer), each class its share by largest remainders."""
    sizes = df.groupBy(label).count()
    total = F.sum("count").over(Window.partitionBy())
    share = F.col("count") * F.least(F.lit(n), total) / total
    floors = sizes.withColumn("__share", share).withColumn("__floor", F.floor("__share"))
    left = F.least(F.lit(n), F.sum("count").over(Window.partitionBy())) - F.sum("__floor").over(Window.partitionBy())
    more = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__share") - F.col("__floor"), 9)), label))
    quotas = floors.withColumn("__quota", F.col("__floor") + (more <= left).cast("int")).select(label, "__quota")
    return _first_of_class(df, label, keys, n, seed).join(F.broadcast(quotas), label).where("__rank <= __quota").drop("__rank", "__quota")


def _first_of_class(df: DataFrame, label: str, keys: list[str], n: int, seed: int) -> DataFrame:
    """The first n rows of each class in the random order; each task gives n of a class at most to the ranking."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order_key(seed, *keys), *keys))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n)


def class_quota_sample(df: DataFrame, label: str, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """K4: of each class max(1, floor(n * share)) rows."""
    sizes = df.groupBy(label).count()
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("count") / F.sum("count").over(Window.partitionBy())))
    quotas = sizes.withColumn("__quota", quota).select(label, "__quota")
    return _first_of_class(df, label, keys, n, seed).join(F.broadcast(quotas), label).where("__rank <= __quota").drop("__rank", "__quota")


def uniform_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """K5: n rows without replacement."""
    return df.withColumn("__key", order_key(seed, *keys)).orderBy("__key", *keys).limit(n).drop("__key")


def systematic_sample(df: DataFrame, order: list[str], n: int, groups: list[str] | None = None) -> DataFrame:
    """Rows floor(i * step) for i below n, step = rows / n; all if fewer."""
    rows = numbered(df, order, "__i", groups, "__rows").withColumn("__step", F.greatest(F.lit(1.0), F.col("__rows") / n))
    at = F.ceil(F.col("__i") / F.col("__step"))
    return rows.where(F.floor(at * F.col("__step")) == F.col("__i")).drop("__i", "__rows", "__step")


def scale(train: DataFrame, rows: DataFrame, columns: list[str], how: str = "minmax") -> DataFrame:
    """Scaled by the training rows' minima and ranges, or means and population deviations; constants become 0."""
    lo, width = (F.min, lambda c: F.max(c) - F.min(c)) if how == "minmax" else (F.avg, F.stddev_pop)
    fit = train.agg(*[x for c in columns for x in (lo(c).alias(f"__lo_{c}"), width(c).alias(f"__w_{c}"))])
    out = {c: F.when(F.col(f"__w_{c}") > 0, (F.col(c) - F.col(f"__lo_{c}")) / F.col(f"__w_{c}")).otherwise(0.0) for c in columns}
    return rows.crossJoin(F.broadcast(fit)).withColumns(out).drop(*fit.columns)  # one row


def validate(df: DataFrame, required: list[str], fold: str = "fold", folds: int = 5) -> DataFrame:
    """Check, n_bad over all rows: nulls in required columns, folds out of range, values that aren't finite."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float") and c in required]
    checks = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in required}
    checks |= {f"not_finite_{c}": F.count_if(F.col(c).isNotNull() & ~is_finite(F.col(c))) for c in numbers}
    if fold in df.columns:
        checks["fold_out_of_range"] = F.count_if(~F.col(fold).between(0, folds - 1) | F.col(fold).isNull())
    row = df.agg(*[v.alias(k) for k, v in checks.items()])
    return row.unpivot([], list(checks), "check_name", "n_bad")
