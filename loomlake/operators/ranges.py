"""Running sums, numbers and exact quantiles over any number of rows: by ranges of the order, never in one task.

Rows are dealt by ranges of the order and written with the range's number. Each range is summed, and its rows start from
what the ranges before it hold: a table of a row for each range and key that it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import small_or_merge, stored

_PART = "__part"


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: list[str], few_keys: bool = False) -> DataFrame:
    """df with run_c, the sum of c up to each row in the order of its key, and all_c, the key's sum, for each c of sums.

    Keys aren't null; few_keys: they are columns or leaves, which spares a count. Rows that the order doesn't tell apart
    lie in one range, in any order.
    """
    ranged = stored(df.repartitionByRange(*keys, *order).withColumn(_PART, F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, _PART).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    ahead = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum(f"__{c}").over(ahead), F.lit(0)).alias(f"__from_{c}") for c in sums]
    every = [F.sum(f"__{c}").over(Window.partitionBy(*keys)).alias(f"all_{c}") for c in sums]
    before = totals.select(*keys, _PART, *starts, *every)  # fewer rows than ranges and keys together
    before = F.broadcast(before) if few_keys or not keys else small_or_merge(stored(before, "starts"))
    inside = Window.partitionBy(_PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({f"run_{c}": F.sum(c).over(inside) for c in sums}).join(before, [_PART, *keys])
    return placed.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"__from_{c}") for c in sums}).drop(_PART, *[f"__from_{c}" for c in sums])


def numbered(df: DataFrame, order: list[str | Column], out: str, keys: list[str] | None = None, total: str | None = None) -> DataFrame:
    """df with out, the place from 0 of each row in the order of its key, and total, the key's rows, if it is named."""
    placed = running(df.withColumn("__one", F.lit(1).cast("long")), keys or [], order, ["__one"])
    named = placed.withColumn(out, F.col("run___one") - 1)
    named = named.withColumn(total, F.col("all___one")) if total else named
    return named.drop("__one", "run___one", "all___one")


def at_quantiles(cells: DataFrame, keys: list[str], value: str, levels: list[float], sums: list[str]) -> DataFrame:
    """keys (few), level (its place), quantile, run_c and all_c of sums at the last value that isn't above the quantile.

    cells has a row for each key and distinct value, with ``n`` rows and the sums. Quantiles are exact, between two ranks
    in proportion. A key has a row for each level.
    """
    every = list(dict.fromkeys(["n", *sums]))
    run = running(cells, keys, [value], every, few_keys=True)
    first, last = F.col("run_n") - F.col("n"), F.col("run_n") - 1
    hits = []
    for i, p in enumerate(levels):
        place = F.lit(float(p)) * (F.col("all_n") - 1)
        low = F.floor(place)
        high = F.least(low + 1, F.col("all_n") - 1)
        share = place - low
        hits += [F.when((low >= first) & (low <= last), F.struct(F.lit(i).alias("level"), F.lit(0).alias("side"), share.alias("share")))]
        hits += [F.when((high >= first) & (high <= last), F.struct(F.lit(i).alias("level"), F.lit(1).alias("side"), share.alias("share")))]
    found = run.withColumn("__hit", F.explode(F.array_compact(F.array(*hits)))).select(*keys, value, "__hit.*", *[f"{x}_{c}" for c in every for x in ("run", "all")])
    low = lambda c: F.max(F.when(F.col("side") == 0, F.col(c)))
    low_v, high_v = low(value), F.max(F.when(F.col("side") == 1, F.col(value)))
    picked = found.groupBy(*keys, "level").agg(
        (low_v + (high_v - low_v) * F.max("share")).alias("quantile"), *[low(f"{x}_{c}").alias(f"{x}_{c}") for c in every for x in ("run", "all")]
    )
    return picked


def exact_quantiles(df: DataFrame, columns: list[str], levels: list[float]) -> dict[str, list[float]]:
    """Of each column its exact quantiles; [] where all values are null. What comes to the driver is one number each."""
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    counted = df.select(F.explode(cells).alias("c")).select("c.*").where("x is not null").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    found: dict[str, list[float]] = {c: [] for c in columns}
    for r in at_quantiles(counted, ["k"], "x", levels, []).orderBy("k", "level").collect():
        found[columns[r["k"]]].append(r["quantile"])
    return found
