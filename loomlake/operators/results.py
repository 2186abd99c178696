"""Analytics over tables of results: joins, rankings, pivots, frontiers, fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered


def paired(df: DataFrame, method: str, a: str, b: str, keys: list[str], value: str) -> DataFrame:
    """Keys, a, b, delta = b - a for the keys that both methods have; null deltas go."""
    side = lambda m, name: df.where(F.col(method) == m).select(*keys, F.col(value).alias(name))
    return side(a, "a").join(side(b, "b"), keys).withColumn("delta", F.col("b") - F.col("a")).where("delta is not null")


def paired_by_place(df: DataFrame, method: str, a: str, b: str, groups: list[str], order: list[str], value: str) -> DataFrame:
    """Groups, place, a, b, delta: rows of both methods with the same place in the order; of groups in which the
    methods have not as many rows there is none.
    """
    side = lambda m, name: numbered(df.where(F.col(method) == m), order, "place", groups, f"__n_{name}").select(*groups, "place", f"__n_{name}", F.col(value).alias(name))
    met = side(a, "a").join(side(b, "b"), [*groups, "place"]).where("__n_a = __n_b")
    return met.select(*groups, "place", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def stacked(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts with the part's number, columns by name."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(F.lit(i).alias("part"), "*") for i, p in enumerate(parts)])


def last_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same keys the last in the order, as a table of keys holds it."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__r", rank).where("__r = 1").drop("__r")


def lookup_last(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Left join to the last row of right for each key; where both have a column the left value counts if not null."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    last = right.withColumn("__r", rank).where("__r = 1").select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    out = left.join(last, keys, "left")
    own = set(left.columns)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in own else F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def at_chosen(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are chosen."""
    return df.join(chosen.select(*keys), keys, "left_semi")


def scatter(rows: DataFrame, predictions: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Predictions placed at their rows as text; none is the empty text."""
    return rows.join(predictions.select(*keys, F.col("prediction").cast("string").alias(out)), keys, "left").fillna("", [out])


def with_default(df: DataFrame, table: DataFrame, keys: list[str], column: str, default) -> DataFrame:
    """J9, J10."""
    return df.join(table.select(*keys, column), keys, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def first_of(df: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The value of a, else that of b."""
    x, y = (t.select(*keys, F.col(column).alias(n)) for t, n in ((a, "__a"), (b, "__b")))
    return df.join(x, keys, "left").join(y, keys, "left").withColumn(column, F.coalesce("__a", "__b")).drop("__a", "__b")


def missing_cells(df: DataFrame, axes: list[str], domains: dict[str, list] | None = None) -> DataFrame:
    """Cells of the grid of axis values that have no row. The grid is small by definition: values are configurations."""
    spark = df.sparkSession
    values = [spark.createDataFrame([(v,) for v in domains[a]], [a]) if domains and a in domains else df.select(a).distinct() for a in axes]
    grid = reduce(lambda x, y: x.crossJoin(y), values)
    return grid.join(df.select(*axes).distinct(), axes, "left_anti")


def members(modules: DataFrame, out: str = "feature") -> DataFrame:
    """Module, feature."""
    return modules.select("module", F.explode("features").alias(out))


def delta_to_reference(df: DataFrame, method: str, reference: str, keys: list[str], value: str, names: dict[str, str] | None = None) -> DataFrame:
    """Rows with their method's mapped name and the difference to the reference method's row; without one they go."""
    if names:
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        df = df.withColumn(method, table[F.col(method)]).where(F.col(method).isNotNull())
    base = df.where(F.col(method) == reference).select(*keys, F.col(value).alias("__base"))
    return df.join(base, keys).withColumn("delta", F.col(value) - F.col("__base")).drop("__base")


def summary(df: DataFrame, keys: list[str], value: str, ddof: int = 0, single: float | None = None) -> DataFrame:
    """A1, A2: n, mean, sd; ``single`` is the sd of one row for ddof 1 (else null)."""
    sd = F.stddev_pop(value) if ddof == 0 else F.coalesce(F.stddev_samp(value), F.lit(single).cast("double"))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"))


def best_setting(df: DataFrame, keys: list[str], setting: str, value: str) -> DataFrame:
    """For each key the setting with the greatest mean, the smallest of equals."""
    means = df.groupBy(*keys, setting).agg(F.avg(value).alias("mean"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("mean", 9)), setting))
    return means.withColumn("__r", rank).where("__r = 1").drop("__r")


def pivot_means(df: DataFrame, row: str, column: str, values: list[str], value: str, impute: bool = False) -> DataFrame:
    """One column for each listed value; imputed cells get their column's mean."""
    wide = df.groupBy(row).pivot(column, values).agg(F.avg(value))
    return wide.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(Window.partitionBy())) for c in values}) if impute else wide


def average_rank(value: Column | str, groups: list[str], descending: bool = True) -> Column:
    """Mean of the places that equal values share, as a double."""
    v = F.col(value) if isinstance(value, str) else value
    order = v.desc() if descending else v.asc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, v))
    return F.rank().over(Window.partitionBy(*groups).orderBy(order)).cast("double") + (ties - 1) / F.lit(2.0)


def ordinal_rank(value: str, groups: list[str], tie: list[str], descending: bool = True) -> Column:
    """W2."""
    order = F.desc(value) if descending else F.asc(value)
    return F.row_number().over(Window.partitionBy(*groups).orderBy(order, *tie))


def top_of_group(df: DataFrame, groups: list[str], value: str, tie: list[str], k: int, descending: bool = True) -> DataFrame:
    """The k first rows of each group, with place."""
    return df.withColumn("place", ordinal_rank(value, groups, tie, descending)).where(F.col("place") <= k)


def winners(df: DataFrame, group: str, method: str, value: str) -> DataFrame:
    """Group, winner, runner_up, gap."""
    top = top_of_group(df, [group], value, [method], 2)
    pick = lambda c, p: F.max(F.when(F.col("place") == p, F.col(c)))
    return top.groupBy(group).agg(pick(method, 1).alias("winner"), pick(method, 2).alias("runner_up"), (pick(value, 1) - pick(value, 2)).alias("gap"))


def gaps(df: DataFrame, order: list[str], value: str, groups: list[str] | None = None) -> DataFrame:
    """Difference to the value before."""
    return df.withColumn("gap", F.col(value) - F.lag(value).over(Window.partitionBy(*(groups or [])).orderBy(*order)))


def holm(df: DataFrame, p: str, tie: list[str], groups: list[str] | None = None) -> DataFrame:
    """Holm's adjusted p-values: running maxima of p * (tests left), 1 at most; null p-values are no tests."""
    g = groups or []
    valid = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    by = Window.partitionBy(*g).orderBy(p, *tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*g))
    stepped = valid.withColumn("__s", F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(by) + 1)))
    done = stepped.withColumn("p_holm", F.max("__s").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")
    return done.unionByName(df.where(F.col(p).isNull() | F.isnan(p)).withColumn("p_holm", F.lit(None).cast("double")))


def rank_cliques(df: DataFrame, name: str, rank: str, distance: float) -> DataFrame:
    """Maximal runs (first, last, size) of methods by rank that lie within the critical distance."""
    by = Window.partitionBy().orderBy(rank, name)
    rows = df.withColumn("i", F.row_number().over(by))
    a, b = rows.alias("a"), rows.alias("b")
    reach = a.join(b, (F.col("b.i") > F.col("a.i")) & (F.col(f"b.{rank}") - F.col(f"a.{rank}") <= distance))
    reach = reach.groupBy(F.col("a.i").alias("i"), F.col(f"a.{name}").alias("first")).agg(F.max("b.i").alias("j"))
    outer = F.max("j").over(Window.partitionBy().orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    kept = reach.withColumn("__o", outer).where(F.col("__o").isNull() | (F.col("j") > F.col("__o")))
    last = rows.select(F.col("i").alias("j"), F.col(name).alias("last"))
    return kept.join(last, "j").select("first", "last", (F.col("j") - F.col("i") + 1).alias("size"))


def pareto(df: DataFrame, cost: str, gain: str, mode: str = "weak", groups: list[str] | None = None) -> DataFrame:
    """J8, PF1-PF3: rows on the frontier of small cost and great gain.

    strict: no other row has less cost and more gain. weak: none is as good in both and better in one. all: the row is as
    good as every other in both. Sorted windows do it in one pass; rows of a group never meet pairwise.
    """
    g = groups or []
    same_cost = Window.partitionBy(*g, cost)
    everything = Window.partitionBy(*g)
    if mode == "all":
        keep = (F.col(cost) == F.min(cost).over(everything)) & (F.col(gain) == F.max(gain).over(everything))
        return df.withColumn("__k", keep).where("__k").drop("__k")
    top = df.withColumn("__top", F.max(gain).over(same_cost))
    steps = df.groupBy(*g, cost).agg(F.max(gain).alias("__g"))
    below = steps.withColumn("__less", F.max("__g").over(Window.partitionBy(*g).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))).select(*g, cost, "__less")
    joined = top.join(below, [*g, cost])
    strictly = F.col("__less").isNull() | (F.col(gain) >= F.col("__less"))
    weakly = (F.col("__less").isNull() | (F.col(gain) > F.col("__less"))) & (F.col(gain) == F.col("__top"))
    return joined.where(strictly if mode == "strict" else weakly).drop("__top", "__less")


def best_trade_off(frontier: DataFrame, cost: str, gain: str, name: str, excluded: list[str], groups: list[str] | None = None) -> DataFrame:
    """PF4: the frontier's cheapest row, the excluded methods apart."""
    rows = frontier.where(~F.col(name).isin(excluded))
    rank = F.row_number().over(Window.partitionBy(*(groups or [])).orderBy(cost, F.desc(gain), name))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def win_loss_tie(pairs: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """A23, A38, ST11: counts by sign of delta beyond the tolerance, and shares."""
    d, n = F.col("delta"), F.count(F.lit(1))
    agg = [F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties"), (F.count_if(d > 0) / n).alias("win_rate")]
    return pairs.groupBy(*keys).agg(*agg) if keys else pairs.agg(*agg)


def power_law(df: DataFrame, x: str, y: str, keys: list[str], at: float) -> DataFrame:
    """y = a x^b by least squares of logarithms over x, y > 0: a, b, r2 and the value at ``at``."""
    lx, ly = F.log(x), F.log(y)
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0))
    fit = rows.groupBy(*keys).agg(F.exp(F.regr_intercept(ly, lx)).alias("a"), F.regr_slope(ly, lx).alias("b"), F.regr_r2(ly, lx).alias("r2"))
    return fit.withColumn("predicted", F.col("a") * F.pow(F.lit(at), "b"))


def line_fit(df: DataFrame, x: Column, y: str, keys: list[str]) -> DataFrame:
    """Intercept, slope, r2."""
    return df.groupBy(*keys).agg(F.regr_intercept(F.col(y), x).alias("intercept"), F.regr_slope(F.col(y), x).alias("slope"), F.regr_r2(F.col(y), x).alias("r2"))


def geometric_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A28."""
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.exp(F.avg(F.log(value))).alias("geo_mean"))


def multi_level(df: DataFrame, key: str, value: str) -> DataFrame:
    """A row for each key and one, with a null key, over all."""
    sets = df.groupingSets([[key], []], key)
    return sets.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def best_minus_reference(df: DataFrame, keys: list[str], method: str, candidates: list[str], reference: str, value: str) -> DataFrame:
    """A37."""
    best = F.max(F.when(F.col(method).isin(candidates), F.col(value)))
    base = F.max(F.when(F.col(method) == reference, F.col(value)))
    return df.groupBy(*keys).agg((best - base).alias("advantage"))


def fisher_pooled(df: DataFrame, r: str, n: str, keys: list[str], limit: float = 0.9999) -> DataFrame:
    """Correlations pooled with weights n - 3, n of 4 at least."""
    z = F.atanh(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(r))))
    rows = df.where(F.col(n) >= 4)
    pooled = F.tanh(F.sum(z * (F.col(n) - 3)) / F.sum(F.col(n) - 3)).alias("pooled")
    return rows.groupBy(*keys).agg(pooled) if keys else rows.agg(pooled)


def common_to_all(df: DataFrame, item: str, method: str) -> DataFrame:
    """U4: items that every method has."""
    n = df.agg(F.count_distinct(method).alias("__n"))
    return df.groupBy(item).agg(F.count_distinct(method).alias("__m")).crossJoin(F.broadcast(n)).where("__m = __n").select(item)  # one row


def first_stable(df: DataFrame, order: str, test: Column, groups: list[str]) -> DataFrame:
    """The least ``order`` whose row passes the test; null if none."""
    return df.groupBy(*groups).agg(F.min(F.when(test, F.col(order))).alias("first"))
