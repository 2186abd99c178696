"""Mutual information and co-information of discretised features, as one aggregation over pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import drop_stored, stored
from ..functions.tails import digamma
from .metrics import kendall_tau, spearman

#: Counts that a task keeps at once.
CELLS = 1 << 24
#: Distances that are computed at once: their arrays stay in a core's cache.
BLOCK = 1 << 16


def pair_information(df: DataFrame, codes: list[str], label: str, bins: int) -> DataFrame:
    """i, j (i <= j), mi in nats of the pair's joint code with the label; the diagonal is the feature's own.

    Rows are counted where they are read: a task keeps the counts of bins^2 codes for each pair and class, up to CELLS,
    and gives out those that aren't 0; beyond that it gives them out batch by batch. Codes must lie below ``bins``. Rows
    with a null code or label take no part.
    """
    d = len(codes)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    block = max(1, CELLS // (bins * bins))
    kind = df.select(label).schema[0].dataType.simpleString()

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}

        def given(y, first: int, cells: np.ndarray) -> pa.RecordBatch:
            p, code = np.nonzero(cells)
            i, j = (np.array([pairs[first + q][side] for q in range(len(cells))], np.int32)[p] for side in (0, 1))
            columns = [pa.array(i), pa.array(j), pa.array(code.astype(np.int32)), pa.repeat(y, len(p)), pa.array(cells[p, code])]
            return pa.RecordBatch.from_arrays(columns, ["i", "j", "code", "y", "n"])

        for batch in batches:
            classes = batch.column(d).dictionary_encode()
            which, rows = classes.indices.to_numpy(), np.stack([batch.column(c).to_numpy() for c in range(d)])
            for k, y in enumerate(classes.dictionary):
                own = rows[:, which == k]
                for first in range(0, len(pairs), block):
                    some = pairs[first : first + block]
                    cells = np.stack([np.bincount(own[i] * bins + own[j], minlength=bins * bins) for i, j in some])
                    if len(pairs) > block or (len(held) + 1) * cells.size > CELLS and y not in held:
                        yield given(y, first, cells)
                    else:
                        held[y] = held[y] + cells if y in held else cells
        for y, cells in held.items():
            yield given(y, 0, cells)

    usable = df.select(*[F.col(c).cast("int") for c in codes], label).dropna()
    counts = usable.mapInArrow(count, f"i int, j int, code int, y {kind}, n long").groupBy("i", "j", "code", "y").agg(F.sum("n").alias("n"))
    total = lambda *k: F.sum("n").over(Window.partitionBy("i", "j", *k))  # noqa: E731  over bins^2 codes and the classes
    sized = counts.select("i", "j", F.col("n").cast("double").alias("n"), total("code").alias("nx"), total("y").alias("ny"), total().alias("rows"))
    return sized.groupBy("i", "j").agg(F.sum(F.col("n") / F.col("rows") * F.log(F.col("n") * F.col("rows") / (F.col("nx") * F.col("ny")))).alias("mi"))


def co_information(df: DataFrame, codes: list[str], label: str, bins: int) -> DataFrame:
    """I, j (i < j), coi = I_i + I_j - I_ij; positive for redundancy, negative for synergy."""
    mi = pair_information(df, codes, label, bins)
    own = lambda side: F.max(F.when(F.col("i") == F.col("j"), F.col("mi"))).over(Window.partitionBy(side))  # noqa: E731  features
    both = mi.select("i", "j", "mi", own("i").alias("of_i"), own("j").alias("of_j"))
    return both.where("i < j").select("i", "j", (F.col("of_i") + F.col("of_j") - F.col("mi")).alias("coi"))


def knn_information(points: np.ndarray, label: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate (nats) of I(X; Y), X continuous, Y discrete, Chebyshev distances, not clipped.

    Blocks of rows keep the distance matrix bounded. A class of one row has no neighbours and is left out.
    """
    classes, y, sizes = np.unique(label, return_inverse=True, return_counts=True)
    keep = sizes[y] > 1
    points, y = points[keep], np.unique(y[keep], return_inverse=True)[1]
    n = len(points)
    if n < 2:
        return 0.0
    sizes = np.bincount(y)
    near, within = np.zeros(n), np.zeros(n)
    ks = np.minimum(k, sizes - 1)[y]
    for at in range(0, n, 512):
        part = points[at : at + 512]
        gap = np.abs(part[:, None, :] - points[None]).max(2)
        gap[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
        own = np.sort(np.where(y[at : at + 512, None] == y[None], gap, np.inf), 1)
        near[at : at + 512] = own[np.arange(len(part)), ks[at : at + 512] - 1]
        within[at : at + 512] = (gap < near[at : at + 512, None]).sum(1)
    return float(digamma(np.array([n]))[0] + digamma(ks).mean() - digamma(sizes[y]).mean() - digamma(within + 1).mean())


class Buckets:
    """Points of the plane in 2^levels buckets of one size, cut at medians of the wider side; spare places are at infinity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rows: int = 24):
        n = len(x)
        levels = max(0, int(np.log2(max(n, 1) / rows)))
        spare = (max(1, -(-n >> levels)) << levels) - n
        far = np.full(spare, np.inf)
        self.at = np.concatenate([np.arange(n), np.full(spare, -1)])[None]
        self.x, self.y = np.concatenate([x, far])[None], np.concatenate([y, far])[None]
        self.boxes = [self._box()]
        for _ in range(levels):
            nodes, size = self.x.shape
            box = self.boxes[-1]
            wide = box[1] - box[0] >= box[3] - box[2]
            order = np.argpartition(np.where(wide[:, None], self.x, self.y), size // 2, axis=1)
            self.at, self.x, self.y = (np.take_along_axis(v, order, 1).reshape(2 * nodes, size // 2) for v in (self.at, self.x, self.y))
            self.boxes.append(self._box())

    def _box(self) -> np.ndarray:
        out = []
        for v in (self.x, self.y):
            high = v.max(1)
            partly = np.flatnonzero(np.isinf(high))
            high[partly] = np.where(np.isinf(v[partly]), -np.inf, v[partly]).max(1)
            out += [v.min(1), high]
        return np.stack(out)

    def back(self, values: np.ndarray) -> np.ndarray:
        """Values by bucket and place in the order in which the points came."""
        real = self.at.ravel() >= 0
        flat = values.reshape(self.at.size, *values.shape[2:])
        out = np.empty((int(real.sum()), *flat.shape[1:]), values.dtype)
        out[self.at.ravel()[real]] = flat[real]
        return out

    def placed(self, values: np.ndarray, spare: float) -> np.ndarray:
        """Values in the points' order by bucket and place."""
        out = np.full((self.at.size, *values.shape[1:]), spare, values.dtype)
        real = self.at.ravel() >= 0
        out[real] = values[self.at.ravel()[real]]
        return out.reshape(*self.at.shape, *values.shape[1:])

    def met_by(self, asks: Buckets, r: np.ndarray, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of asking points (bucket times size) and buckets here with a box nearer than r; ``own``: not its own."""
        size = asks.x.shape[1]
        real = asks.at >= 0
        slack = r + 1e-15 * (np.where(real, np.abs(asks.x) + np.abs(asks.y), 0) + r)
        low, high = (lambda v: np.where(real, v - slack, np.inf).min(1)), (lambda v: np.where(real, v + slack, -np.inf).max(1))
        around = [low(asks.x), high(asks.x), low(asks.y), high(asks.y)]
        q, node = np.arange(len(asks.x)), np.zeros(len(asks.x), np.int64)
        for level, box in enumerate(self.boxes):
            if level:
                q, node = np.repeat(q, 2), (2 * node[:, None] + [0, 1]).ravel()
            ok = (box[0][node] < around[1][q]) & (box[1][node] > around[0][q]) & (box[2][node] < around[3][q]) & (box[3][node] > around[2][q])
            q, node = q[ok], node[ok]
        if own:
            q, node = q[q != node], node[q != node]
        step = max(1, BLOCK // size)
        for at in range(0, len(q), step):
            a, b = q[at : at + step], node[at : at + step]
            x, y, reach, (x0, x1, y0, y1) = asks.x[a], asks.y[a], r[a], self.boxes[-1][:, b, None]
            pair, place = np.nonzero((x0 - x < reach) & (x - x1 < reach) & (y0 - y < reach) & (y - y1 < reach))
            yield a[pair] * size + place, b[pair]

    def gaps(self, x: np.ndarray, y: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Chebyshev distances of points to all of a bucket each."""
        out, other = self.x[bucket], self.y[bucket]
        out -= x[:, None]
        other -= y[:, None]
        return np.maximum(np.abs(out, out=out), np.abs(other, out=other), out=out)


def _least(gap: np.ndarray, k: int) -> np.ndarray:
    """The k least of each row, in order, inf where there are fewer."""
    if gap.shape[1] > k:
        return np.sort(np.partition(gap, k - 1, 1)[:, :k], 1)
    return np.sort(np.pad(gap, ((0, 0), (0, k - gap.shape[1])), constant_values=np.inf), 1)


def _nearer(there: Buckets, asks: Buckets, d: np.ndarray, need: int, own: bool = False) -> np.ndarray:
    """d (bucket, place, k) of the asking points with distances to the points there that are less."""
    shape, k = d.shape, d.shape[2]
    met = list(there.met_by(asks, d[:, :, need - 1], own))
    d, x, y = d.reshape(-1, k).copy(), asks.x.ravel(), asks.y.ravel()
    if met:
        point, bucket = (np.concatenate([m[side] for m in met]) for side in (0, 1))
        order = np.argsort(point, kind="stable")
        point, bucket = point[order], bucket[order]
        first = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])[: len(point)]
        many = np.diff(np.r_[first, len(point)])
        turn, step = 0, max(1, BLOCK // there.x.shape[1])
        while len(first):  # each point asks one bucket a turn
            for at in range(0, len(first), step):
                here = first[at : at + step] + turn
                p = point[here]
                d[p] = np.sort(np.concatenate([d[p], _least(there.gaps(x[p], y[p], bucket[here]), k)], 1), 1)[:, :k]
            turn += 1
            left = many > turn
            first, many = first[left], many[left]
    return d.reshape(shape)


def _near_others(z: Buckets, k: int, need: int) -> np.ndarray:
    """The k least distances of each point of z to others of z."""
    nodes, size = z.x.shape
    d = np.empty((nodes, size, k))
    step = max(1, BLOCK // (size * size))
    for at in range(0, nodes, step):
        x, y = z.x[at : at + step], z.y[at : at + step]
        with np.errstate(invalid="ignore"):
            gap = np.maximum(np.abs(x[:, :, None] - x[:, None]), np.abs(y[:, :, None] - y[:, None]))
        gap[:, np.arange(size), np.arange(size)] = np.inf
        d[at : at + step] = _least(gap.reshape(-1, size), k).reshape(len(x), size, k)
    d[z.at < 0] = 0.0  # spare places ask for nothing
    return _nearer(z, z, d, need, True)


def _within(there: Buckets, asks: Buckets, r: np.ndarray) -> np.ndarray:
    """How many points there are nearer than r to each asking point."""
    out, x, y, reach = np.zeros(r.size, np.int64), asks.x.ravel(), asks.y.ravel(), r.ravel()
    step = max(1, BLOCK // there.x.shape[1])
    for points, buckets in there.met_by(asks, r):
        for at in range(0, len(points), step):
            p, b = points[at : at + step], buckets[at : at + step]
            np.add.at(out, p, (there.gaps(x[p], y[p], b) < reach[p, None]).sum(1))
    return out.reshape(r.shape)


def _line_near(x: np.ndarray, k: int) -> np.ndarray:
    """The k least distances of each value of x, which ascends, to others."""
    out = np.full((len(x), 2 * k), np.inf)
    for s in range(1, min(k, len(x) - 1) + 1):
        out[s:, s - 1] = out[:-s, k + s - 1] = x[s:] - x[:-s]
    return np.sort(out, 1)[:, :k]


def _line_within(there: np.ndarray, x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many of the ascending values there are nearer than r to each x; differences are compared, as in the plane."""
    n = len(there)
    first, end = np.searchsorted(there, x - r), np.searchsorted(there, x + r)
    value = np.r_[there, np.inf]
    moves = [
        (first, -1, lambda i, at: (i > 0) & (x[at] - value[i - 1] < r[at])),
        (first, 1, lambda i, at: (i < n) & (x[at] - value[i] >= r[at])),
        (end, 1, lambda i, at: (i < n) & (value[i] - x[at] < r[at])),
        (end, -1, lambda i, at: (i > 0) & (value[i - 1] - x[at] >= r[at])),
    ]
    for place, step, wrong in moves:  # sums are rounded
        at = np.arange(len(x))
        while len(at := at[wrong(place[at], at)]):
            place[at] += step
    return np.maximum(end - first, 0)


def knn_co_information(df: DataFrame, features: list[str], label: str, k: int = 3, most_rows: int | None = None, clip: bool = False, base: float = np.e, leaf_rows: int = 1 << 19) -> DataFrame:
    """I, j, coi by nearest neighbours over all rows whose features are numbers and whose label is not null.

    Each pair of features is a plane, dealt to strips of about ``leaf_rows`` rows by the feature with more values; one
    shuffle serves all pairs of that feature. A strip finds the neighbours of each class and counts the rows within
    their distance, in buckets of a few rows. Rows whose distance reaches beyond their strip ask the strips it meets,
    first for neighbours and then for counts; only rows that lie as near to a strip's edge as some distance reaches are
    read again for them. All distances are exact. Ties are broken by a normal noise of 1e-10 that is a hash of the row;
    equal rows are numbered where there are any. Only where a caller asks for ``most_rows`` are so many taken, by a hash.
    """
    import pandas as pd

    spark = df.sparkSession
    usable = df.where(F.col(label).isNotNull()).where(~F.exists(F.array(*[F.col(c).cast("double") for c in features]), lambda v: v.isNull() | F.isnan(v)))
    if most_rows is not None:
        usable = usable.orderBy(F.xxhash64(*df.columns), *df.columns).limit(most_rows)
    each = [g(F.col(c).cast("double")).alias(f"{name}{f}") for f, c in enumerate(features) for name, g in (("m", F.avg), ("s", F.stddev_pop), ("u", F.approx_count_distinct))]
    known = [r for r in usable.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"), *each).collect() if r["n"] > 1]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    n = sum(r["n"] for r in known)
    if not n:
        return spark.createDataFrame([(i, j, 0.0) for i, j in pairs if i < j], "i int, j int, coi double")
    classes, counts = [r["y"] for r in known], [n, *[r["n"] for r in known]]
    mean = [sum(r["n"] * r[f"m{f}"] for r in known) / n for f in range(len(features))]
    deviation = [np.sqrt(sum(r["n"] * (r[f"s{f}"] ** 2 + (r[f"m{f}"] - mean[f]) ** 2) for r in known) / n) for f in range(len(features))]
    axes = sorted(range(len(features)), key=lambda f: -max(r[f"u{f}"] for r in known))
    planes = {f: [(p, i + j - f) for p, (i, j) in enumerate(pairs) if min(i, j, key=axes.index) == f] for f in axes}  # pair, the other feature
    axis_of = {p: f for f, some in planes.items() for p, _ in some}
    needs = [min(k, c - 1) for c in counts]
    cores = spark.sparkContext.defaultParallelism
    strips = -(-n // (leaf_rows * cores)) * cores if n * 16 > leaf_rows * cores else -(-n * 16 // leaf_rows)
    code = F.create_map(*[c for t, y in enumerate(classes) for c in (F.lit(y), F.lit(t + 1))])
    d_columns = [f"d{q}" for q in range(k)]
    ask = ["p", "t", "strip", "id", "x", "y"]
    row = "p int, t int, strip int, id long, x double, y double, " + ", ".join(f"{c} double" for c in d_columns)

    def numbers(copied: bool) -> DataFrame:
        """t, the class from 1, and x0, x1, ..., the features in deviations."""
        own = usable.where(F.col(label).isin(classes))
        own = own.withColumn("__copy", F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(0))) if copied else F.lit(1))
        every = [*df.columns, "__copy"]
        uniform = lambda s: (F.pmod(F.xxhash64(*every, F.lit(s)), F.lit(1 << 32)) + 0.5) / (1 << 32)
        noise = lambda f: F.sqrt(-2 * F.log(uniform(2 * f))) * F.cos(2 * np.pi * uniform(2 * f + 1)) * 1e-10
        x = [((F.col(c).cast("double") - mean[f]) / float(deviation[f] or 1.0) + noise(f)).alias(f"x{f}") for f, c in enumerate(features)]
        return stored(own.select(code[F.col(label)].alias("t"), *x), "points")

    def strip_of(f: int, check: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            parts = [pdf for pdf in batches if len(pdf)]
            if not parts:
                return
            strip = TaskContext.get().partitionId()
            at = np.argsort(np.concatenate([q[f"x{f}"].to_numpy() for q in parts]), kind="stable")
            get = lambda c: np.concatenate([q[c].to_numpy() for q in parts])[at]
            t, x = get("t"), get(f"x{f}")
            copies = 0
            if check:
                same = x[1:] == x[:-1]
                tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
                values = np.stack([get(c)[tied] for c in parts[0].columns])
                values = values[:, np.lexsort(values)]
                copies = int((values[:, 1:] == values[:, :-1]).all(0).sum())
            empty = dict.fromkeys(d_columns, np.nan)
            yield pd.DataFrame({"p": [-1], "t": copies, "strip": strip, "id": len(x), "x": x[0], "y": x[-1], **empty})
            if copies:
                return
            own = [np.flatnonzero(t == c) for c in np.unique(t)]
            for p, g in planes[f]:
                y, d = get(f"x{g}"), np.empty((len(x), k))
                for c in own:
                    need = needs[int(t[c[0]])]
                    if g == f:
                        d[c] = _line_near(x[c], k)
                    else:
                        z = Buckets(x[c], y[c])
                        d[c] = z.back(_near_others(z, k, need))
                near = d[np.arange(len(x)), np.array(needs)[t] - 1]
                inside = (x - x[0] >= near) & (x[-1] - x >= near)
                if g == f:
                    w = _line_within(x, x[inside], near[inside])
                else:
                    z = Buckets(x, y)
                    w = z.back(_within(z, z, z.placed(np.where(inside, near, 0.0), 0.0)))[inside]
                value, many = np.unique(w - (near[inside] > 0), return_counts=True)
                yield pd.DataFrame({"p": p, "t": 0, "strip": strip, "id": many, "x": value.astype(float), "y": 0.0, **empty})  # t 0: a count
                out = np.flatnonzero(~inside)
                yield pd.DataFrame({"p": p, "t": t[out], "strip": strip, "id": (strip << 32) + out, "x": x[out], "y": y[out]} | {c: d[out, q] for q, c in enumerate(d_columns)})

        return run

    def dealt(f: int, check: bool) -> DataFrame:
        some = [f"x{g}" for _, g in planes[f]]
        return stored(points.select("t", *some).repartitionByRange(strips, f"x{f}").mapInPandas(strip_of(f, check), row), "strips")

    points = numbers(False)
    found = {axes[0]: dealt(axes[0], True)}
    if found[axes[0]].where("p = -1 AND t > 0").limit(1).count():  # equal rows
        drop_stored(points)
        drop_stored(found[axes[0]])
        points = numbers(True)
        found = {axes[0]: dealt(axes[0], False)}
    found |= {f: dealt(f, False) for f in axes[1:]}
    edges, number = {}, {}
    for f in axes:
        b = found[f].where("p = -1").select("strip", "x", "y").toPandas().sort_values("x")
        edges[f] = (b["x"].to_numpy(), b["y"].to_numpy())
        number[f] = {int(s): q for q, s in enumerate(b["strip"])}
    union = found[axes[0]]
    for f in axes[1:]:
        union = union.unionByName(found[f])
    asking = union.where("t > 0 AND p >= 0")

    def sent(reach: str, own: bool):
        """Asks by leaf, the place of a strip that they meet: its rows up to one value and since another are needed."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for p, part in pdf.groupby("p"):
                    low, high = edges[axis_of[p]]
                    x, r = part["x"].to_numpy(), part[reach].to_numpy() if reach in part else part[d_columns].to_numpy()[np.arange(len(part)), np.array(needs)[part["t"].to_numpy()] - 1]
                    slack = r + 1e-15 * (np.abs(x) + r)
                    a, b = np.searchsorted(high, x - slack), np.searchsorted(low, x + slack, "right")
                    place = np.repeat(np.arange(len(x)), b - a)
                    leaf = np.arange(len(place)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[place]
                    home = part["strip"].map(number[axis_of[p]]).to_numpy()[place]
                    if not own:
                        place, leaf, home = place[leaf != home], leaf[leaf != home], home[leaf != home]
                    under, over = (x - slack)[place] < low[leaf], (x + slack)[place] > high[leaf]
                    upto = np.where(under, (x + slack)[place], -np.inf)
                    since = np.where(over, (x - slack)[place], np.inf)
                    inside = np.flatnonzero(~under & ~over)  # in its own strip, from the edge that is nearer
                    at, to = place[inside], leaf[inside]
                    left = x[at] - low[to] < high[to] - x[at]
                    upto[inside[left]], since[inside[~left]] = (x + slack)[at[left]], (x - slack)[at[~left]]
                    yield part.iloc[place].assign(leaf=leaf.astype(np.int32), near=r[place], upto=upto, since=since)

        return run

    def read_again(asks: DataFrame, by_class: bool) -> DataFrame:
        """Rows that asks of a strip may reach: p, t, leaf, x, y. Few asks reach far, so each cell of y has its own bounds."""
        own = ["p", "leaf", *["t"] * by_class]
        cells = max(1, min(256, CELLS // (16 * len(pairs) * strips * (len(counts) if by_class else 1))))
        cuts = {r["p"]: np.array(r["c"]) for r in asks.groupBy("p").agg(F.percentile_approx("y", [q / cells for q in range(cells)], 10_000).alias("c")).collect()}

        def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for p, part in pdf.groupby("p"):
                    y, r = part["y"].to_numpy(), part["near"].to_numpy()
                    slack = r + 1e-15 * (np.abs(y) + r)
                    a, b = np.searchsorted(cuts[p], y - slack, "right"), np.searchsorted(cuts[p], y + slack, "right") + 1
                    place = np.repeat(np.arange(len(y)), b - a)
                    cell = np.arange(len(place)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[place]
                    met = part[["upto", "since", *own]].iloc[place].assign(cell=cell.astype(np.int32)).groupby([*own, "cell"], as_index=False)
                    yield met.agg({"upto": "max", "since": "min"})

        zones = asks.mapInPandas(bounds, ", ".join(f"{c} int" for c in [*own, "cell"]) + ", upto double, since double")
        reach = {}
        for p, some in zones.groupBy(*own, "cell").agg(F.max("upto").alias("upto"), F.min("since").alias("since")).toPandas().groupby("p"):
            shape = (len(counts) if by_class else 1, len(edges[axis_of[p]][0]), cells + 1)
            upto, since = np.full(shape, -np.inf), np.full(shape, np.inf)
            at = (some["t"].to_numpy() if by_class else 0, some["leaf"].to_numpy(), some["cell"].to_numpy())
            upto[at], since[at] = some["upto"], some["since"]
            reach[p] = (upto, since, upto.max(2), since.min(2))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                t = pdf["t"].to_numpy()
                at = t if by_class else np.zeros(len(t), np.int64)
                for f in axes:
                    x = pdf[f"x{f}"].to_numpy()
                    leaf = np.searchsorted(edges[f][1], x)
                    for p, g in planes[f]:
                        if p in reach:
                            upto, since, most, least = reach[p]
                            here = np.flatnonzero((x <= most[at, leaf]) | (x >= least[at, leaf]))
                            y = pdf[f"x{g}"].to_numpy()[here]
                            cell = (at[here], leaf[here], np.searchsorted(cuts[p], y, "right"))
                            met = (x[here] <= upto[cell]) | (x[here] >= since[cell])
                            here, y = here[met], y[met]
                            if len(here):
                                yield pd.DataFrame({"p": np.int32(p), "t": t[here], "leaf": leaf[here].astype(np.int32), "x": x[here], "y": y})

        return points.mapInPandas(run, "p int, t int, leaf int, x double, y double")

    def bucketed(pdf: pd.DataFrame) -> Buckets:
        return Buckets(pdf["x"].to_numpy(), pdf["y"].to_numpy())

    def asked(asks: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if len(asks) and len(there):
            z, t = bucketed(asks), int(asks["t"].iloc[0])
            d = np.repeat(z.placed(asks["near"].to_numpy(), 0.0)[:, :, None], k, 2)  # its own are known: only what is nearer
            asks = asks.assign(**dict(zip(d_columns, z.back(_nearer(bucketed(there), z, d, needs[t])).T, strict=True)))
        else:
            asks = asks.iloc[:0]
        return asks[[*ask, *d_columns]]

    def counted(asks: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(len(asks), np.int64)
        if len(asks) and len(there):
            z = bucketed(asks)
            w = z.back(_within(bucketed(there), z, z.placed(asks["near"].to_numpy(), 0.0)))
        return asks[["p", "id", "near"]].assign(w=w)

    histogram = [union.where("t = 0 AND p >= 0").groupBy("p", F.col("x").cast("long").alias("w")).agg(F.sum("id").alias("n"))]
    tables = [points, *found.values()]
    if not asking.isEmpty():
        to = row + ", leaf int, near double, upto double, since double"
        asks = stored(asking.mapInPandas(sent("", False), to), "asks")
        more = asks.groupBy("p", "t", "leaf").cogroup(read_again(asks, True).groupBy("p", "t", "leaf")).applyInPandas(asked, row)
        least = F.array(*[F.lit(c) for c in needs])
        merged = asking.unionByName(more).groupBy(*ask).agg(F.sort_array(F.flatten(F.collect_list(F.array(*d_columns)))).alias("d"))
        near = stored(merged.select(*ask, F.element_at("d", F.get(least, F.col("t"))).alias("near")).mapInPandas(sent("near", True), "p int, t int, strip int, id long, x double, y double, near double, leaf int, upto double, since double"), "near")
        within = near.groupBy("p", "leaf").cogroup(read_again(near, False).groupBy("p", "leaf")).applyInPandas(counted, "p int, id long, near double, w long")
        total = within.groupBy("p", "id", "near").agg(F.sum("w").alias("w")).select("p", (F.col("w") - (F.col("near") > 0).cast("long")).alias("w"))
        tables += [asks, near]
        histogram.append(total.groupBy("p", "w").agg(F.count(F.lit(1)).alias("n")))
    held = pd.concat([h.toPandas() for h in histogram])
    for table in tables:
        drop_stored(table)
    of = np.array([float(c) for c in counts[1:]])
    fixed = digamma(np.array([float(n)]))[0] + float((of * (digamma(np.minimum(k, of - 1)) - digamma(of))).sum()) / n
    mi = {}
    for p, pair in enumerate(pairs):
        h = held[held["p"] == p]
        value = (fixed - float((h["n"] * digamma(h["w"].to_numpy() + 1.0)).sum()) / n) / np.log(base)
        mi[pair] = float(max(0.0, value) if clip else value)
    return spark.createDataFrame([(i, j, mi[i, i] + mi[j, j] - mi[i, j]) for i, j in pairs if i < j], "i int, j int, coi double")


def sign_distribution(edges: DataFrame, value: str = "coi", eps: float = 0.001) -> DataFrame:
    """One row with counts and shares by sign, and location and spread of the values."""
    v = F.col(value)
    q = lambda p: F.percentile(value, F.lit(p))
    n = F.count(value)
    return edges.agg(
        n.alias("n"),
        F.count_if(v > eps).alias("n_pos"),
        F.count_if(v < -eps).alias("n_neg"),
        F.count_if(F.abs(v) <= eps).alias("n_zero"),
        (F.count_if(v > eps) / n).alias("frac_pos"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
        q(0.5).alias("median"),
        (q(0.75) - q(0.25)).alias("iqr"),
        q(0.1).alias("p10"),
        q(0.9).alias("p90"),
        F.avg(F.abs(v)).alias("abs_mean"),
        (F.max(value) - F.min(value)).alias("ptp"),
    )


def keep_strongest(edges: DataFrame, share: float, value: str = "coi") -> DataFrame:
    """The top share of edges by absolute value."""
    cut = edges.agg(F.percentile(F.abs(F.col(value)), F.lit(1 - share)).alias("__cut"))
    return edges.crossJoin(F.broadcast(cut)).where(F.abs(F.col(value)) >= F.col("__cut")).drop("__cut")  # one row


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str = "coi") -> DataFrame:
    """One row: pearson of the values and of their absolutes, spearman, kendall, sign agreement, and flips
    among the edges with abs(a) above .001.
    """
    j = stored(a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys), "agreement")
    x, y = F.col("x"), F.col("y")
    one = j.agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("x", "y").alias("pearson"),
        F.corr(F.abs(x), F.abs(y)).alias("pearson_abs"),
        F.avg((F.signum(x) == F.signum(y)).cast("int")).alias("sign_agreement"),
        F.avg(F.when(F.abs(x) > 0.001, (F.signum(x) != F.signum(y)).cast("int"))).alias("sign_flip_rate"),
    )
    rho, tau = spearman(j, "x", "y", []).select(F.col("rho").alias("spearman")), kendall_tau(j, "x", "y").select(F.col("tau").alias("kendall"))
    return one.crossJoin(rho).crossJoin(tau)  # one row each


def reproducibility(runs: DataFrame, keys: list[str], run: str, value: str = "coi") -> DataFrame:
    """Keys, cv (deviation over mean, null for means near 0), same_sign: the share of runs with the first run's sign."""
    rows = runs.withColumn("__sign", F.signum(value))
    each = rows.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"), F.min_by("__sign", run).alias("first"), F.collect_list("__sign").alias("signs"))
    same = F.size(F.filter("signs", lambda s: s == F.col("first"))) / F.size("signs")
    return each.select(*keys, F.when(F.abs("m") > 1e-6, F.col("sd") / F.abs("m")).alias("cv"), same.alias("same_sign"))


def mixed_co_information(own: DataFrame, joint: DataFrame) -> DataFrame:
    """A10: i, j, coi = I_i + I_j - I_ij with single terms (i, mi) by one estimator and joint ones (i, j, mi) by another."""
    side = lambda c: own.select(F.col("i").alias(c), F.col("mi").alias(f"of_{c}"))
    return joint.where("i < j").join(F.broadcast(side("i")), "i").join(F.broadcast(side("j")), "j").select("i", "j", (F.col("of_i") + F.col("of_j") - F.col("mi")).alias("coi"))


def range_counts(points: DataFrame, key: str, coords: tuple[str, str], radius: str, cell: float) -> DataFrame:
    """Key, n: other points nearer than the point's own radius by the greater of both gaps.

    Points are dealt to squares of a side ``cell`` and each asks the squares that its radius meets; points with the same
    place are counted once and weigh as many. Cells and radii of like size keep a square's rows few.
    """
    x, y = coords
    square = lambda c, by=None: F.floor((F.col(c) + by if by is not None else F.col(c)) / cell)
    there = points.groupBy(F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("__n")).withColumns({"__i": square("__x"), "__j": square("__y")})
    r = F.col(radius)
    around = lambda c: F.sequence(square(c, -r), square(c, r))
    asks = points.select(key, x, y, r.alias("__r"), F.explode(around(x)).alias("__i")).withColumn("__j", F.explode(F.sequence(F.floor((F.col(y) - F.col("__r")) / cell), F.floor((F.col(y) + F.col("__r")) / cell))))
    near = (F.abs(F.col(x) - F.col("__x")) < F.col("__r")) & (F.abs(F.col(y) - F.col("__y")) < F.col("__r"))
    found = asks.join(there, ["__i", "__j"]).where(near).groupBy(key).agg(F.sum("__n").alias("__n"))
    return points.select(key, r.alias("__r")).join(found, key, "left").select(key, (F.coalesce("__n", F.lit(0)) - (F.col("__r") > 0).cast("long")).alias("n"))


