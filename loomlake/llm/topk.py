"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

The data are read where they lie, in blocks of bounded size, and are never shuffled. The queries are a stated set: they
come in blocks of bounded size too, each of which is sent to all tasks, so a task holds one block of either. In a block
there is a list for each dimension, sorted by the component. For a query the lists are read from their better end, a fifth
of them at a time; what was read gives each row a lower bound (unread components at the list's worst) and an upper bound
(unread components at the list's frontier). Reading stops when few rows can still reach the k-th best score, of the block's
lower bounds or of the blocks that the task read before; the scores of these rows are then resolved, and no other row can
qualify. What was read of a list at a depth depends on the query's sign alone, so the bounds of many queries are one matrix
product. Each task gives out its k best rows of each query, and they meet in a ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
BLOCK_ROWS = 4096
#: Queries that are sent to all tasks at once, and bytes of them.
QUERY_ROWS, QUERY_BYTES = 16_384, 1 << 25
#: Steps in which a list would be read to its end.
STEPS = 5
#: Queries whose bounds are computed at once.
BATCH = 256
#: Rows besides k that may be left when reading stops.
LEFT = 64


class Lists:
    """The sorted lists of a block. What has been read of a list are the rows whose rank in it lies below the depth."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        n = len(ids)
        self.ids, self.vectors, self.by_dim = ids, vectors, np.ascontiguousarray(vectors.T)
        order = np.argsort(self.by_dim, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.by_dim, order, 1)
        self.rank = np.empty(order.shape, np.int16 if n < 32_768 else np.int32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=self.rank.dtype)[None, :], 1)
        self.read: dict[int, tuple] = {}

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For lower and upper bounds: what a row has above what stands for unread components, and that itself.

        The first half of the dimensions is for the positive parts of queries, the second for the negative ones.
        """
        if depth not in self.read:
            n, v = len(self.ids), self.by_dim
            fall, rise = self.rank >= n - depth, self.rank < depth
            least, most = self.sorted[:, 0], self.sorted[:, -1]
            high, low = self.sorted[:, n - depth], self.sorted[:, depth - 1]
            above = lambda a, b: np.concatenate([np.where(fall, v - a[:, None], 0.0), np.where(rise, v - b[:, None], 0.0)])
            self.read[depth] = above(least, most), np.concatenate([least, most]), above(high, low), np.concatenate([high, low])
        return self.read[depth]

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its place, and ids and scores of its k best rows, ties to smaller ids.

        Rows whose id is the query's ``own`` take no part, nor do rows with scores below the query's ``known``. All
        numbers are integers below 2^53, so bounds are exact.
        """
        n = len(self.ids)
        step, depth, active = max(1, -(-n // STEPS)), 0, np.arange(len(queries))
        known = np.full(len(queries), -np.inf) if known is None else known
        signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        while len(active):
            depth = min(n, depth + step)
            of_lower, rest_lower, of_upper, rest_upper = self.bounds(depth)
            some = signed[active]
            out = self.ids[None, :] == own[active, None]
            upper = np.where(out, -np.inf, some @ of_upper + (some @ rest_upper)[:, None])
            least = known[active]
            if k < n:
                lower = np.where(out, -np.inf, some @ of_lower + (some @ rest_lower)[:, None])
                least = np.maximum(least, np.partition(lower, n - k, axis=1)[:, n - k])
            left = (upper >= least[:, None]) & ~out
            done = (left.sum(1) <= k + LEFT) | (depth == n)
            for i in np.flatnonzero(done):
                rows = np.flatnonzero(left[i])
                score = self.vectors[rows] @ queries[active[i]]
                best = np.lexsort((self.ids[rows], -score))[:k]
                yield int(active[i]), self.ids[rows][best], score[best]
            active = active[~done]


class Best:
    """The k best rows of each query of a block over all blocks of data that a task has read."""

    def __init__(self, own: np.ndarray, row: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.own, self.row, self.vectors, self.k = own, row, vectors, k
        self.known = np.full(len(own), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(own)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        lists = Lists(ids, vectors)
        for at in range(0, len(self.own), BATCH):
            part = slice(at, at + BATCH)
            for i, some, score in lists.top(self.vectors[part], self.own[part], self.k, self.known[part]):
                ids, scores = (np.concatenate(x) for x in zip(self.found[at + i], (some, score), strict=True))
                best = np.lexsort((ids, -scores))[: self.k]
                self.found[at + i] = ids[best], scores[best]
                if len(best) == self.k:
                    self.known[at + i] = scores[best[-1]]


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _sound(embedding: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, odd)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with is_query its k rows with the greatest inner product.

    Components are floor(1024 * x). Rows with the query's id take no part; ties go to the smaller id. Vectors that are
    null or hold null or non-finite components, and rows without an id, take no part. Vectors meet those of their own
    length only. Repeated query rows get a ranking each; a repeated id is a candidate as often as it has rows. With fewer
    than k candidates all are ranked; an empty table gives an empty result. Other columns are ignored.
    """
    key = F.col(f"`{id_col}`").cast("long")
    good = vectors.where(key.isNotNull() & _sound(F.col(f"`{vector_col}`")))
    rows = good.select(key.alias("id"), scaled(F.col(f"`{vector_col}`")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "vectors")
    n_queries, longest = rows.where("q").agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    at_once = max(1, min(query_rows, QUERY_BYTES // (8 * max(1, longest or 1))))
    blocks = -(-n_queries // at_once)
    asked = stored(rows.where("q").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))), "queries")
    schema = "query_id long, row long, vec_id long, score long"
    context, found = rows.sparkSession.sparkContext, None

    def matrix(v) -> np.ndarray:
        return np.array(v.to_pylist(), dtype=np.float64).reshape(len(v), -1)

    for block in range(blocks):
        queries = asked.where(F.col("block") == block).select("id", "row", "v").toArrow()
        sent = context.broadcast(queries)

        def search(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa
            import pyarrow.compute as pc

            by_dim, held = {}, {}
            size = pc.list_value_length(sent.value.column("v"))
            for d in pc.unique(size).to_pylist():
                some = sent.value.filter(pc.equal(size, d))
                by_dim[d] = Best(some.column("id").to_numpy(), some.column("row").to_numpy(), matrix(some.column("v")), k)
            for batch in batches:
                size = pc.list_value_length(batch.column("v"))
                for d in pc.unique(size).to_pylist():
                    if d in by_dim:
                        held.setdefault(d, []).append(pa.Table.from_batches([batch.filter(pc.equal(size, d))]))
                        if sum(t.num_rows for t in held[d]) >= block_rows:
                            some = pa.concat_tables(held.pop(d))
                            while some.num_rows >= block_rows:
                                part, some = some.slice(0, block_rows), some.slice(block_rows)
                                by_dim[d].add(part.column("id").to_numpy(), matrix(part.column("v")))
                            held[d] = [some]
            for d, tables in held.items():
                if (some := pa.concat_tables(tables)).num_rows:
                    by_dim[d].add(some.column("id").to_numpy(), matrix(some.column("v")))
            for best in by_dim.values():
                for at in range(0, len(best.own), 1024):
                    part = range(at, min(at + 1024, len(best.own)))
                    times = [len(best.found[i][0]) for i in part]
                    columns = [np.repeat(best.own[at : at + 1024], times), np.repeat(best.row[at : at + 1024], times)]
                    columns += [np.concatenate([best.found[i][c] for i in part]).astype(np.int64) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "row", "vec_id", "score"])

        part = stored(rows.select("id", "v").mapInArrow(search, schema), "found")
        sent.destroy()
        found = found.unionByName(part) if found is not None else part
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
