"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row for each digest, the digests
that the index lacks are found by a sort-merge anti-join on the bucketing, and those are appended. Text is read once;
everything after works on (doc_id, digest) rows of about 45 bytes. The only join that may meet a hot digest is the last,
documents to groups, an inner sort-merge join whose large partitions AQE splits; all aggregates combine before the shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_or_merge, stored, whole


class DigestIndex:
    """Digests seen so far, with the id of the row that stands for each.

    ``path`` is where the table lives; an existing one is opened again, by any later session. ``buckets`` is fixed for
    the life of an index: pick about one bucket for each 100 MB of index expected (2 M digests).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16) -> None:
        self.spark, self.buckets, self.path = spark, buckets, path or new_path(spark, "digests")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the digests of groups that the index lacks. A batch that was appended before adds nothing."""
        fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        rows = fresh.select("digest", "keep_id", "keep_row", F.lit(batch).alias("batch"))
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal texts in a batch the row with the largest
    id stays (null ids come last; of repeated rows exactly one stays). A text that an earlier batch brought is dropped
    and keep_id is the earlier row. group_size counts the rows of this batch with the text. Other columns are ignored.
    An empty table gives an empty result.
    """
    batch = batch or uuid.uuid4().hex
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.unhex(F.sha2(whole(F.col(f"`{text_col}`")), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = stored(rows, "keys")  # row numbers are fixed from here on
    groups = (
        keys.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size")
    )
    index.append(groups, batch)
    known = index.read().select("digest", "keep_id", "keep_row", (F.col("batch") == batch).alias("fresh"))
    state = groups.select("digest", "group_size").join(known.hint("merge"), "digest")
    return keys.join(state.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("fresh") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns as they were.

    Rows to drop are few against the rows that stay, so when counted and small enough they are broadcast and texts are
    not shuffled; otherwise an anti-join merges both sides. Repeated rows (same id and text) are folded to one.
    """
    columns = docs.columns
    found = stored(exact_dedup(docs, index, id_col, text_col), "dedup")
    gone = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    drop = stored(gone.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")), "drop")
    twice = stored(gone.where("kept and n > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")), "twice")
    keyed = docs.withColumn("__doc", F.col(f"`{id_col}`").cast("long")).withColumn("__text", F.sha2(whole(F.col(f"`{text_col}`")), 256))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha"))
    n_drop, n_twice = drop.count(), twice.count()
    kept = keyed.join(small_or_merge(drop, n_drop), same, "left_anti") if n_drop else keyed
    if n_twice:
        again = small_or_merge(twice, n_twice)
        folded = kept.join(again, same, "left_semi").dropDuplicates(["__doc", "__text"])
        kept = kept.join(again, same, "left_anti").unionByName(folded)
    return kept.select(*[F.col(f"`{c}`") for c in columns])
