"""Documents to packed training sequences: five stages, each of which works on all that the one before kept.

Null texts count as empty in every stage and stay null in what it returns; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlake.llm.common import stored
from loomlake.llm.exact_dedup import DigestIndex, drop_exact_copies
from loomlake.llm.jaccard import one_of_each
from loomlake.llm.packing import pack_documents
from loomlake.llm.queries import table, tokenizer_file
from loomlake.llm.secrets import mask_secrets
from loomlake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go; the machine learns from these documents' labels.

    Without labels every score is 0.5, and all stay; a text without words has the score of the bias.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, of repeated rows one; null and empty texts are equal."""
    return drop_exact_copies(docs, DigestIndex(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarities of 0.8 or more the one with the smallest doc_id stays.

    Texts without words link with nothing and stay, as do rows without an id.
    """
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays, and n_chars follows a text that changed."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of up to 1024 tokens; an empty text is the end id alone."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]

#: The first stage learns a factorization machine, which SQL can't say; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
