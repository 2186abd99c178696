"""The queries opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread
from .exact_dedup import DigestIndex, exact_dedup
from .html_text import extract_text
from .jaccard import jaccard_join
from .language import identify_language
from .licenses import scan_licenses
from .packing import pack_documents
from .pieces import decode_documents, encode_documents, pieces_digest
from .secrets import scan_secrets
from .sql import ORACLES
from .topk import top_k
from .toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer file is; the same on the driver and on executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), DigestIndex(spark))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    return pieces_digest(decode_documents(encode_documents(table(spark, sf_dir, "documents"), model), model))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep_ids=False)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_top_k": op4_top_k,
        "op5_toxicity": op5_toxicity,
        "op6_secret_scan": op6_secret_scan,
        "op7_packing": op7_packing,
        "op8_html_text": op8_html_text,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_language": op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
