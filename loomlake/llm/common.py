"""What the operators share: tables in the cluster's shared folder, key columns, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.shared import BROADCAST_ROWS, drop_stored, new_path, shared_dir, small_or_merge, spread, stored

__all__ = ["BROADCAST_ROWS", "crc_mod", "drop_stored", "new_path", "shared_dir", "small_or_merge", "spread", "stored", "whole"]


def whole(text: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(text, F.lit(""))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n).cast("int")
