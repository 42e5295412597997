"""The fixed split of documents into training and held-out ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column, divisor: int, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` (a null id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % divisor == remainder, F.lit(False))
