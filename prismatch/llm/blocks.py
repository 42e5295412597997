"""Blocks of about ``BLOCK_ROWS`` documents, the unit in which tables of words or phrases meet the texts they belong to.

Ids that follow each other share a block, so a scan in id order meets few blocks
at a time and can pre-aggregate; sparse ids are spread by their hash. Either way
a block's size does not depend on what the texts hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
#: order of a document without an id: behind all others
NO_ID = (1 << 63) - 1


def block_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    n = max(1, docs.count() // BLOCK_ROWS)
    run = F.coalesce(F.xxhash64(F.shiftright(F.col(doc_id).cast("bigint"), 10)), F.xxhash64(F.col(text)))
    run = F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text).cast("string"))).otherwise(run)
    return F.pmod(run, F.lit(n)).cast("bigint")


def order_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))
