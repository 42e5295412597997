"""Writers: tables with contracts, ranked CSV, nested CSV, JSON lines, summaries."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatch.contracts import assert_unique, assert_vectors
from prismatch.functions.text import csv_safe
from prismatch.operators.crops import flat_columns


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, replace: bool = False,
                rows_per_file: int | None = None) -> None:
    """Parquet through Spark's commit protocol; a finished run is not overwritten unless asked."""
    w = df.write.mode("overwrite" if replace else "errorifexists")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_embeddings(df: DataFrame, path: str, dim: int, key: str = "render_id", vector: str = "emb") -> None:
    """Embeddings are checked (size, finite, not zero, unique ids) before they are written."""
    assert_vectors(df, vector, dim)
    assert_unique(df, [key], "embeddings")
    write_table(df, path)


def write_service_index(gallery: DataFrame, manifest: DataFrame, path: str, key: str = "render_id") -> DataFrame:
    """Index sorted by id with its entry ids; returns the one-row summary."""
    rows = gallery.join(manifest.select(key, F.lower("pdb_id").alias("pdb_id"), "object_id"), key)
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
    back = gallery.sparkSession.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("images"), F.count_distinct("pdb_id").alias("pdb_entries"),
                    F.count_distinct("object_id").alias("objects"), F.max(F.size("emb")).alias("dimensions"))


def flat_predictions(records: DataFrame) -> DataFrame:
    """One row per ranked hit of ``crop_id, pdb_ids, mapping_status, best_source_rank, top``."""
    return records.select(
        "crop_id", F.array_join("pdb_ids", ";").alias("source_ids"), "mapping_status", "best_source_rank", F.explode("top").alias("h")
    ).select("crop_id", "source_ids", "mapping_status", "best_source_rank", "h.rank", "h.pdb_id", "h.score", "h.best_image_cosine")


def write_csv(df: DataFrame, path: str, text_columns: list[str] | None = None) -> None:
    """CSV with a header; nested columns as JSON, listed text columns made safe for spreadsheets."""
    flat = flat_columns(df)
    for c in text_columns or []:
        flat = flat.withColumn(c, csv_safe(c))
    flat.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_approved(crops: DataFrame, path: str, approved_only: bool = True) -> None:
    (crops.where("review_status = 'approved'") if approved_only else crops).write.mode("errorifexists").json(path)


def write_json(path: str, value: object) -> None:
    """Small driver-side report: sorted keys, temporary file, then rename."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
    os.replace(tmp, path)
