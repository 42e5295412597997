"""Figure crops: flags, boxes, review state, duplicates, flat export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismatch.functions.text import split_ids
from prismatch.operators.graph import skew_safe_lookup
from prismatch.session import stage

# Allowed states.
REVIEW_STATES = ("pending", "approved", "excluded")
MAPPING_STATES = ("panel_candidates", "source_mapped", "multiple_depicted")
REPRESENTATIONS = ("surface", "density", "backbone", "overlay", "rna_only", "local_detail")


def duplicate_groups(df: DataFrame, content: str, key: str) -> DataFrame:
    """Groups of rows with equal content: ``sha256, n, first_id`` (members: :func:`duplicate_links`)."""
    hashed = df.select(F.sha2(F.col(content), 256).alias("sha256"), key)
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def duplicate_links(df: DataFrame, content: str, key: str) -> DataFrame:
    """``key, first_id, n`` for every row whose content occurs more than once.

    The content is hashed before anything is shuffled, and a group is never
    gathered: its size does not matter.
    """
    hashed = stage(df.select(F.sha2(F.col(content), 256).alias("sha256"), key), "hashes")
    groups = hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")
    return skew_safe_lookup(hashed, groups, "sha256").select(key, "first_id", "n")


def review_flags(given: Column, *, missing_coordinates: Column, pdb_status: Column, structure_type: Column, duplicate: Column,
                 several_ids: Column) -> Column:
    """Sorted distinct flags: the given ones plus those that follow from the source row."""
    derived = F.array(
        F.when(missing_coordinates, F.lit("coordinates_unavailable")),
        F.when(pdb_status != "verified", F.concat(F.lit("source_mapping_"), pdb_status)),
        F.when(structure_type != "experimental", F.concat(F.lit("structure_"), structure_type)),
        F.when(duplicate, F.lit("duplicate_source_image")),
        F.when(several_ids, F.lit("panel_pdb_assignment_needed")),
    )
    all_flags = F.concat(F.coalesce(given, F.array().cast("array<string>")), derived)
    return F.array_sort(F.array_distinct(F.filter(all_flags, lambda x: x.isNotNull())))


def crop_records(rows: DataFrame) -> DataFrame:
    """Derived columns of new crops from ``given_flags, pdb_text, pdb_status, structure_type, duplicate, missing``."""
    ids = split_ids("pdb_text")
    out = rows.withColumn("pdb_ids", ids).withColumn("review_flags", review_flags(
        F.col("given_flags"), missing_coordinates=F.col("missing"), pdb_status=F.col("pdb_status"),
        structure_type=F.col("structure_type"), duplicate=F.col("duplicate"), several_ids=F.size(ids) > 1))
    kind = F.filter("review_flags", lambda f: f.isin(*REPRESENTATIONS))
    return out.select(
        "*", F.when(F.array_contains("review_flags", "rna_only"), "excluded").otherwise("pending").alias("review_status"),
        F.lit("panel_candidates").alias("mapping_status"),
        F.when(F.size(kind) > 0, F.element_at(kind, 1)).otherwise("cartoon").alias("representation"),
        F.lit(False).alias("clean_query_eligible"))


def invalid_reviews(rows: DataFrame) -> DataFrame:
    """Rows whose review state, mapping state or ids are not allowed."""
    bad_id = F.exists("pdb_ids", lambda x: ~x.rlike("^[0-9][A-Z0-9]{3}$"))
    return rows.where(~F.col("review_status").isin(*REVIEW_STATES) | ~F.col("mapping_status").isin(*MAPPING_STATES) | bad_id)


def flat_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nested columns as JSON text, ready for CSV; columns not listed are left out."""
    columns = columns or df.columns
    nested = (T.ArrayType, T.MapType, T.StructType)

    def flat(c: str) -> Column:
        return F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c)

    return df.select(*[flat(c) for c in columns if c in df.columns])
