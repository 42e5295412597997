"""Data contracts: key uniqueness, completeness, join cardinality, vector sanity.

Checks are aggregates, so they cost one partial aggregation and return one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table broke a rule it promised to keep."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> None:
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ContractError(f"{label}: key {list(keys)} repeats, e.g. {bad[0].asDict()}")


def assert_contained(df: DataFrame, keys: Sequence[str], other: DataFrame, label: str = "table") -> None:
    """Every key of ``df`` occurs in ``other``."""
    bad = df.select(*keys).join(other.select(*keys), list(keys), "left_anti").limit(1).collect()
    if bad:
        raise ContractError(f"{label}: key without a partner, e.g. {bad[0].asDict()}")


def assert_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], label: str = "tables") -> None:
    assert_contained(a, keys, b, label)
    assert_contained(b, keys, a, label)


def assert_disjoint(a: DataFrame, b: DataFrame, keys: Sequence[str], label: str = "tables") -> None:
    bad = a.select(*keys).join(b.select(*keys), list(keys), "left_semi").limit(1).collect()
    if bad:
        raise ContractError(f"{label}: key on both sides, e.g. {bad[0].asDict()}")


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", cardinality: str = "m:1"
) -> DataFrame:
    """Join after proving the promised cardinality (``m:1``, ``1:m`` or ``1:1``)."""
    if cardinality not in ("m:1", "1:m", "1:1"):
        raise ValueError(f"unknown cardinality {cardinality!r}")
    if cardinality in ("m:1", "1:1"):
        assert_unique(right, on, "right side")
    if cardinality in ("1:m", "1:1"):
        assert_unique(left, on, "left side")
    return left.join(right, list(on), how)


def aligned(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` for exactly the ids asked for; missing or repeated ids are errors."""
    assert_unique(df, [key], "lookup")
    assert_contained(ids, [key], df, "ids")
    return ids.select(key).join(df, key)


def vector_violations(df: DataFrame, vector: str, dim: int | Column, zero: float = 1e-8) -> DataFrame:
    """One row of counts: rows, wrong size, non-finite values, zero norm."""
    v = F.col(vector)
    size = F.lit(dim) if isinstance(dim, int) else dim
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(v.isNull() | (F.size(v) != size)).alias("wrong_size"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("not_finite"),
        F.count_if(F.coalesce(norm <= zero, F.lit(False))).alias("zero_norm"),
    )


def assert_vectors(df: DataFrame, vector: str, dim: int) -> None:
    row = vector_violations(df, vector, dim).first()
    if row["wrong_size"] or row["not_finite"] or row["zero_norm"]:
        raise ContractError(f"vectors: {row.asDict()}")


def index_integrity(index: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """One row that compares an index with its manifest by id."""
    a = index.groupBy(key).agg(F.count(F.lit(1)).alias("n_index"))
    b = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("n_manifest"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.coalesce(F.sum("n_index"), F.lit(0)).alias("n_index"),
        F.coalesce(F.sum("n_manifest"), F.lit(0)).alias("n_manifest"),
        F.count_if(F.col("n_index") > 1).alias("repeated_in_index"),
        F.count_if(F.col("n_index").isNull()).alias("missing_in_index"),
        F.count_if(F.col("n_manifest").isNull()).alias("unknown_in_index"),
    )
