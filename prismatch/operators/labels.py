"""Label maps, class weights, train/validation/test frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatch.contracts import checked_join
from prismatch.operators.graph import skew_safe_lookup
from prismatch.operators.ordering import with_position

UNSEEN = -100  # fixed value: label of a category the training rows do not have


def label_map(train: DataFrame, label: str) -> DataFrame:
    """``label, index`` in label order, fitted on the training rows only."""
    distinct = train.select(F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull()).distinct()
    return with_position(distinct, [F.col(label)], "index")


def encode_labels(rows: DataFrame, mapping: DataFrame, label: str, out: str = "y") -> DataFrame:
    m = mapping.select(F.col(label).alias("__l"), F.col("index").alias("__y"))
    coded = skew_safe_lookup(rows.withColumn("__l", F.col(label).cast("string")), m, "__l", "left")
    return coded.withColumn(out, F.coalesce("__y", F.lit(UNSEEN))).drop("__l", "__y")


def class_counts(rows: DataFrame, mapping: DataFrame, label: str) -> DataFrame:
    """``label, index, count`` for every mapped class, zero included."""
    n = rows.groupBy(F.col(label).cast("string").alias(label)).agg(F.count(F.lit(1)).alias("count"))
    return mapping.join(n, label, "left").select(label, "index", F.coalesce("count", F.lit(0)).alias("count"))


def balanced_weights(counts: DataFrame) -> DataFrame:
    """Weight N / (C * count) per class; 1 for an empty class."""
    total = counts.agg(F.sum("count").alias("__n"), F.count(F.lit(1)).alias("__c"))
    w = F.when(F.col("count") > 0, F.col("__n") / (F.col("__c") * F.col("count"))).otherwise(F.lit(1.0))
    return counts.join(F.broadcast(total)).withColumn("weight", w).drop("__n", "__c")


def frames(renders: DataFrame, labels: DataFrame, splits: DataFrame, split: str, *, key: str = "domain_id",
           eval_view: int = 0) -> dict[str, DataFrame]:
    """Train rows of every view; validation and test rows of the evaluation view only."""
    joined = checked_join(checked_join(renders, labels, [key]), splits.select(key, split), [key])
    s, first = F.col(split), F.col("view") == eval_view
    return {"train": joined.where(s == "train"), "val": joined.where((s == "val") & first), "test": joined.where((s == "test") & first)}
