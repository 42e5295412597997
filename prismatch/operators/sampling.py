"""Validation panel and entry-by-view training batches, reproducible from a seed."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatch.operators.ordering import with_position
from prismatch.session import stage


def panel_entries(manifest: DataFrame, split: str = "val", entry: str = "entry") -> DataFrame:
    """Entries of a split that have view 0 and some other view."""
    rows = manifest.where(F.col("split") == split)
    return rows.where("view = 0").select(entry).intersect(rows.where("view > 0").select(entry))


def validation_panel(manifest: DataFrame, count: int, seed: int, *, entry: str = "entry", split: str = "val") -> DataFrame:
    """All views of ``count`` seeded entries; the choice does not depend on row order.

    Only places in the sorted entry list are drawn on the driver, never the list.
    """
    placed = stage(with_position(panel_entries(manifest, split, entry), [F.col(entry)], "__i"), "panel")
    total = placed.count()
    if not total:
        raise ValueError(f"no {split} entries with separate query and gallery views")
    chosen = np.random.default_rng(seed).choice(total, min(count, total), replace=False)
    picks = manifest.sparkSession.createDataFrame([(int(i),) for i in chosen], "__i bigint")
    keep = placed.join(F.broadcast(picks), "__i", "left_semi").select(entry)  # ``count`` rows
    return manifest.where(F.col("split") == split).join(keep, entry, "left_semi")


def panel_digest(panel: DataFrame, key: str = "render_id") -> str:
    """SHA-256 of the sorted ids joined by newlines.

    For a panel, whose size its ``count`` fixes: the ids are brought to the driver
    in key order, a partition at a time.
    """
    digest, first = hashlib.sha256(), True
    for row in panel.select(F.col(key).cast("string").alias("k")).orderBy("k").toLocalIterator():
        digest.update((row["k"] if first else "\n" + row["k"]).encode())
        first = False
    return digest.hexdigest()


def pk_batches(rows: DataFrame, *, p: int, k: int, steps: int, seed: int, first_step: int = 0, entry: str = "entry",
               key: str = "render_id") -> DataFrame:
    """Training batches ``step, label, entry, key``: ``p`` different entries a step, ``k`` views of each.

    Views repeat only where an entry has fewer than ``k``. Every step, and every
    place in it, has a random stream of its own, so steps are drawn in parallel
    and a run that resumes at ``first_step`` sees the same batches.
    """
    spark = rows.sparkSession
    placed = stage(with_position(rows.select(entry, key), [F.col(entry), F.col(key)], "__p"), "batch-rows")
    groups = placed.groupBy(entry).agg(F.count(F.lit(1)).alias("__n"), F.min("__p").alias("__first"))
    groups = stage(with_position(groups, [F.col(entry)], "__e"), "batch-entries")
    total = groups.count()

    def entries(batches):
        for pdf in batches:
            for step in pdf["id"]:
                picks = np.random.default_rng([seed, int(step)]).choice(total, size=p, replace=False)
                yield _frame(step=np.full(p, step), label=np.arange(p), __e=picks)

    picked = spark.range(first_step, steps).mapInPandas(entries, "step bigint, label bigint, __e bigint").join(groups.select("__e", "__n"), "__e")

    def views(batches):
        for pdf in batches:
            for step, label, e, n in zip(pdf["step"], pdf["label"], pdf["__e"], pdf["__n"]):
                rng = np.random.default_rng([seed, int(step), int(label)])
                v = rng.choice(n, size=min(k, n), replace=n < k)
                yield _frame(step=np.full(len(v), step), label=np.full(len(v), label), __e=np.full(len(v), e), __v=v)

    drawn = picked.mapInPandas(views, "step bigint, label bigint, __e bigint, __v bigint")
    at = drawn.join(groups.select("__e", "__first"), "__e").withColumn("__p", F.col("__first") + F.col("__v"))
    return at.join(placed, "__p").select("step", "label", entry, key)


def _frame(**columns):
    return pd.DataFrame({k: np.asarray(v, dtype=np.int64) for k, v in columns.items()})

