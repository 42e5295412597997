"""Sums that do not depend on the order of their terms, and recomputations that rest on them.

A double is a whole number times a power of two. Terms are added as whole numbers
within their *band* (the power of two nearest below), which loses nothing; the few
bands of a group are put together in exact arithmetic and rounded once. Partial
sums merge in any order, so equal tables give equal bits under every partitioning.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismatch.session import stage

BITS = 53
SIDE = 8192  # queries and images, on average, that meet in one task
TILE = 2_000_000  # cosines held at once by a task


def _whole(x: Column) -> tuple[Column, Column]:
    """(band, whole number) with ``x = whole * 2^(band - 53)``."""
    band = F.floor(F.log2(F.abs(x))).cast("int")
    scale = F.lit(BITS) - band
    first = F.least(scale, F.lit(1000))  # a power of two beyond the doubles is taken in two steps
    two = F.lit(2.0)
    return band, (x * F.pow(two, first) * F.pow(two, scale - first)).cast("decimal(20,0)")


@F.arrow_udf(T.DoubleType())
def _rounded(bands: pa.Array) -> pa.Array:
    out = []
    for row in bands.to_pylist():
        total = sum((Fraction(int(b["whole"])) * Fraction(2) ** (b["band"] - BITS) for b in row or () if b["band"] is not None), Fraction(0))
        out.append(float(total))
    return pa.array(out, pa.float64())


def exact_sum(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys, name``: the correctly rounded sum of a double column per group (nulls and zeros add nothing).

    A group with infinite or undefined terms gives what plain addition gives. Two
    map-side combining aggregations; a group sends one row per band, of which
    there are at most 2,100.
    """
    x = F.col(value).cast("double")
    wild = F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.when(~wild & (x != 0), x)
    band, whole = _whole(usable)
    rows = df.select(*keys, band.alias("band"), whole.alias("whole"), F.when(wild, x).alias("wild"))
    bands = rows.groupBy(*keys, "band").agg(F.sum("whole").alias("whole"), F.sum("wild").alias("wild"))
    groups = bands.groupBy(*keys).agg(F.collect_list(F.struct("band", "whole")).alias("bands"), F.sum("wild").alias("wild"))
    return groups.select(*keys, F.coalesce("wild", _rounded("bands")).alias(name))


def exact_dot(pairs: DataFrame, keys: list[str], left: str, right: str, name: str) -> DataFrame:
    """``keys, name``: inner products of two float arrays per row; products of floats are exact in a double."""
    terms = F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))
    each = pairs.select(*keys, F.explode(terms).alias("t")).select(*keys, (F.col("t.l").cast("double") * F.col("t.r").cast("double")).alias("term"))
    return exact_sum(each, keys, "term", name)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    if column.null_count or (len(column) and set(pc.list_value_length(column).to_pylist()) != {out.shape[1]}):
        raise ValueError("expected vectors of one length without nulls")
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    terms = a * b  # products of floats are exact in a double
    return math.fsum(terms.tolist()) if np.isfinite(terms).all() else float(terms.sum())


def _best_cosines(k: int):
    eps = 1e-12

    def best(asked: pa.Table, images: pa.Table) -> pa.Table:
        """The ``k`` best exact cosines of every query with these images; a plain product only tells which ones cannot be among them."""
        ids, rows, values = asked["query_id"].combine_chunks(), [np.zeros(0, np.int64)], [np.zeros(0)]
        if asked.num_rows and images.num_rows:
            q, g = _rows(asked["q"]), _rows(images["g"])
            same, of = np.unique(g, axis=0, return_inverse=True)  # of equal images the first k are enough
            order = np.argsort(of.ravel(), kind="stable")
            nth = np.arange(len(g)) - np.searchsorted(of.ravel()[order], of.ravel()[order])
            g, of = same, np.minimum(np.bincount(of.ravel()[order[nth < k]]), k)
            qs, gs = (np.maximum(np.sqrt([_dot(v, v) for v in m]), eps) for m in (q, g))
            step = max(1, TILE // len(g))
            for lo in range(0, len(q), step):
                near = (q[lo : lo + step] @ g.T) / (qs[lo : lo + step, None] * gs)
                near[np.isnan(near)] = np.inf
                m = min(k, len(g))
                floor = np.partition(near, len(g) - m, axis=1)[:, len(g) - m]
                for r, c in zip(*np.nonzero(near >= (floor - 1e-9)[:, None]), strict=True):
                    cosine = _dot(q[lo + r], g[c]) / (qs[lo + r] * gs[c])
                    rows.append(np.full(of[c], lo + r))
                    values.append(np.full(of[c], cosine))
        row, value = np.concatenate(rows), np.concatenate(values)
        order = np.lexsort((-value, ~np.isnan(value), row))
        row, value = row[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        entry = asked["entry"][0] if asked.num_rows else None
        return pa.table({"query_id": ids.take(pa.array(row[keep])), "entry": pa.array([entry.as_py()] * int(keep.sum()) if entry else [], asked["entry"].type), "cosine": pa.array(value[keep])})

    return best


def recomputed_scores(hits: DataFrame, queries: DataFrame, gallery: DataFrame, *, k: int, query_id: str = "render_id", entry: str = "entry",
                      image: str = "render_id", vector: str = "emb") -> DataFrame:
    """``query_id, entry, recomputed``: pooled cosines of stored hits from the vectors alone.

    Nothing of the search is used: an entry's images meet the queries that list it
    in squares of at most ``SIDE`` by ``SIDE`` rows, and every sum is exact. A pair
    of vectors leaves no row behind, only the ``k`` best of a query's row of a square.
    """
    wanted = hits.select("query_id", "entry").distinct()
    images = gallery.select(F.col(entry).alias("entry"), F.col(image).alias("image"), F.col(vector).alias("g"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("q"))
    sides = wanted.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("down"))
    sides = stage(sides.join(images.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("across")), "entry"), "squares")

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        """A row's part of its own side, once for every part of the other one."""
        part = F.pmod(F.xxhash64(by), F.col(own)).alias(f"{own}_at")
        return df.join(sides, "entry").select(*df.columns, part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"{other}_at"))

    left = dealt(wanted.join(asked, "query_id"), "query_id", "down", "across")
    right = dealt(images, "image", "across", "down").drop("image")
    shape = T.StructType([*wanted.schema.fields, T.StructField("cosine", T.DoubleType())])
    square = ["entry", "down_at", "across_at"]
    found = left.groupBy(*square).cogroup(right.groupBy(*square)).applyInArrow(_best_cosines(k), shape)
    best = Window.partitionBy("query_id", "entry").orderBy(F.col("cosine").desc())
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    count = top.groupBy("query_id", "entry").agg(F.count(F.lit(1)).alias("n"))
    total = exact_sum(top, ["query_id", "entry"], "cosine", "total")
    return total.join(count, ["query_id", "entry"]).select("query_id", "entry", (F.col("total") / F.col("n")).alias("recomputed"))


def recomputed_metrics(rows: DataFrame, keys: list[str], rank: str, ks: tuple[int, ...]) -> DataFrame:
    """``keys, n, hit_at_k..., r_at_k..., mrr`` from ranks alone (null: absent); counts and one exact sum."""
    hit = [F.count_if(F.col(rank) <= k).alias(f"hit_at_{k}") for k in ks]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *hit)
    total = exact_sum(rows.withColumn("inverse", F.lit(1.0) / F.col(rank)), keys, "inverse", "total")
    share = [(F.col(f"hit_at_{k}") / F.col("n")).alias(f"r_at_{k}") for k in ks]
    return counts.join(total, keys).select(*keys, "n", *[f"hit_at_{k}" for k in ks], *share, (F.col("total") / F.col("n")).alias("mrr"))


def disagreements(stored: DataFrame, again: DataFrame, keys: list[str], columns: list[str], within: float) -> DataFrame:
    """Rows that one side lacks, or whose values differ by more than ``within``: ``keys, column, stored, recomputed``."""
    a = stored.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns], F.lit(1).alias("a_has"))
    b = again.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns], F.lit(1).alias("b_has"))
    both = a.join(b, keys, "full_outer")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("stored"), F.col(f"b_{c}").alias("recomputed")) for c in columns])
    rows = both.select(*keys, (F.col("a_has").isNull() | F.col("b_has").isNull()).alias("alone"), F.explode(each).alias("x")).select(*keys, "alone", "x.*")
    near = F.col("stored").eqNullSafe(F.col("recomputed")) | F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= within, F.lit(False))
    return rows.where(F.col("alone") | ~near).drop("alone")
