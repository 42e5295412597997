"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: ColumnLike) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: ColumnLike, eps: float = 1e-12) -> Column:
    """Unit vector; a norm below ``eps`` is clamped, so a zero vector stays zero."""
    length = F.greatest(norm(a), F.lit(eps))
    return F.transform(_col(a), lambda x: x.cast("double") / length)


def cosine(a: ColumnLike, b: ColumnLike, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def all_finite(a: ColumnLike) -> Column:
    return ~F.exists(_col(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def sign_log(x: ColumnLike) -> Column:
    """sign(x) * log(1 + |x|)."""
    return F.signum(_col(x)) * F.log1p(F.abs(_col(x)))


def fit_standardiser(rows: DataFrame, vector: str) -> DataFrame:
    """One row with the per-dimension mean and population standard deviation as arrays."""
    flat = rows.select(F.posexplode(vector).alias("i", "v"))
    per = flat.groupBy("i").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    packed = per.agg(F.array_sort(F.collect_list(F.struct("i", "mu", "sd"))).alias("p"))  # one item per dimension
    return packed.select(F.col("p.mu").alias("mu"), F.col("p.sd").alias("sd"))


def standardise(rows: DataFrame, vector: str, fit: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(x - mu) / (sd + eps) with a fitted one-row table."""
    joined = rows.join(F.broadcast(fit))
    centred = F.zip_with(vector, "mu", lambda x, m: x.cast("double") - m)
    return joined.withColumn(vector, F.zip_with(centred, "sd", lambda x, s: x / (s + eps))).drop("mu", "sd")


def pixel_normalise(pixels: ColumnLike, mean: list[float], std: list[float]) -> Column:
    """(x / 255 - mean) / std for interleaved channel values."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    k = len(mean)
    return F.transform(_col(pixels), lambda x, i: (x / 255.0 - F.get(m, i % k)) / F.get(s, i % k))
