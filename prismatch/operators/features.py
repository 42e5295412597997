"""Feature blocks of secondary-structure summaries: numbers, lengths, character n-gram TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismatch.functions.text import char_ngrams
from prismatch.operators.graph import skew_safe_lookup
from prismatch.operators.ordering import with_position
from prismatch.session import stage

# Order of the numeric columns.
NUMERIC = (
    "n_res frac_H frac_E frac_C n_helix n_strand mean_helix_len mean_strand_len max_helix_len max_strand_len"
).split()
KINDS = ("length", "numeric", "ngram", "both")


def numeric_block() -> Column:
    """The ten summary numbers and four derived ones."""
    n = F.greatest(F.col("n_res").cast("double"), F.lit(1.0))
    derived = [
        100.0 * F.col("n_helix") / n, 100.0 * F.col("n_strand") / n,
        F.col("frac_H") / (F.col("frac_E") + 1e-3), F.log1p(F.col("n_res").cast("double")),
    ]
    return F.array(*[F.col(c).cast("double") for c in NUMERIC], *derived)


def length_block() -> Column:
    n = F.col("n_res").cast("double")
    return F.array(n, F.log1p(n))


def term_counts(df: DataFrame, key: str, text: str, lo: int = 1, hi: int = 5) -> DataFrame:
    """``key, term, tf`` of all character n-grams; texts are shuffled once by key, their n-grams are not."""
    df = df.select(key, text).repartition(F.col(key))
    # the outer form keeps the optimiser from building the array a second time for a size filter
    grams = df.select(key, F.explode_outer(char_ngrams(F.coalesce(F.col(text), F.lit("")), lo, hi)).alias("term"))
    return grams.where("term is not null").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(train: DataFrame, key: str, text: str, *, lo: int = 1, hi: int = 5, min_df: int = 2, max_features: int = 2000) -> DataFrame:
    """Vocabulary ``term, index, idf`` of the training rows.

    Terms in fewer than ``min_df`` rows are dropped; of the rest the most
    frequent ``max_features`` stay (ties by term), indexed in term order.
    """
    n = train.agg(F.count(F.lit(1)).alias("__n"))
    terms = term_counts(train, key, text, lo, hi).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = terms.where(F.col("df") >= min_df).orderBy(F.col("total").desc(), "term").limit(max_features)
    idf = F.log((F.lit(1.0) + F.col("__n")) / (F.lit(1.0) + F.col("df"))) + 1
    return with_position(kept, [F.col("term")], "index").join(F.broadcast(n)).select("term", "index", idf.alias("idf"))


def transform_tfidf(df: DataFrame, vocabulary: DataFrame, key: str, text: str, *, lo: int = 1, hi: int = 5) -> DataFrame:
    """Row-normalised weights in long form: ``key, index, term, weight`` (rows without known terms are absent)."""
    # the shuffle of the texts by key serves the counts and the norms
    raw = term_counts(df, key, text, lo, hi)
    raw = raw.join(F.broadcast(vocabulary), "term").withColumn("__w", F.col("tf") * F.col("idf"))  # at most max_features terms
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(key)))
    return raw.select(key, "index", "term", (F.col("__w") / norm).alias("weight"))


def dense(weights: DataFrame, key: str, width: int) -> DataFrame:
    """Long weights to one array of ``width`` values per key."""
    entries = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("index", "weight"))).alias("m"))
    return entries.select(key, F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("ngram"))


def build_features(df: DataFrame, train: Column, kind: str = "both", *, key: str = "domain_id", text: str = "element_string") -> DataFrame:
    """``key, features`` for every row; n-grams are fitted on the training rows."""
    if kind not in KINDS:
        raise ValueError(f"unknown feature kind {kind!r}")
    if kind == "length":
        return df.select(key, length_block().alias("features"))
    if kind == "numeric":
        return df.select(key, numeric_block().alias("features"))
    vocabulary = stage(fit_tfidf(df.where(train), key, text), "vocabulary")
    width = max(vocabulary.count(), 1)
    ngrams = dense(transform_tfidf(df, vocabulary, key, text), key, width)
    rows = skew_safe_lookup(df, ngrams, key, "left").withColumn("ngram", F.coalesce("ngram", F.array_repeat(F.lit(0.0), width)))
    parts = F.col("ngram") if kind == "ngram" else F.concat(numeric_block(), F.col("ngram"))
    return rows.select(key, parts.alias("features"))
