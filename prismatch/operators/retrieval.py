"""Protocols on top of the tile search: galleries, evaluation, coverage, level reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismatch.operators import similarity as sim
from prismatch.operators.graph import skew_safe_lookup
from prismatch.operators.metrics import EXACT_DISTINCT, KS, chance_rate, rank_metrics
from prismatch.operators.ordering import with_position
from prismatch.session import stage


@dataclass(frozen=True)
class Protocol:
    """Which views ask and which views answer."""

    name: str
    query_views: tuple[int, ...]
    gallery_views: tuple[int, ...]
    excluded_views: tuple[int, ...]  # of the query cohort, when the gallery is the whole index


# The two view protocols.
VIEW0_QUERY = Protocol("view0_query", (0,), tuple(range(1, 16)), (0,))
STYLE_MATCHED = Protocol("style_matched", (15,), tuple(range(1, 15)), (0, 15))
PROTOCOLS = {p.name: p for p in (VIEW0_QUERY, STYLE_MATCHED)}


def same_split(manifest: DataFrame, protocol: Protocol) -> tuple[DataFrame, DataFrame]:
    """Queries and gallery from the same rows, told apart by view."""
    view = F.col("view")
    return manifest.where(view.isin(*protocol.query_views)), manifest.where(view.isin(*protocol.gallery_views))


def full_minus_cohort(manifest: DataFrame, protocol: Protocol, cohort: Column) -> tuple[DataFrame, DataFrame]:
    """Queries from a cohort; the gallery is everything but the cohort's excluded views."""
    queries = manifest.where(cohort & F.col("view").isin(*protocol.query_views))
    held = F.coalesce(cohort & F.col("view").isin(*protocol.excluded_views), F.lit(False))
    return queries, manifest.where(~held)


def answerable(queries: DataFrame, gallery: DataFrame, entry: str = "entry") -> DataFrame:
    """Queries whose entry has at least one gallery image."""
    return queries.join(gallery.select(entry).distinct(), entry, "left_semi")


def evaluate(
    queries: DataFrame,
    gallery: DataFrame,
    *,
    rule: str = "max",
    ties: str = "alphabetical",
    median: str = "interpolated",
    ks: Sequence[int] = KS,
    digits: int | None = None,
    query_id: str = "render_id",
    index: sim.GalleryIndex | None = None,
) -> DataFrame:
    """One row of retrieval metrics; queries without a gallery entry are counted and dropped."""
    index = index or sim.build_index(gallery)
    ranks = sim.entry_ranks(index, queries, rule=rule, ties=ties, query_id=query_id, digits=digits)
    if index.n_entries > EXACT_DISTINCT:
        ranks = stage(ranks, "ranks")  # one row per query, read twice below
    out = rank_metrics(ranks, ks=ks, median=median, digits=digits, max_rank=index.n_entries)
    asked = queries.agg(F.count(F.lit(1)).alias("n_asked"))
    return out.join(F.broadcast(asked)).select(
        F.lit(rule).alias("rule"),
        F.col("n").alias("n_queries"),
        F.lit(index.n_rows).cast("bigint").alias("n_gallery_images"),
        F.lit(index.n_entries).cast("bigint").alias("n_gallery_entries"),
        (F.col("n_asked") - F.col("n")).alias("n_dropped"),
        *[f"r_at_{k}" for k in ks], "mrr", "median_rank", "mean_rank",
    )


def ranks_with_empty_entries(
    index: sim.GalleryIndex, queries: DataFrame, vocabulary: DataFrame, *, rule: str, query_id: str = "render_id",
    digits: int | None = None, entry: str = "entry",
) -> DataFrame:
    """Ranks over a vocabulary that also holds entries without gallery images.

    Such entries score minus infinity, so they take the last places in id order.
    """
    scored = sim.entry_ranks(index, queries, rule=rule, query_id=query_id, digits=digits, target=entry)
    present = index.blocks.select(F.explode("entries").alias(entry)).distinct()
    empty = vocabulary.select(entry).distinct().join(present, entry, "left_anti")
    last = with_position(empty, [F.col(entry)], "place", start=1)
    missing = queries.select(F.col(query_id).alias("query_id"), entry).join(last, entry).select(
        "query_id", entry, F.lit(float("-inf")).alias("score"), (F.col("place") + index.n_entries).alias("rank")
    )
    return scored.unionByName(missing)


def source_coverage(
    index: sim.GalleryIndex, crops: DataFrame, splits: DataFrame, *, rule: str = "top5", digits: int | None = None,
    crop_id: str = "crop_id", sources: str = "pdb_ids", vector: str = "emb",
) -> DataFrame:
    """One row per listed source of a crop: present or absent, rank, score and corpus split.

    Crops of equal vectors are one query to the search.
    """
    listed = crops.select(
        F.col(crop_id).alias("query_id"), F.col(vector).alias("emb"), F.explode(sources).alias("source")
    ).select("query_id", "emb", F.upper("source").alias("entry"))
    listed = stage(listed, "listed-sources")
    known = stage(listed.groupBy("emb").agg(F.min("query_id").alias("__asked")), "distinct-vectors")
    pairs = stage(listed.join(known, "emb").select("query_id", "__asked", "entry").distinct(), "listed-pairs")
    asked = pairs.groupBy("__asked").agg(F.collect_set("entry").alias("entry")).join(known, "__asked")  # a vector goes with all its sources
    found = sim.entry_ranks(index, asked, rule=rule, digits=digits, query_id="__asked").withColumnRenamed("query_id", "__asked")
    split = splits.select(F.upper("pdb_id").alias("entry"), "split")
    ranked = stage(pairs.join(found, ["__asked", "entry"], "left"), "listed-ranks")  # the look-up reads its rows more than once
    return (
        skew_safe_lookup(ranked, split, "entry", "left", n_left=ranked.count())
        .select(
            F.col("query_id").alias(crop_id), F.col("entry").alias("pdb_id"), F.col("rank").isNotNull().alias("present"),
            "rank", "score", F.coalesce("split", F.lit("absent")).alias("corpus_split"),
        )
    )


def best_source_rank(crops: DataFrame, coverage: DataFrame, crop_id: str = "crop_id") -> DataFrame:
    best = coverage.groupBy(crop_id).agg(F.min("rank").alias("best_source_rank"))
    return crops.join(best, crop_id, "left")


def prediction_records(hits: DataFrame, manifest: DataFrame, splits: DataFrame, crop_id: str = "crop_id") -> DataFrame:
    """Per query, the ranked hits as an array of structs (at most k per query)."""
    meta = manifest.select(F.col("render_id").alias("best_image"), "object_id", "view", "shard", "member")
    split = splits.select(F.upper("pdb_id").alias("entry"), F.col("split").alias("corpus_split"))
    rich = hits.join(meta, "best_image", "left").join(split, "entry", "left")
    item = F.struct(
        "rank", F.col("entry").alias("pdb_id"), "score", F.col("best_cosine").alias("best_image_cosine"),
        F.col("best_image").alias("render_id"), "object_id", "view", "shard", "member",
        F.coalesce("corpus_split", F.lit("unknown")).alias("corpus_split"),
    )
    return rich.groupBy(F.col("query_id").alias(crop_id)).agg(F.array_sort(F.collect_list(item)).alias("top"))


def ranked_list_violations(hits: DataFrame, k: int) -> DataFrame:
    """One row of counts of broken ranked lists: wrong length, repeats, gaps, wrong order."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("entry").asc())
    again = hits.withColumn("__r", F.row_number().over(w))
    per = again.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entry").alias("d"), F.min("rank").alias("lo"),
        F.max("rank").alias("hi"), F.count_if(F.col("__r") != F.col("rank")).alias("moved"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("n") != k).alias("wrong_length"),
        F.count_if(F.col("d") != F.col("n")).alias("repeated_entry"),
        F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n"))).alias("rank_gap"),
        F.count_if(F.col("moved") > 0).alias("wrong_order"),
    )


def level_report(
    hits: DataFrame, queries: DataFrame, index_rows: DataFrame, levels: Sequence[str], *, ks: Sequence[int] = (1, 5, 10),
    self_in_index: bool = True, id_column: str = "render_id",
) -> DataFrame:
    """Label-level retrieval report, one row per level.

    ``hits`` are image-level neighbours (``query_id, rank, entry``) with the
    query's own image left out. Recall is given over all queries and over those
    that have any other index row with the same label.
    """
    q = queries.select(F.col(id_column).alias("query_id"), *[F.col(c).alias("q_" + c) for c in levels])
    i = index_rows.select(F.col(id_column).alias("entry"), *[F.col(c).alias("i_" + c) for c in levels])
    hits = stage(hits.select("query_id", "rank", "entry"), "hits")
    # an image that is everybody's neighbour is a hot key here
    joined = skew_safe_lookup(hits, i, "entry").join(q, "query_id")
    first = joined.groupBy("query_id").agg(
        *[F.min(F.when(F.col("q_" + c) == F.col("i_" + c), F.col("rank"))).alias("f_" + c) for c in levels]
    )
    per_query = stage(q.join(first, "query_id", "left"), "first-hits")  # read once per level
    kmax = max(ks)
    parts = []
    for c in levels:
        sizes = index_rows.groupBy(F.col(c).alias("q_" + c)).agg(F.count(F.lit(1)).alias("same"))
        own = 1 if self_in_index else 0
        rows = per_query.join(sizes, "q_" + c, "left").select(
            (F.coalesce("same", F.lit(0)) - own > 0).alias("ok"), F.when(F.col("f_" + c) <= kmax, F.col("f_" + c)).alias("f")
        )
        n = F.count(F.lit(1))
        agg = rows.agg(
            n.alias("n_query"), F.count_if("ok").alias("answerable"),
            *[F.round(F.count_if(F.col("f") <= k) / n, 4).alias(f"recall_{k}") for k in ks],
            *[F.round(F.count_if((F.col("f") <= k) & F.col("ok")) / F.nullif(F.count_if("ok"), F.lit(0)), 4).alias(f"recall_{k}_answerable") for k in ks],
            F.round(F.coalesce(F.sum(1.0 / F.col("f")), F.lit(0.0)) / n, 4).alias("mrr"),
        )
        chance = chance_rate(index_rows, queries, c).select(F.round("chance", 5).alias("chance_at_1"))
        parts.append(agg.join(F.broadcast(chance)).withColumn("level", F.lit(c)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
