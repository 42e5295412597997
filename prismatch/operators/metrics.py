"""Retrieval metrics, classification metrics and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.operators.ordering import int_quantiles

KS = (1, 5, 10, 20)
EXACT_DISTINCT = 100_000  # distinct ranks that one percentile buffer may hold


def rank_metrics(
    ranks: DataFrame,
    *,
    rank: str = "rank",
    ks: Sequence[int] = KS,
    median: str = "interpolated",
    group: Sequence[str] = (),
    digits: int | None = None,
    max_rank: int | None = None,
) -> DataFrame:
    """Recall@k, MRR, median and mean rank over rows; a null rank is a miss.

    Recall and MRR divide by all rows, median and mean use the ranked rows only.
    ``median="lower"`` takes the lower middle value, ``"interpolated"`` the
    mean of the two middle values. When ``max_rank`` bounds the ranks to few
    distinct values, one aggregate does it all; otherwise the median comes from
    a distributed histogram and ``ranks`` is read twice.
    """
    if median not in ("interpolated", "lower"):
        raise ValueError(f"unknown median {median!r}")
    r = F.col(rank)
    group = list(group)
    n = F.count(F.lit(1))

    def shown(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    small = max_rank is not None and max_rank <= EXACT_DISTINCT
    kind = "percentile" if median == "interpolated" else "percentile_disc"
    mid_value = F.expr(f"{kind}(0.5) within group (order by {rank})" if kind == "percentile_disc" else f"percentile({rank}, 0.5)")
    out = ranks.groupBy(*group).agg(
        n.alias("n"),
        F.count(r).alias("n_ranked"),
        *[F.count_if(r <= k).alias(f"hit_at_{k}") for k in ks],
        *[shown(F.try_divide(F.count_if(r <= k), n)).alias(f"r_at_{k}") for k in ks],
        shown(F.try_divide(F.coalesce(F.sum(1.0 / r), F.lit(0.0)), n)).alias("mrr"),
        shown(F.avg(r)).alias("mean_rank"),
        *([mid_value.cast("double").alias("median_rank")] if small else []),
    )
    if small:
        return out
    places = {"__lo": F.floor((F.col("n") - 1) / 2), "__hi": F.floor(F.col("n") / 2)}
    mid = int_quantiles(ranks, rank, places, group)
    value = F.col("__lo").cast("double") if median == "lower" else (F.col("__lo") + F.col("__hi")) / 2.0
    mid = mid.select(*group, value.alias("median_rank"))
    if group:
        return out.join(mid, group, "left")
    return out.join(F.broadcast(mid))  # one row with one row


def chance_rate(index_labels: DataFrame, query_labels: DataFrame, label: str) -> DataFrame:
    """Mean over queries of the share of index rows with the query's label (one row)."""
    sizes = index_labels.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    asked = query_labels.groupBy(label).agg(F.count(F.lit(1)).alias("q"))
    both = sizes.join(asked, label, "full_outer")
    c, q = F.coalesce("c", F.lit(0)), F.coalesce("q", F.lit(0))
    total = F.greatest(F.sum(c), F.lit(1))
    return both.agg((F.try_divide(F.sum((c * q).cast("double")) / total, F.sum(q))).alias("chance"))


def confusion_counts(df: DataFrame, truth: str, predicted: str, ignore: int = -100, group: Sequence[str] = ()) -> DataFrame:
    """Rows per (truth, predicted) pair, ignoring rows without a usable label."""
    kept = df.where(F.col(truth) != ignore)
    return kept.groupBy(*group, truth, predicted).agg(F.count(F.lit(1)).alias("c"))


def accuracy_macro_f1(df: DataFrame, truth: str, predicted: str, ignore: int = -100) -> DataFrame:
    """Accuracy and macro F1 over the union of true and predicted labels (0 where undefined)."""
    pairs = confusion_counts(df, truth, predicted, ignore)
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col(truth).alias("label"), F.col("c").alias("t"), F.lit(0).cast("bigint").alias("p")),
            F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("c").alias("p")),
        )).alias("s"),
        F.when(F.col(truth) == F.col(predicted), F.col("c")).otherwise(F.lit(0)).alias("hit"),
    ).select("s.label", "s.t", "s.p", "hit")
    # both halves of a matching pair carry the hit, hence the halving below
    per = sides.groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), (F.sum("hit") / 2).alias("tp"))
    f1 = F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)
    return per.agg(
        F.sum("t").alias("n"), F.count(F.lit(1)).alias("n_labels"),
        F.try_divide(F.sum("tp"), F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"),
    )


# The thresholds of the secondary-structure baseline.
GATE_ACCURACY = 0.542
GATE_MACRO_F1 = 0.225


def gate_verdict(accuracy: Column, macro_f1: Column) -> Column:
    a, f = accuracy > GATE_ACCURACY, macro_f1 > GATE_MACRO_F1
    return F.when(a & f, "CLEARS").when(a | f, "MIXED").otherwise("BELOW")


def select_rule(metrics: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Best rule by recall@1, then MRR, then the earlier rule."""
    order = F.array_position(F.array(*[F.lit(r) for r in rules]), F.col("rule"))
    return metrics.orderBy(F.col("r_at_1").desc(), F.col("mrr").desc(), order).limit(1)


def subset_memberships(rows: DataFrame) -> DataFrame:
    """One row per (crop, subset); subsets overlap.

    Needs ``best_source_rank, mapping_status, review_flags, pdb_ids, legacy_crop_id``.
    """
    covered = F.col("best_source_rank").isNotNull()
    mapped = covered & (F.col("mapping_status") != "panel_candidates") & ~F.array_contains("review_flags", "rna_only")
    legacy = F.col("legacy_crop_id").isNotNull() & (F.col("legacy_crop_id") != "")
    tests = {
        "confirmed_single_source_covered": mapped & (F.col("mapping_status") == "source_mapped") & (F.size("pdb_ids") == 1),
        "source_mapped_or_multiple_depicted_covered": mapped,
        "all_candidate_covered_exploratory": covered,
        "all_queries_candidate_hits_including_absent": F.lit(True),
        "new_crops_candidate_covered_exploratory": covered & ~legacy,
        "previous_crops_candidate_covered": covered & legacy,
    }
    names = F.array(*[F.when(cond, F.lit(name)) for name, cond in tests.items()])
    return rows.withColumn("subset", F.explode(F.filter(names, lambda x: x.isNotNull())))


def population_counts(rows: DataFrame) -> DataFrame:
    """Sizes of the query population (one row)."""
    present = F.col("best_source_rank").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_distinct("source_id").alias("n_source_figures"),
        F.count_if(present).alias("n_any_source_present"),
        F.count_if(~present).alias("n_no_source_present"),
        F.count_if(F.col("mapping_status") == "panel_candidates").alias("n_accession_unresolved"),
        F.count_if(F.array_contains("review_flags", "rna_only")).alias("n_rna_only_diagnostic"),
    )


def compare_rankings(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Agreement of two runs: ``best_source_rank`` and ``top`` (array of entry, score) per query."""
    a = old.select(key, F.col("best_source_rank").alias("a_rank"), F.col("top").alias("a_top"))
    b = new.select(key, F.col("best_source_rank").alias("b_rank"), F.col("top").alias("b_top"))
    names = lambda c: F.transform(c, lambda x: x["entry"])
    gaps = F.zip_with("a_top", "b_top", lambda x, y: F.abs(x["score"] - y["score"]))
    both = a.join(b, key)
    return both.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if(F.col("a_rank").eqNullSafe(F.col("b_rank"))).alias("matching_source_ranks"),
        F.count_if(names("a_top") == names("b_top")).alias("matching_top_lists"),
        F.max(F.array_max(gaps)).alias("max_score_error"),
    )
