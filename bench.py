"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once untimed (JIT, Python workers, file listing) and then
timed once in full through the noop sink. ``search_*`` time the search alone on
an index that is already built, as a service would run it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prismatch.operators import similarity as sim  # noqa: E402
from prismatch.plans import catalogue, views  # noqa: E402
from prismatch.session import build_session  # noqa: E402

HEADLINE = (
    "retrieval_top5 retrieval_max full_index_view0_query retrieval_topk_hits source_coverage retrieval_self_excluded_levels supcon_loss "
    "set_cover components greedy_pack stratified_pack dedup_first running_total round_robin_shards object_filter straddle_audit tvd_by_class "
    "duplicate_content_groups rle_segments ss_summary tfidf colour_histogram style_sampling admission"
).split()


def timed(df_of) -> float:
    t = time.perf_counter()
    df_of().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t, 3)


def replicate(m, copies: int):
    """``copies`` galleries of 256 dimensions from the table's vectors, each copy shifted and flipped in its own way."""
    rows = m.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    turned = lambda by: F.concat(F.slice("emb", by + 1, 64), F.slice("emb", F.lit(1), by))
    parts = [turned(F.pmod(F.col("c") * k + k, F.lit(64)).cast("int")) for k in (1, 5, 11, 23)]
    flipped = F.when(F.col("c") % 2 == 1, F.transform(parts[3], lambda x: -x)).otherwise(parts[3])
    return rows.select(
        (F.col("render_id") * copies + F.col("c")).alias("render_id"), F.concat_ws("-", F.col("entry").cast("string"), F.col("c").cast("string")).alias("entry"),
        "view", F.concat(*parts[:3], flipped).cast("array<float>").alias("emb"),
    )


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = build_session("bench", master=f"local[{cpus}]", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: (lambda q=catalogue.QUERIES[name]: q(spark, sf)) for name in HEADLINE}
    seconds, failed, large = {}, {}, {}
    warm = time.perf_counter()

    def measure(name, job) -> None:
        """One failure costs its own figure only."""
        try:
            timed(job)
            seconds[name] = timed(job)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{name}: {seconds.get(name, failed.get(name))}", file=sys.stderr, flush=True)

    for name, job in jobs.items():
        measure(name, job)

    m = views.manifest(spark, sf).cache()
    n, first = m.count(), m.where("view = 0")

    def searches() -> None:
        index, everything = sim.build_index(m.where("view > 0")), sim.build_index(m)
        measure("search_ranks_prebuilt", lambda: sim.entry_ranks(index, first, rule="top5", query_id="render_id"))
        measure("search_hits_prebuilt", lambda: sim.top_hits(index, first, k=20, rule="top5", query_id="render_id"))
        measure("search_all_pairs_max", lambda: sim.entry_ranks(everything, m, rule="max", query_id="render_id", exclude_self=True))

    def published_size() -> None:
        copies = int(os.environ.get("BENCH_COPIES", "420"))  # about the published gallery: 831,225 rows of 256 dimensions
        big = replicate(m, copies)
        t = time.perf_counter()
        index = sim.build_index(big.where("view > 0"))
        asked = big.where("view = 0").where(F.col("render_id") % copies < 4)
        large.update(rows=index.n_rows, dims=index.dim, blocks=index.n_blocks, build_sec=round(time.perf_counter() - t, 1), queries=asked.count())
        measure("search_ranks_large", lambda: sim.entry_ranks(index, asked, rule="top5", query_id="render_id"))
        spent = seconds["search_ranks_large"] * cpus
        large.update(queries_per_sec_per_core=round(large["queries"] / spent, 2), pair_dims_per_sec_per_core=round(index.n_rows * large["queries"] * index.dim / spent))

    for name, job in (("searches", searches), ("search_ranks_large", published_size)):
        try:
            job()
        except Exception as e:  # noqa: BLE001
            failed.setdefault(name, f"{type(e).__name__}: {str(e)[:200]}")
    total = sum(v for k, v in seconds.items() if k != "search_ranks_large")
    pairs = seconds.get("search_all_pairs_max")
    print(json.dumps({
        "metric": "headline_total", "value": round(total, 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus,
        "wall_sec": round(time.perf_counter() - warm, 1), "query_view_pairs_per_sec": pairs and round(n * n / pairs), "large_search": large, "failed": failed,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
