"""Connected components of a bipartite entry/cluster graph.

Members of a cluster are linked to its smallest entry (a star, found by a
partial ``min``), never to each other. The stars are then contracted by
alternating large-star and small-star steps, each a grouped ``min`` and a
lookup join. The lookup splits off keys that hold more than 1/10,000 of the
rows, so at most 10,000 of them exist and their side can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prismatch.operators.ordering import with_position
from prismatch.session import stage

MAX_HOT_KEYS = 10_000
SMALL_ROWS = 1_000_000


def skew_safe_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", n_left: int | None = None,
                     small_rows: int = SMALL_ROWS) -> DataFrame:
    """Join with a right side that is unique on ``key`` although few keys may hold most left rows.

    Rows without a key match nothing and are not shuffled.
    """
    if how == "left":
        bare = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key]
        order = [key, *[c for c in left.columns if c != key], *[f.name for f in right.schema.fields if f.name != key]]
        without = left.where(F.col(key).isNull()).select("*", *bare)
        found = skew_safe_lookup(left.where(F.col(key).isNotNull()), right, key, "keyed-left", n_left, small_rows)
        return found.select(*order).unionByName(without.select(*order))
    how = "left" if how == "keyed-left" else how
    n = left.count() if n_left is None else n_left
    if n <= small_rows:
        return left.join(right, key, how)
    limit = max(n // MAX_HOT_KEYS, 1)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(key)
    hot = stage(hot, "hot-keys")  # at most MAX_HOT_KEYS rows by construction
    hot = F.broadcast(hot)
    cold_part = left.join(hot, key, "left_anti").join(right, key, how)
    hot_right = F.broadcast(right.join(hot, key, "left_semi"))
    hot_part = left.join(hot, key, "left_semi").join(hot_right, key, how)
    return cold_part.unionByName(hot_part)


def star_edges(edges: DataFrame, entry: str = "entry", cluster: str = "cluster") -> DataFrame:
    """(u, v) with u > v: every entry linked to the smallest entry of each of its clusters."""
    centre = edges.groupBy(cluster).agg(F.min(entry).alias("v"))
    linked = skew_safe_lookup(edges, centre, cluster)
    return linked.select(F.col(entry).alias("u"), "v").where("u > v").distinct()


def _staged_state(df: DataFrame, label: str) -> tuple[DataFrame, tuple[int, int]]:
    """Stage an edge table; its size and hash are observed while it is written."""
    seen = Observation()
    out = stage(
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")), label)
    return out, (int(seen.get["n"]), int(seen.get["h"]))


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = both.where("v > u")
    return skew_safe_lookup(up, low, "u", n_left=n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = skew_safe_lookup(e, low, "u", n_left=n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def component_labels(edges: DataFrame, entries: DataFrame | None = None, *, entry: str = "entry",
                     cluster: str = "cluster", max_rounds: int = 60) -> DataFrame:
    """``entry, root`` where root is the smallest entry of the component.

    ``entries`` restricts the graph to a corpus and adds its isolated entries.
    """
    edges = stage(edges.select(entry, cluster), "edges")  # read twice to build the stars
    if entries is not None:
        entries = entries.select(F.col(entry)).distinct()
        edges = edges.join(entries, entry, "left_semi")
    nodes = entries if entries is not None else edges.select(entry).distinct()
    e, state = _staged_state(star_edges(edges, entry, cluster), "stars")
    for _ in range(max_rounds):
        e, after = _staged_state(_small_star(_large_star(e, state[0]), state[0]), "stars")
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias(entry), F.col("v").alias("root"))
    return nodes.join(roots, entry, "left").select(entry, F.coalesce("root", F.col(entry)).alias("root"))


def components(edges: DataFrame, entries: DataFrame | None = None, *, entry: str = "entry", cluster: str = "cluster") -> DataFrame:
    """``entry, component, component_size``; components are numbered by size (descending), then smallest entry."""
    labels = stage(component_labels(edges, entries, entry=entry, cluster=cluster), "labels")
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("component_size"))
    numbered = with_position(sizes, [F.col("component_size").desc(), F.col("root").asc()], "component")
    return skew_safe_lookup(labels, numbered, "root").select(entry, "root", "component", "component_size")


def component_summary(edges: DataFrame, comps: DataFrame, n_clusters: int | None = None, entry: str = "entry",
                      cluster: str = "cluster") -> DataFrame:
    """Component and cluster counts (one row)."""
    per_comp = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    a = per_comp.agg(
        F.sum("size").alias("n_entries"), F.count(F.lit(1)).alias("n_components"),
        F.max("size").alias("largest_component"), F.count_if(F.col("size") == 1).alias("n_singleton_components"),
    )
    per_cluster = edges.join(comps.select(entry), entry, "left_semi").groupBy(cluster).agg(F.count_distinct(entry).alias("m"))
    b = per_cluster.agg(
        F.count(F.lit(1)).alias("clusters_touching_corpus"), F.count_if(F.col("m") > 1).alias("clusters_multi_entry")
    )
    out = a.join(F.broadcast(b))
    return out if n_clusters is None else out.withColumn("clusters_total", F.lit(n_clusters))
