"""Corpus construction: set cover, object filters, sharding, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatch.functions.text import holding_path
from prismatch.operators.graph import skew_safe_lookup
from prismatch.operators.ordering import with_position
from prismatch.operators.selection import values_at
from prismatch.session import stage

# Unresolved entries sort last; fetch shards; object limits.
NO_RESOLUTION = 10_000.0
FETCH_SHARDS = 24
MIN_RESIDUES = 30
MAX_ATOMS_AU = 15_000
MAX_ATOMS_ASSEMBLY = 50_000
DEFERRED_ATOMS = 300_000


def set_cover(edges: DataFrame, resolution: DataFrame, held: DataFrame | None = None, *, entry: str = "entry",
              cluster: str = "cluster", value: str = "resolution") -> DataFrame:
    """Entries kept by the greedy cover that takes the best-resolved entry first: ``entry, resolution``.

    An entry is kept exactly when it is the first holder of some cluster in that
    order, so the loop becomes one grouped minimum.
    """
    if held is not None:
        edges = edges.join(held.select(entry).distinct(), entry, "left_semi")
    known = resolution.select(entry, value)
    holders = edges.select(entry).distinct()
    # the order becomes one number per entry, so the grouped minimum over the (larger) edge table hashes instead of sorting
    order = [F.coalesce(F.col(value), F.lit(NO_RESOLUTION)), F.col(entry)]
    placed = stage(with_position(holders.join(known, entry, "left"), order, "__place"), "cover-order")
    ranked = skew_safe_lookup(edges.select(entry, cluster), placed.select(entry, "__place"), entry)
    first = ranked.groupBy(cluster).agg(F.min("__place").alias("__place")).select("__place").distinct()
    return placed.join(first, "__place", "left_semi").select(entry, value)


def subset_table(edges: DataFrame, kept: DataFrame, *, entry: str = "entry", cluster: str = "cluster", shards: int = FETCH_SHARDS) -> DataFrame:
    """Acquisition table: clusters per kept entry, round-robin shard in cover order, path."""
    width = edges.groupBy(entry).agg(F.count_distinct(cluster).alias("n_clusters_covered"))
    order = [F.coalesce("resolution", F.lit(NO_RESOLUTION)), F.col(entry)]
    placed = with_position(kept, order, "__i")
    return placed.join(width, entry).select(
        F.col(entry).alias("pdb_id"), "resolution", "n_clusters_covered", (F.col("__i") % shards).alias("shard"),
        holding_path(F.col(entry).cast("string")).alias("rel_path"),
    )


def coverage_verdict(edges: DataFrame, kept: DataFrame, n_clusters: int | None = None, *, entry: str = "entry", cluster: str = "cluster") -> DataFrame:
    """Clusters covered by the kept entries, FULL or PARTIAL (one row)."""
    total = edges.select(cluster).distinct().agg(F.count(F.lit(1)).alias("n_clusters")) if n_clusters is None else None
    covered = edges.join(kept.select(entry), entry, "left_semi").select(cluster).distinct().agg(F.count(F.lit(1)).alias("covered"))
    out = covered.join(F.broadcast(total)) if total is not None else covered.withColumn("n_clusters", F.lit(n_clusters))
    return out.withColumn("verdict", F.when(F.col("covered") == F.col("n_clusters"), "FULL").otherwise("PARTIAL"))


def order_statistics(df: DataFrame, value: str, key: str, fractions: dict[str, float]) -> DataFrame:
    """Values at place ``int(n * fraction)`` of the sorted column (one row, with ``n_with`` and ``n_without``).

    Selected digit by digit in scans of the one column, without a sort. ``key``
    would break ties, which cannot change a value.
    """
    counts = df.agg(F.count(value).alias("n_with"), F.count_if(F.col(value).isNull()).alias("n_without"))
    n = counts.first()["n_with"]
    places = {name: int(n * f) for name, f in fractions.items()}
    found = values_at(df, value, sorted({p for p in places.values() if p < n}))
    known = dict(zip(sorted({p for p in places.values() if p < n}), found, strict=True))
    return counts.select("*", *[F.lit(known.get(p)).cast("double").alias(name) for name, p in places.items()])


def object_flags(df: DataFrame) -> DataFrame:
    """keep/deferred flags of the index pass."""
    asm = F.col("asm1_differs") & (F.col("asm1_res") >= MIN_RESIDUES)
    return df.withColumn("keep_au", F.col("au_res") >= MIN_RESIDUES).withColumn("keep_asm1", asm).withColumn(
        "deferred", F.greatest("au_atoms", "asm1_atoms") > DEFERRED_ATOMS)


def objects(df: DataFrame, rule: str = "per_object") -> DataFrame:
    """Zero to two object rows per index row: ``object_id, pdb_id, kind, atoms``.

    ``per_object`` limits each object on its own; ``per_entry`` is the older rule
    that drops both objects of a deferred entry.
    """
    clean = F.coalesce(F.col("error"), F.lit("")) == ""
    if rule == "per_object":
        au = (F.col("au_res") >= MIN_RESIDUES) & (F.col("au_atoms") > 0) & (F.col("au_atoms") <= MAX_ATOMS_AU)
        asm = (F.col("asm1_differs") & (F.col("asm1_res") >= MIN_RESIDUES) & (F.col("asm1_atoms") > 0)
               & (F.col("asm1_atoms") <= MAX_ATOMS_ASSEMBLY))
    elif rule == "per_entry":
        au = F.col("keep_au") & ~F.col("deferred")
        asm = F.col("keep_asm1") & ~F.col("deferred")
    else:
        raise ValueError(f"unknown object rule {rule!r}")

    def item(kind: str, atoms: str, keep):
        return F.struct(F.lit(kind).alias("kind"), F.col(atoms).cast("bigint").alias("atoms"), F.coalesce(keep, F.lit(False)).alias("keep"))

    both = F.filter(F.array(item("au", "au_atoms", au), item("asm1", "asm1_atoms", asm)), lambda x: x["keep"])
    return df.where(clean).withColumn("o", F.explode(both)).select(
        F.concat(F.col("pdb_id").cast("string"), F.lit("_"), F.col("o.kind")).alias("object_id"), "pdb_id", F.col("o.kind").alias("kind"), F.col("o.atoms").alias("atoms"))


def deal_shards(objs: DataFrame, shards: int, *, by: str | None = None, size: str = "atoms", key: str = "object_id") -> DataFrame:
    """Deal size-sorted objects round-robin, then number each shard's objects largest first.

    With ``by``, dealing restarts in every group (for example per source archive).
    """
    group = [F.col(by)] if by else []
    placed = with_position(objs, [*group, F.col(size).asc(), F.col(key).asc()], "__i")
    if by:
        placed = stage(placed, "dealt")
        base = placed.groupBy(by).agg(F.min("__i").alias("__b"))
        placed = skew_safe_lookup(placed, base, by).withColumn("__i", F.col("__i") - F.col("__b")).drop("__b")
    dealt = placed.withColumn("shard", F.col("__i") % shards)
    # ascending round-robin: within a shard the dealing order is the size order, so largest first is its reverse
    dealt = stage(dealt.withColumn("__r", F.floor(F.col("__i") / shards)), "shards")
    last = dealt.groupBy(*([by] if by else []), "shard").agg(F.max("__r").alias("__last"))
    return dealt.join(F.broadcast(last), [*([by] if by else []), "shard"]).withColumn(
        "job_order", F.col("__last") - F.col("__r")).drop("__i", "__r", "__last")


def pending(objs: DataFrame, attempts: DataFrame, views: int, *, key: str = "object_id", view: str = "view") -> DataFrame:
    """Objects that do not have all views attempted yet; partly done objects are redone in full."""
    done = attempts.groupBy(key).agg(F.count_distinct(view).alias("n")).where(F.col("n") >= views).select(key)
    return objs.join(done, key, "left_anti")


def next_part(files: DataFrame, path: str = "path", pattern: str = r"_p(\d+)\.") -> DataFrame:
    """Next free part number per shard prefix (zero when none exists)."""
    part = F.regexp_extract(path, pattern, 1)
    named = files.select(F.regexp_extract(path, r"([^/]+)_p\d+\.", 1).alias("shard"), F.when(part != "", part.cast("int")).alias("part"))
    return named.groupBy("shard").agg((F.coalesce(F.max("part"), F.lit(-1)) + 1).alias("next_part"))


def chunked(df: DataFrame, order: Sequence, rows: int = 8192, name: str = "chunk") -> DataFrame:
    """Number consecutive blocks of ``rows`` rows in the given order."""
    return with_position(df, list(order), "__i").withColumn(name, F.floor(F.col("__i") / rows)).drop("__i")


def evenly_spaced(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """Rows at ``n`` evenly spaced places of the order, first and last included."""
    placed = stage(with_position(df, list(order), "__i"), "spaced")
    total = placed.count()
    step = (total - 1) / (n - 1) if n > 1 else 0.0
    places = sorted({int(i * step) if i < n - 1 else total - 1 for i in range(n)})
    return placed.where(F.col("__i").isin(places)).drop("__i")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, by one partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    head = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), head).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def recover_untabled(tabled: DataFrame, scanned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table rows plus scanned rows the table does not know."""
    extra = scanned.join(tabled.select(*keys), list(keys), "left_anti")
    return tabled.unionByName(extra, allowMissingColumns=True)
