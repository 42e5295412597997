"""Leak-free split schemes and their audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatch.contracts import ContractError, checked_join
from prismatch.operators.graph import components, skew_safe_lookup
from prismatch.operators.ordering import with_position
from prismatch.operators.packing import FRACTIONS, SPLITS, pack, stream_uniforms
from prismatch.session import stage

# Fixed value: seed of the component split.
COMPONENT_SEED = 20260919


def component_split(edges: DataFrame, entries: DataFrame | None = None, *, entry: str = "entry", cluster: str = "cluster",
                    fractions: Sequence[float] = FRACTIONS, seed: int | None = COMPONENT_SEED, check: bool = True) -> DataFrame:
    """``entry, component, component_size, split``; no cluster spans two splits."""
    comps = stage(components(edges, entries, entry=entry, cluster=cluster), "components")
    sizes = comps.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    packed = pack(sizes, group="root", size="size", fractions=fractions, relative=True, seed=seed).select("root", "split")
    out = stage(skew_safe_lookup(comps, packed, "root").drop("root"), "component-split")
    if check:
        assert_no_leak(skew_safe_lookup(edges, out.select(entry, "split"), entry), cluster, "split")
    return out


def grouped_split(df: DataFrame, group: str, *, stratum: str | None = None, fractions: Sequence[float] = FRACTIONS,
                  seed: int | None = 0) -> DataFrame:
    """``group, split``: whole groups per split, balanced inside each stratum."""
    keys = [stratum, group] if stratum else [group]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return pack(sizes, group=group, size="size", stratum=stratum, fractions=fractions, seed=seed).select(group, "split")


def member_split(df: DataFrame, family: str, cluster: str, *, min_clusters: int = 3, fractions: Sequence[float] = FRACTIONS,
                 seed: int | None = 0) -> DataFrame:
    """``family, cluster, split``: clusters of a family are packed; families with few clusters stay in train."""
    sizes = stage(df.groupBy(family, cluster).agg(F.count(F.lit(1)).alias("size")), "members")
    width = sizes.groupBy(family).agg(F.count(F.lit(1)).alias("__c"))
    marked = skew_safe_lookup(sizes, width, family)
    big = marked.where(F.col("__c") >= min_clusters)
    key = F.concat_ws("|", F.col(family).cast("string"), F.col(cluster).cast("string"))
    packed = pack(big.withColumn("__key", key), group="__key", size="size", stratum=family, fractions=fractions, seed=seed)
    big = big.withColumn("__key", key).join(packed.select("__key", "split"), "__key").select(family, cluster, "split")
    small = marked.where(F.col("__c") < min_clusters).select(family, cluster, F.lit("train").alias("split"))
    return big.unionByName(small)


def random_split(df: DataFrame, key: str, *, fractions: Sequence[float] = FRACTIONS, seed: int = 0,
                 order: str | None = None) -> DataFrame:
    """``key, split`` from one seeded uniform per row in key order; the leaky control."""
    placed = with_position(df.select(key, *([order] if order else [])), [F.col(order or key), F.col(key)], "__i").select(key, "__i")

    def draw(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(__u=stream_uniforms(seed, pdf["__i"].to_numpy())).drop(columns="__i")

    u = placed.mapInPandas(draw, placed.select(key).schema.add("__u", "double"))
    a = fractions[0]
    b = fractions[0] + fractions[1]
    return u.select(key, F.when(F.col("__u") < a, SPLITS[0]).when(F.col("__u") < b, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))


def hashed_split(df: DataFrame, key: str, *, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Like :func:`random_split` but from a hash of the key: no sort, stable when rows are added."""
    u = F.pmod(F.xxhash64(key), F.lit(1_000_003)) / 1_000_003
    split = F.when(u < fractions[0], SPLITS[0]).when(u < fractions[0] + fractions[1], SPLITS[1]).otherwise(SPLITS[2])
    return df.select(key, split.alias("split"))


def build_all(df: DataFrame, *, key: str = "domain_id", arch: str = "cath_arch", topo: str = "cath_topo",
              homsf: str = "cath_homsf", s35: str = "S35", seed: int = 0) -> DataFrame:
    """One row per domain with its split under each scheme; null where a domain has no code for the scheme."""
    df = stage(df.select(key, arch, topo, homsf, s35), "domains")
    out = df.select(key, homsf, topo, s35).join(random_split(df, key, seed=seed).withColumnRenamed("split", "split_random"), key, "left")
    for code, name in ((homsf, "split_homsf"), (topo, "split_topo")):
        split = grouped_split(df.where(F.col(code).isNotNull()), code, stratum=arch, seed=seed)
        out = skew_safe_lookup(out, stage(split.withColumnRenamed("split", name), name), code, "left")
    member = member_split(df.where(F.col(homsf).isNotNull() & F.col(s35).isNotNull()), homsf, s35, seed=seed)
    pair = F.to_json(F.struct(F.col(homsf).alias("h"), F.col(s35).alias("s")))
    member = member.select(pair.alias("__pair"), F.col("split").alias("split_member"))
    keyed = out.withColumn("__pair", F.when(F.col(homsf).isNotNull() & F.col(s35).isNotNull(), pair))
    out = skew_safe_lookup(keyed, stage(member, "split_member"), "__pair", "left")
    return out.select(key, "split_random", "split_homsf", "split_topo", "split_member")


def straddling(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows in more than one split; rows without a group or split are left out."""
    kept = df.where(F.col(group).isNotNull() & F.col(split).isNotNull())
    # min <> max instead of a distinct count: partial aggregation keeps one pair per group
    per = kept.groupBy(group).agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    return per.where("lo <> hi").select(group)


def assert_no_leak(df: DataFrame, group: str, split: str) -> None:
    bad = straddling(df, group, split).limit(1).collect()
    if bad:
        raise ContractError(f"group {bad[0][0]!r} spans two splits")


def tvd(df: DataFrame, split: str, label: str, a: str = "train", b: str = "test", digits: int | None = 4) -> DataFrame:
    """Total variation distance of two splits' label distributions (NaN when a side is empty)."""
    counts = df.where(F.col(split).isin(a, b) & F.col(label).isNotNull()).groupBy(label).agg(
        F.count_if(F.col(split) == a).alias("x"), F.count_if(F.col(split) == b).alias("y"))
    total = counts.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    gap = F.sum(F.abs(F.try_divide("x", "nx") - F.try_divide("y", "ny"))) / 2
    value = F.when((F.coalesce(F.max("nx"), F.lit(0)) == 0) | (F.coalesce(F.max("ny"), F.lit(0)) == 0), F.lit(float("nan"))).otherwise(gap)
    return counts.join(F.broadcast(total)).agg((value if digits is None else F.round(value, digits)).alias("tvd"))


def audit_scheme(df: DataFrame, scheme: str, group: str, unit: str, labels: Sequence[str]) -> DataFrame:
    """Leak and drift report of one scheme (one row)."""
    s = F.col(scheme)
    counts = df.agg(
        *[F.count_if(s == n).alias(f"n_{n}") for n in SPLITS], F.count_if(s.isNull()).alias("n_unassigned"))
    leaks = straddling(df, group, scheme).agg(F.count(F.lit(1)).alias("groups_in_multiple_splits"))
    out = counts.join(F.broadcast(leaks)).withColumn("scheme", F.lit(scheme)).withColumn("group_unit", F.lit(unit))
    for label in labels:
        out = out.join(F.broadcast(tvd(df, scheme, label).withColumnRenamed("tvd", f"tvd_{label}")))
    return out


def audit(domains: DataFrame, splits: DataFrame, *, key: str = "domain_id", homsf: str = "cath_homsf", topo: str = "cath_topo",
          s35: str = "S35", labels: Sequence[str] = ("cath_class", "cath_arch")) -> DataFrame:
    """Four schemes, one row each."""
    both = checked_join(domains, splits, [key], cardinality="1:1")
    both = stage(both.withColumn("__member", F.concat_ws("|", F.col(homsf).cast("string"), F.col(s35).cast("string"))), "audit")
    plan = (("split_random", homsf, homsf), ("split_homsf", homsf, homsf), ("split_topo", topo, topo),
            ("split_member", "__member", f"{homsf}|{s35}"))
    parts = [audit_scheme(both, scheme, group, unit, labels) for scheme, group, unit in plan]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
