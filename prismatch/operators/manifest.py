"""The domain manifest: ids of one redundancy level with their classification, names, origin and file.

Defined cases: ids absent from the domain list, and repeats of an id in the list of ids or files, add no row; nodes
without a name give null; an id too short for a part gives an empty or null part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.functions.text import hierarchy, sentinel_to_null
from prismatch.operators.graph import skew_safe_lookup
from prismatch.session import stage

# Resolution that stands for "unknown", names of the levels.
UNKNOWN_RESOLUTION = 999.0
LEVELS = ("cath_class", "cath_arch", "cath_topo", "cath_homsf")


def id_parts(domain: str) -> dict[str, Column]:
    """Source structure, chain and number of a domain, by position in its id."""
    c = F.col(domain)
    return {"pdb_id": F.substring(c, 1, 4), "chain": F.substring(c, 5, 1), "domain_idx": F.substring(c, F.lit(6), F.length(c)).try_cast("int")}


def domain_manifest(domains: DataFrame, ids: DataFrame, names: DataFrame, files: DataFrame | None, level: str, folder: str, require_file: bool = True) -> DataFrame:
    """Rows of ``domains`` (domain_id, C, A, T, H, resolution, ...) whose id is in ``ids`` (id).

    ``names`` (node, label) names the levels; ``files`` (id) lists the files that exist, None where there is no folder.
    """
    out = domains.join(ids.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")
    if files is not None:  # before the names, as it leaves fewer rows
        there = files.select(F.col("id").alias("domain_id"))
        if require_file:
            out = out.join(there, "domain_id", "left_semi").withColumn("has_pdb", F.lit(True))
        else:
            found = there.distinct().withColumn("has_pdb", F.lit(True))
            out = out.join(found, "domain_id", "left").withColumn("has_pdb", F.coalesce("has_pdb", F.lit(False)))
    else:
        out = out.withColumn("has_pdb", F.lit(False))
    codes = F.struct(*[c.alias(n) for n, c in zip(LEVELS, hierarchy(["C", "A", "T", "H"]), strict=True)])
    out = stage(out.withColumn("__codes", codes), "domains")  # read for the classes, for their counts and for the rows
    label = names.groupBy("node").agg(F.max("label").alias("label"))
    classes = out.select("__codes").distinct()
    for c in LEVELS:  # names meet each class once; few classes may hold most domains
        named = label.select(F.col("node").alias("__node"), F.col("label").alias(c + "_name"))
        classes = classes.join(named, F.col("__codes")[c] == F.col("__node"), "left").drop("__node")
    out = skew_safe_lookup(out, classes, "__codes").select("*", *[F.col("__codes")[c].alias(c) for c in LEVELS]).drop("__codes")
    unknown = F.coalesce(F.col("resolution") >= UNKNOWN_RESOLUTION, F.lit(False))
    out = out.withColumns(id_parts("domain_id")).withColumn("is_nmr_or_unknown_res", unknown)
    out = out.withColumn("resolution", sentinel_to_null("resolution", UNKNOWN_RESOLUTION))
    out = out.withColumn("pdb_path", F.concat(F.lit(folder.rstrip("/") + "/"), "domain_id"))
    return (out.where("has_pdb") if require_file else out).withColumn("nr_level", F.lit(level.upper()))


def missing_ids(domains: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked-for ids that the domain list does not know."""
    return ids.select("id").distinct().join(domains.select(F.col("domain_id").alias("id")), "id", "left_anti")
