"""Fixed-width atom records: parsing, alternate locations, backbone residues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismatch.functions.text import residue_code
from prismatch.operators.graph import skew_safe_lookup
from prismatch.operators.ordering import with_earlier_max, with_position
from prismatch.session import stage

BACKBONE = ("N", "CA", "C", "O")  # fixed value: atom order of a backbone


def running_max_accepted(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], out: str = "accepted") -> DataFrame:
    """Mark rows that exceed every earlier row of their key (the first row always does)."""
    seen = with_earlier_max(df, keys, order, value, "__best")
    return seen.withColumn(out, F.col("__best").isNull() | (F.col(value) > F.col("__best"))).drop("__best")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of text files of any size; files are split and read in parallel."""
    place = F.monotonically_increasing_id().alias("at")
    lines = stage(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), place, F.col("value").alias("line")), "lines")
    placed = stage(with_position(lines, [F.col("path"), F.col("start"), F.col("at")], "p"), "numbered")
    first = placed.groupBy("path").agg(F.min("p").alias("first"))
    return skew_safe_lookup(placed, first, "path").select("path", (F.col("p") - F.col("first")).alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of many small files; a file is one record, split in the JVM."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode_outer(F.split("value", "\n")).alias("line_no", "line"))


def parse_atoms(lines: DataFrame, line: str = "line") -> DataFrame:
    """Backbone atom records with residue key, coordinates and occupancy (1.0 when unreadable)."""
    c = F.col(line)

    def field(start: int, width: int) -> Column:
        return F.substring(c, start, width)

    atom = F.trim(field(13, 4))
    return lines.where(c.startswith("ATOM") & atom.isin(*BACKBONE)).select(
        "path", "line_no", atom.alias("atom"),
        F.concat(field(22, 1), F.trim(field(23, 5))).alias("residue"),
        F.upper(F.trim(field(18, 3))).alias("name"),
        F.expr(f"try_cast(trim(substring({line}, 31, 8)) as double)").alias("x"),
        F.expr(f"try_cast(trim(substring({line}, 39, 8)) as double)").alias("y"),
        F.expr(f"try_cast(trim(substring({line}, 47, 8)) as double)").alias("z"),
        F.coalesce(F.expr(f"try_cast(trim(substring({line}, 55, 6)) as double)"), F.lit(1.0)).alias("occupancy"),
    )


def backbone(atoms: DataFrame) -> DataFrame:
    """One row per complete residue: ``path, position, residue, code, coords`` (N, CA, C, O).

    Alternate locations keep the highest occupancy, the first on a tie.
    """
    best = atoms.groupBy("path", "residue", "atom").agg(
        F.min_by(F.struct("x", "y", "z"), F.struct(-F.col("occupancy"), F.col("line_no"))).alias("xyz"))
    first = atoms.groupBy("path", "residue").agg(
        F.min("line_no").alias("first_line"), F.min_by("name", "line_no").alias("name"))
    per = best.groupBy("path", "residue").agg(*[
        F.max(F.when(F.col("atom") == a, F.array("xyz.x", "xyz.y", "xyz.z"))).alias(a) for a in BACKBONE])
    full = per.where(" and ".join(f"{a} is not null" for a in BACKBONE)).join(first, ["path", "residue"])
    order = Window.partitionBy("path").orderBy("first_line")
    return full.select("path", (F.row_number().over(order) - 1).alias("position"), "residue",
                       residue_code("name").alias("code"), F.array(*BACKBONE).alias("coords"))


def backbone_summary(atoms: DataFrame) -> DataFrame:
    """Per file: accepted atom records, complete residues, dropped residues."""
    marked = running_max_accepted(atoms, ["path", "residue", "atom"], "occupancy", [F.col("line_no")])
    per = marked.groupBy("path", "residue").agg(F.count_if("accepted").alias("n"), F.count_distinct("atom").alias("kinds"))
    return per.groupBy("path").agg(F.sum("n").alias("n_atoms_seen"), F.count_if(F.col("kinds") == 4).alias("n_res"),
                                   F.count_if(F.col("kinds") < 4).alias("n_res_dropped"))
