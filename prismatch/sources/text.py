"""Text formats: domain lists, names, id lists, clusters, resolution index, CSV, JSON, directories."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismatch.contracts import ContractError
from prismatch.functions.text import entry_of
from prismatch.sources.archives import file_system
from prismatch.sources.records import numbered_lines

# Columns of the domain list.
DOMAIN_COLUMNS = "domain_id C A T H S35 S60 S95 S100 S100_count length resolution".split()

WHOLE = 64 << 20  # files up to this many bytes are read as one value
PIECE = 4 << 20  # bytes of a larger file that are held at a time


def _comment(c: Column) -> Column:
    return c.startswith("#") | (F.trim(c) == "")


def parse_domain_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """Whitespace-separated domain rows, ``#`` comments skipped, typed."""
    clean = F.trim(F.substring_index(F.col(value), "#", 1))
    parts = F.split(clean, r"\s+")
    rows = lines.where(clean != "").select(parts.alias("p"))
    kinds = ["string", *["int"] * 10, "float"]
    return rows.select(*[F.get("p", F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(zip(DOMAIN_COLUMNS, kinds))])


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_domain_list(spark.read.text(path))


def parse_names(lines: DataFrame, value: str = "value") -> DataFrame:
    """``node, label`` rows; a leading colon of the label is dropped."""
    pattern = r"^\s*(\S+)\s+(\S+)\s+(.*)$"
    c = F.col(value)
    return lines.where(~_comment(c)).select(
        F.regexp_extract(c, pattern, 1).alias("node"),
        F.trim(F.regexp_replace(F.regexp_extract(c, pattern, 3), "^:+", "")).alias("label"))


def parse_id_list(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.select(F.trim(F.col(value)).alias("id")).where("id <> ''")


def parse_clusters(lines: DataFrame, line_no: str = "line_no", line: str = "line", within: str | None = None) -> DataFrame:
    """(cluster, entry) edges; a blank line yields nothing but keeps its number.

    Numbers may count the lines of each ``within``, which is kept; where lines are dealt by it, no edge is shuffled.
    """
    keys = [within] if within else []
    tokens = F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda t: t != "")
    return lines.select(*keys, F.col(line_no).alias("cluster"), F.explode_outer(tokens).alias("token")).where("token is not null").select(
        *keys, "cluster", entry_of("token").alias("entry")).distinct()


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster file to edges; the line number is the cluster id."""
    return parse_clusters(numbered_lines(spark, path).select("line_no", "line"))


def cluster_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines, non-blank lines and member tokens (one row)."""
    n = F.size(F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda t: t != ""))
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(n > 0).alias("n_clusters"), F.sum(n).alias("n_entities"))


def parse_resolution(lines: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """``entry, resolution`` from ``ID ; value`` lines: four-letter ids, positive values, the last line wins."""
    c = F.col(line)
    entry = F.lower(F.trim(F.substring_index(c, ";", 1)))
    value = F.trim(F.substring(c, F.instr(c, ";") + 1, F.length(c))).try_cast("double")
    rows = lines.where(c.contains(";")).select(line_no, entry.alias("entry"), value.alias("resolution"))
    rows = rows.where((F.length("entry") == 4) & (F.col("resolution") > 0))
    return rows.groupBy("entry").agg(F.max_by("resolution", line_no).alias("resolution"))


def parse_json_ids(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lower-case distinct ids of JSON string arrays."""
    ids = F.from_json(F.col(value), T.ArrayType(T.StringType()))
    return lines.select(F.explode(ids).alias("id")).select(F.lower("id").alias("id")).distinct()


def split_records(text: DataFrame, key: str, value: str, marker: str = "data_") -> DataFrame:
    """``key, record_no, name, body`` of a text that starts a record at every line with ``marker``."""
    pieces = F.split(F.concat(F.lit("\n"), F.col(value)), "\n" + marker)
    rows = text.select(key, F.posexplode(pieces).alias("record_no", "piece")).where("record_no > 0")
    return rows.select(key, F.col("record_no"), F.substring_index("piece", "\n", 1).alias("name"), F.col("piece").alias("body"))


def read_records(spark: SparkSession, path: str, marker: str = "data_") -> DataFrame:
    """``path, record_no, name, body`` of files that start a record at every line with ``marker``.

    The marker is the reader's record delimiter, so files are split inside, a record
    that crosses a split is read once, and no row holds more than a record.
    Numbers count a file's records from 1: the place within the split plus the
    records of the splits before, of which only counts are gathered.
    """
    raw = spark.read.option("lineSep", "\n" + marker).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("piece"), F.monotonically_increasing_id().alias("at"))
    split = Window.partitionBy("path", "start").orderBy("at")
    rows = raw.withColumn("place", F.row_number().over(split))
    head = (F.col("start") == 0) & (F.col("place") == 1)  # what stands before the first delimiter
    opens = head & F.col("piece").startswith(marker)
    sizes = raw.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("path", "start", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    first = rows.where(head).select("path", F.when(opens, 0).otherwise(1).alias("skipped"))
    piece = F.when(opens, F.substring("piece", F.lit(len(marker) + 1), F.length("piece"))).otherwise(F.col("piece"))
    numbered = rows.where(~head | opens).withColumn("piece", piece).join(before, ["path", "start"]).join(first, "path", "left")
    number = F.col("place") + F.col("before") - F.coalesce("skipped", F.lit(0))
    return numbered.select("path", number.cast("bigint").alias("record_no"), F.substring_index("piece", "\n", 1).alias("name"), F.col("piece").alias("body"))


def read_csv_contract(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV with a header; a byte-order mark is ignored and missing columns are an error."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    first = df.columns[0] if df.columns else ""
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"{path}: missing columns {missing}")
    return df


CROP_SCHEMA = T.StructType([
    T.StructField("crop_id", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("legacy_crop_id", T.StringType()),
    T.StructField("mapping_status", T.StringType()), T.StructField("review_status", T.StringType()),
    T.StructField("pdb_ids", T.ArrayType(T.StringType())), T.StructField("review_flags", T.ArrayType(T.StringType())),
    T.StructField("box_source_xyxy", T.ArrayType(T.IntegerType())), T.StructField("clean_query_eligible", T.BooleanType()),
])
HIT_SCHEMA = T.StructType([
    T.StructField("rank", T.IntegerType()), T.StructField("pdb_id", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("best_image_cosine", T.DoubleType()), T.StructField("render_id", T.StringType()), T.StructField("object_id", T.StringType()),
    T.StructField("view", T.IntegerType()), T.StructField("shard", T.StringType()), T.StructField("member", T.StringType()),
    T.StructField("corpus_split", T.StringType()),
])
SOURCE_SCHEMA = T.StructType([
    T.StructField("pdb_id", T.StringType()), T.StructField("present", T.BooleanType()), T.StructField("rank", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("corpus_split", T.StringType()),
])
PREDICTION_SCHEMA = T.StructType([
    *CROP_SCHEMA.fields, T.StructField("top10", T.ArrayType(HIT_SCHEMA)), T.StructField("top20", T.ArrayType(HIT_SCHEMA)),
    T.StructField("source_coverage", T.ArrayType(SOURCE_SCHEMA)), T.StructField("best_source_rank", T.IntegerType()),
])


def read_nested(spark: SparkSession, path: str, item: T.StructType, field: str) -> DataFrame:
    """Rows of the array ``field`` of JSON documents, with an explicit schema."""
    doc = T.StructType([T.StructField(field, T.ArrayType(item))])
    return spark.read.schema(doc).json(path, multiLine=True).select(F.explode(field).alias("row")).select("row.*")


def scan_views(spark: SparkSession, root: str, max_views: int | None = None) -> DataFrame:
    """``domain_id, view, out_path, ok`` of ``v<N>/.../<id>.png`` files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root).select("path")
    view = F.regexp_extract("path", r"/v(\d+)/", 1)
    rows = files.where(view != "").select(
        F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("domain_id"), view.cast("int").alias("view"),
        F.col("path").alias("out_path"), F.lit(True).alias("ok"))
    return rows if max_views is None else rows.where(F.col("view") < max_views)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes, sha256) of (path, length), a piece of a file at a time."""
    for b in batches:
        digests = []
        for path in b.column(0).to_pylist():
            fs, inner = file_system(path)
            sha = hashlib.sha256()
            with fs.open_input_stream(inner) as f:
                while piece := f.read(PIECE):
                    sha.update(piece)
            digests.append(sha.hexdigest())
        yield pa.record_batch([*b.columns, pa.array(digests, pa.string())], ["path", "bytes", "sha256"])


def checksums(spark: SparkSession, paths: str | Sequence[str], whole: int = WHOLE) -> DataFrame:
    """``path, bytes, sha256`` of files.

    A digest takes a file's bytes in order, so one task reads a file. Files above ``whole`` bytes are
    never rows: each has a scan task of its own, which pyarrow gives a piece at a time.
    """
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", "length")
    return small.unionByName(large.mapInArrow(_streamed, "path string, bytes bigint, sha256 string"))


def checksum_violations(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files (``name, sha256``) that are missing or differ."""
    named = found.select(F.substring_index("path", "/", -1).alias("name"), F.col("sha256").alias("__got"))
    both = expected.join(named, "name", "left")
    return both.where(~F.col("sha256").eqNullSafe(F.col("__got"))).select(
        "name", F.when(F.col("__got").isNull(), "missing").otherwise("different").alias("problem"))


def provenance(files: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """``artifact, bytes, sha256, n_rows`` of files and of table counts."""
    out = files.select(F.substring_index("path", "/", -1).alias("artifact"), "bytes", "sha256", F.lit(None).cast("bigint").alias("n_rows"))
    for name, df in counts.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("artifact"), F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("sha256"), "n_rows")
        out = out.unionByName(row)
    return out
