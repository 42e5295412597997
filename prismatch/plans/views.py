"""The shared test tables seen as the engine's own tables.

Every view covers its whole source table. The SQL twins in the catalogue use
the same definitions (``WITH`` prefixes below), so both engines read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatch.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# entry: 10 images-per-view groups of a label; view: the 16 views of an object
MANIFEST_SQL = """
manifest AS (
  SELECT vec_id AS render_id,
         'E' || lpad(CAST(label * 10 + (vec_id // 16) % 10 AS VARCHAR), 3, '0') AS entry,
         vec_id % 16 AS view, label, embedding AS emb,
         CASE WHEN label = 8 THEN 'val' WHEN label = 9 THEN 'test' ELSE 'train' END AS split
  FROM embeddings)"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    number = (F.col("label") * 10 + F.floor(F.col("vec_id") / 16) % 10).cast("string")
    return e.select(
        F.col("vec_id").alias("render_id"),
        F.concat(F.lit("E"), F.lpad(number, 3, "0")).alias("entry"),
        (F.col("vec_id") % 16).alias("view"),
        "label",
        F.col("embedding").alias("emb"),
        F.when(F.col("label") == 8, "val").when(F.col("label") == 9, "test").otherwise("train").alias("split"),
    )


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """One row per entry."""
    return manifest(spark, sf).groupBy(F.col("entry").alias("pdb_id")).agg(F.max("split").alias("split"))


# fictional sequence clusters: a document is an entry, a line of text a cluster
EDGES_SQL = """
edges AS (
  SELECT DISTINCT doc_id AS entry, md5(line) AS cluster
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE trim(line) <> '')"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("entry"), F.explode_outer(F.split("text", "\n")).alias("line"))
    return d.where(F.trim("line") != "").select("entry", F.md5("line").alias("cluster")).distinct()


# helix / strand / other symbols from text: vowels, consonants, the rest
SS_SQL = """
ss AS (
  SELECT doc_id AS domain_id, source, lang,
         regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z]', '-', 'g'), '[aeiouAEIOU]', 'H', 'g'),
                        '[b-df-gj-np-tv-zB-DF-GJ-NP-TV-Z]', 'E', 'g') AS ss_string
  FROM documents)"""


def ss(spark: SparkSession, sf: str) -> DataFrame:
    other = F.regexp_replace("text", "[^A-Za-z]", "-")
    helix = F.regexp_replace(other, "[aeiouAEIOU]", "H")
    strand = F.regexp_replace(helix, "[b-df-gj-np-tv-zB-DF-GJ-NP-TV-Z]", "E")
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"))
    return d.select(F.col("doc_id").alias("domain_id"), "source", "lang", strand.alias("ss_string"))


# domain hierarchy from parts; the 999 sentinel marks an unknown resolution
DOMAINS_SQL = """
domains AS (
  SELECT p_partkey AS domain_id, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 5 AS c,
         CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS a, p_type AS t, p_size AS h, p_name AS s35,
         CASE WHEN p_partkey % 7 = 0 THEN 999.0::DOUBLE ELSE p_retailprice / 1000 END AS resolution
  FROM part)"""


def domains(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("domain_id"), (brand % 5).alias("c"), brand.alias("a"), F.col("p_type").alias("t"),
        F.col("p_size").alias("h"), F.col("p_name").alias("s35"),
        F.when(F.col("p_partkey") % 7 == 0, 999.0).otherwise(F.col("p_retailprice") / 1000).alias("resolution"),
    )


# an 8x8 RGB image per vector: three shifted copies of the 64 values, 0..255
PIXELS_SQL = """
pixels AS (
  SELECT image, i // 8 AS y, i % 8 AS x,
         CAST(least(255, greatest(0, floor((v[i + 1] + 0.5) * 256))) AS BIGINT) AS r,
         CAST(least(255, greatest(0, floor((v[(i + 21) % 64 + 1] + 0.5) * 256))) AS BIGINT) AS g,
         CAST(least(255, greatest(0, floor((v[(i + 42) % 64 + 1] + 0.5) * 256))) AS BIGINT) AS b
  FROM (SELECT vec_id AS image, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v, unnest(range(64)) AS i FROM embeddings))"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Images as row-major RGB bytes with height and width."""
    v = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 256))))
    i = F.sequence(F.lit(0), F.lit(63))
    flat = F.flatten(F.transform(i, lambda k: F.array(F.col("v")[k], F.col("v")[(k + 21) % 64], F.col("v")[(k + 42) % 64])))
    return (
        spread(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("image"), "label", v.alias("v"))
        .select("image", "label", F.lit(8).alias("height"), F.lit(8).alias("width"),
                F.unhex(F.array_join(F.transform(flat, lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("rgb"))
    )


# figure crops from documents: flags from their labels, sources from their id, a query vector per document
CROPS_SQL = """
crops AS (
  SELECT d.doc_id AS crop_id, d.source AS source_id,
         CASE d.lang WHEN 'en' THEN 'panel_candidates' WHEN 'fr' THEN 'source_mapped' ELSE 'multiple_depicted' END AS mapping_status,
         CASE WHEN d.n_chars % 2 = 0 THEN ['E' || lpad(CAST(d.doc_id % 110 AS VARCHAR), 3, '0')]
              ELSE ['E' || lpad(CAST(d.doc_id % 110 AS VARCHAR), 3, '0'), 'E' || lpad(CAST((d.doc_id + 37) % 110 AS VARCHAR), 3, '0')] END AS pdb_ids,
         CASE WHEN l.toxic = 1 THEN ['rna_only'] ELSE CAST([] AS VARCHAR[]) END AS review_flags,
         CASE WHEN l.quality = 1 THEN CAST(d.doc_id AS VARCHAR) END AS legacy_crop_id,
         e.emb
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  JOIN (SELECT vec_id, embedding AS emb, count(*) OVER () AS n FROM embeddings) e ON d.doc_id % e.n = e.vec_id)"""


def crops(spark: SparkSession, sf: str) -> DataFrame:
    d, l, e = (table(spark, sf, n) for n in ("documents", "labels", "embeddings"))
    n = e.count()

    def code(c):
        return F.concat(F.lit("E"), F.lpad((c % 110).cast("string"), 3, "0"))

    first, second = code(F.col("doc_id")), code(F.col("doc_id") + 37)
    status = F.when(F.col("lang") == "en", "panel_candidates").when(F.col("lang") == "fr", "source_mapped").otherwise("multiple_depicted")
    return (
        d.join(l, "doc_id", "left")
        .join(e.select(F.col("vec_id"), F.col("embedding").alias("emb")), F.col("doc_id") % n == F.col("vec_id"))
        .select(
            F.col("doc_id").alias("crop_id"), F.col("source").alias("source_id"), status.alias("mapping_status"),
            F.when(F.col("n_chars") % 2 == 0, F.array(first)).otherwise(F.array(first, second)).alias("pdb_ids"),
            F.when(F.col("toxic") == 1, F.array(F.lit("rna_only"))).otherwise(F.array().cast("array<string>")).alias("review_flags"),
            F.when(F.col("quality") == 1, F.col("doc_id").cast("string")).alias("legacy_crop_id"),
            "emb",
        )
    )
