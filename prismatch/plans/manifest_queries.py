"""The domain manifest, reuse of results by chunk, links of hits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prismatch.functions import text as X
from prismatch.functions import vectors as V
from prismatch.operators import chunk_cache
from prismatch.operators.corpus import chunked, evenly_spaced
from prismatch.operators.manifest import domain_manifest
from prismatch.plans.registry import query
from prismatch.plans.views import table
from prismatch.session import stage, staging_root

# an order is a domain, open orders belong to the level, orders with returned items have a file
_DOMAINS = """WITH domains AS (
  SELECT lower(lpad(to_hex(o_orderkey % 65536), 4, '0')) || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || CAST(o_orderkey // 65536 AS VARCHAR) AS domain_id, o_orderkey, o_orderstatus,
   o_orderkey % 4 + 1 AS c, o_orderkey % 7 AS a, o_orderkey % 11 AS t, o_orderkey % 13 AS h, CASE WHEN o_orderkey % 9 = 0 THEN 999.0::DOUBLE ELSE o_totalprice END AS resolution FROM orders),
names AS (SELECT CAST(r_regionkey + 1 AS VARCHAR) AS node, r_name AS label FROM region
 UNION ALL SELECT (n_nationkey % 4 + 1) || '.' || (n_nationkey % 7), n_name FROM nation),
codes AS (SELECT *, CAST(c AS VARCHAR) AS cath_class, c || '.' || a AS cath_arch, c || '.' || a || '.' || t AS cath_topo, c || '.' || a || '.' || t || '.' || h AS cath_homsf FROM domains)
SELECT domain_id, cath_class, cath_arch, cath_topo, cath_homsf, k.label AS cath_class_name, g.label AS cath_arch_name, substring(domain_id, 1, 4) AS pdb_id, substring(domain_id, 5, 1) AS chain,
 CAST(substring(domain_id, 6) AS INTEGER) AS domain_idx, CASE WHEN resolution < 999 THEN round(resolution, 2) END AS resolution, resolution >= 999 AS is_nmr_or_unknown_res,
 'domains/' || domain_id AS pdb_path, 'S40' AS nr_level
FROM codes LEFT JOIN names k ON k.node = cath_class LEFT JOIN names g ON g.node = cath_arch
WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""


@query("domain_manifest", _DOMAINS)
def domain_manifest_query(spark, sf):
    """Orders stand for domains, regions and nations for the named nodes."""
    key = F.col("o_orderkey")
    name = F.concat(F.lower(F.lpad(F.hex(key % 65536), 4, "0")), F.chr((65 + key % 26).cast("int")), F.floor(key / 65536).cast("string"))
    orders = table(spark, sf, "orders").withColumn("domain_id", name)
    domains = orders.select("domain_id", (key % 4 + 1).alias("C"), (key % 7).alias("A"), (key % 11).alias("T"), (key % 13).alias("H"),
                            F.when(key % 9 == 0, 999.0).otherwise(F.col("o_totalprice")).alias("resolution"))
    ids = orders.where("o_orderstatus = 'O'").select(F.col("domain_id").alias("id"))
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    files = orders.join(returned, "o_orderkey", "left_semi").select(F.col("domain_id").alias("id"))
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    names = region.select((F.col("r_regionkey") + 1).cast("string").alias("node"), F.col("r_name").alias("label")).unionByName(
        nation.select(F.concat_ws(".", F.col("n_nationkey") % 4 + 1, F.col("n_nationkey") % 7).alias("node"), F.col("n_name").alias("label")))
    return domain_manifest(domains, ids, names, files, "s40", "domains").select(
        "domain_id", "cath_class", "cath_arch", "cath_topo", "cath_homsf", "cath_class_name", "cath_arch_name", "pdb_id", "chain", "domain_idx",
        F.round("resolution", 2).alias("resolution"), "is_nmr_or_unknown_res", "pdb_path", "nr_level")


@query("hit_links", """SELECT page_id, upper(d) AS pdb_id, 'https://www.rcsb.org/structure/' || upper(d) AS pdb_url, 'https://cdn.rcsb.org/images/structures/' || d || '_assembly-1.jpeg' AS image_url
FROM (SELECT page_id, lower(substring(md5(url), 1, 4)) AS d FROM pages)""")
def hit_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", *X.hit_links(F.lower(F.substring(F.md5("url"), 1, 4))))


CHUNK = 64


@query("chunk_reuse", """WITH placed AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS chunk FROM embeddings)
SELECT chunk, count(*) AS n_rows, CASE WHEN count(*) FILTER (vec_id % 1000 = 7) > 0 THEN 'computed' ELSE 'reused' END AS state,
 CAST(sum(label) AS BIGINT) AS labels, round(sum(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS squares FROM placed GROUP BY 1""")
def chunk_reuse(spark, sf):
    """A table is computed, one row in a thousand changes, and the next run computes the chunks of those rows alone."""
    now = stage(chunked(table(spark, sf, "embeddings"), [F.col("vec_id")], CHUNK), "chunks")
    before = now.withColumn("label", F.when(F.col("vec_id") % 1000 == 7, -1).otherwise(F.col("label")))
    path = f"{staging_root(spark).rstrip('/')}/prismatch-cache-{uuid.uuid4().hex}"

    def compute(rows):
        return rows.select("vec_id", "chunk", "label", "embedding", V.dot("embedding", "embedding").alias("square"))

    def check(rows, stored):
        some = evenly_spaced(rows.select("vec_id", "embedding"), [F.col("vec_id")], 16)
        chunk_cache.agreement(stored, some, "vec_id", "embedding", V.cosine, 0.9999)

    rule = {"chunk": "chunk", "columns": ["vec_id", "label", "embedding"], "config": "squares-1"}
    chunk_cache.cached_chunks(before, compute, path, **rule)
    run = chunk_cache.cached_chunks(now, compute, path, check=check, **rule)
    sums = run.result.groupBy("chunk").agg(F.sum("label").alias("labels"), F.round(F.sum("square"), 4).alias("squares"))
    return run.chunks.join(sums, "chunk").select("chunk", "n_rows", "state", "labels", "squares")
