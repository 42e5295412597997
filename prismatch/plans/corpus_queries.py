"""Joins, sets, windows, corpus construction, splits, audits, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatch.contracts import checked_join
from prismatch.functions import text as X
from prismatch.functions import vectors as V
from prismatch.functions.canonical import canonical_json, fingerprint
from prismatch.operators import corpus as C
from prismatch.operators import crops as Crops
from prismatch.operators import graph as G
from prismatch.operators import labels as L
from prismatch.operators import metrics as M
from prismatch.operators import packing as P
from prismatch.operators import splits as S
from prismatch.operators.ordering import with_position, with_running_total
from prismatch.operators.selection import bottom_k, values_at
from prismatch.plans import views
from prismatch.plans.registry import query
from prismatch.plans.views import table
from prismatch.session import stage
from prismatch.sources.records import running_max_accepted

M_SQL = "WITH " + views.MANIFEST_SQL


# ---- joins and sets -------------------------------------------------------
@query("manifest_split_join", """SELECT lower(c.c_mktsegment) AS segment, n.n_name AS nation, count(*) AS n_rows, round(sum(o.o_totalprice), 2) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2""")
def manifest_split_join(spark, sf):
    """Many-to-one joins; both right sides are proven unique first."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = checked_join(checked_join(o, c, ["c_custkey"]), n, ["n_nationkey"])
    return rows.groupBy(F.lower("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")).agg(
        F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("semi_join_subset", "SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1")
def semi_join_subset(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").join(good, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("anti_join_missing", "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def anti_join_missing(spark, sf):
    known = table(spark, sf, "labels").select("doc_id")
    return table(spark, sf, "documents").join(known, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("left_lookup_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_lookup_default(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return G.skew_safe_lookup(d, table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("union_recover_untabled", """SELECT 'tabled' AS origin, count(*) AS n, count(DISTINCT l_orderkey) AS objects FROM lineitem WHERE l_returnflag = 'N'
UNION ALL SELECT 'scanned', count(*), count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')""")
def union_recover_untabled(spark, sf):
    tabled = table(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("k"), F.lit("tabled").alias("origin"), "l_linenumber")
    scanned = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("scanned").alias("origin"))
    return C.recover_untabled(tabled, scanned, ["k"]).groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("k").alias("objects"))


@query("dedup_first", """SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, row_number() OVER
 (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n = 1""".replace("SELECT * FROM", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM"))
def dedup_first(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return C.first_per_key(li, ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_partkey", "l_suppkey", "l_quantity"])


@query("set_intersect_views", M_SQL + " SELECT entry FROM manifest WHERE view = 0 INTERSECT SELECT entry FROM manifest WHERE view > 0")
def set_intersect_views(spark, sf):
    m = views.manifest(spark, sf)
    return m.where("view = 0").select("entry").intersect(m.where("view > 0").select("entry"))


@query("set_except_entries", "SELECT c_custkey AS entry FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except_entries(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("entry")).subtract(
        table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("distribution_align", """SELECT coalesce(a.v, b.v) AS value, coalesce(a.p, 0) AS p_labelled, coalesce(b.p, 0) AS p_unlabelled FROM
 (SELECT lang || source AS v, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) a FULL OUTER JOIN
 (SELECT lang || source AS v, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1) b ON a.v = b.v""")
def distribution_align(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("lang", "source").alias("value"))
    known = table(spark, sf, "labels").select("doc_id")

    def share(rows, name):
        c = rows.groupBy("value").agg(F.count("*").alias("c"))
        return c.join(F.broadcast(c.agg(F.sum("c").alias("t")))).select("value", F.round(F.col("c") / F.col("t"), 6).alias(name))

    a = share(d.join(known, "doc_id", "left_semi"), "p_labelled")
    b = share(d.join(known, "doc_id", "left_anti"), "p_unlabelled")
    return a.join(b, "value", "full_outer").select(
        "value", F.coalesce("p_labelled", F.lit(0.0)).alias("p_labelled"), F.coalesce("p_unlabelled", F.lit(0.0)).alias("p_unlabelled"))


@query("running_total", """SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts, event_id) - CAST(round(value * 100) AS BIGINT) AS BIGINT) AS before FROM events""")
def running_total(spark, sf):
    """Exclusive prefix sum over the whole event log, in cents."""
    e = table(spark, sf, "events").select("event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return with_running_total(e, [F.col("ts"), F.col("event_id")], "cents", "before", inclusive=False).select("event_id", "before")


@query("row_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders")
def row_positions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return with_position(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "position")


@query("running_max_accept", """SELECT l_orderkey, count(*) AS n_rows, count(*) FILTER (best IS NULL OR l_quantity > best) AS n_accepted FROM
 (SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM lineitem) GROUP BY 1""")
def running_max_accept(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")
    marked = running_max_accepted(li, ["l_orderkey", "l_linenumber"], "l_quantity", [F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")])
    return marked.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.count_if("accepted").alias("n_accepted"))


@query("altloc_resolve", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER
 (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def altloc_resolve(spark, sf):
    """Highest occupancy per (residue, atom); ties keep the first record."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")
    li = li.withColumn("neg", -F.col("l_quantity"))
    return C.first_per_key(li, ["l_orderkey", "l_linenumber"], ["neg", "l_extendedprice", "l_partkey", "l_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


# ---- domains --------------------------------------------------------------
_CODES = """,
coded AS (SELECT *, CAST(c AS VARCHAR) AS cath_class, c || '.' || a AS cath_arch, c || '.' || a || '.' || t AS cath_topo, c || '.' || a || '.' || t || '.' || h AS cath_homsf FROM domains)"""


def _coded(spark, sf):
    d = views.domains(spark, sf)
    names = ("cath_class", "cath_arch", "cath_topo", "cath_homsf")
    return d.select("*", *[e.alias(n) for e, n in zip(X.hierarchy(["c", "a", "t", "h"]), names)])


@query("hierarchy_codes", "WITH " + views.DOMAINS_SQL + _CODES + " SELECT domain_id, cath_class, cath_arch, cath_topo, cath_homsf FROM coded")
def hierarchy_codes(spark, sf):
    return _coded(spark, sf).select("domain_id", "cath_class", "cath_arch", "cath_topo", "cath_homsf")


@query("sentinel_null", "WITH " + views.DOMAINS_SQL + " SELECT domain_id, CASE WHEN resolution < 999 THEN round(resolution, 6) END AS resolution, resolution >= 999 AS is_nmr_or_unknown_res FROM domains")
def sentinel_null(spark, sf):
    return views.domains(spark, sf).select(
        "domain_id", F.round(X.sentinel_to_null("resolution", 999.0), 6).alias("resolution"), (F.col("resolution") >= 999).alias("is_nmr_or_unknown_res"))


@query("nested_counts", "WITH " + views.DOMAINS_SQL + _CODES + """ SELECT count(*) AS n_domains, count(DISTINCT cath_homsf) AS n_homsf, count(DISTINCT cath_topo) AS n_topo,
 count(DISTINCT cath_arch) AS n_arch, count(DISTINCT cath_class) AS n_class,
 count(DISTINCT cath_class) <= count(DISTINCT cath_arch) AND count(DISTINCT cath_arch) <= count(DISTINCT cath_topo)
 AND count(DISTINCT cath_topo) <= count(DISTINCT cath_homsf) AND count(DISTINCT cath_homsf) <= count(*) AS nested FROM coded""")
def nested_counts(spark, sf):
    cols = ("cath_homsf", "cath_topo", "cath_arch", "cath_class")
    # one distinct pass over the finest code; coarser codes are prefixes of it
    fine = _coded(spark, sf).groupBy(*cols).agg(F.count("*").alias("c"))
    out = fine.agg(F.sum("c").alias("n_domains"), *[F.count_distinct(c).alias("n_" + c.removeprefix("cath_")) for c in cols])
    chain = ["n_class", "n_arch", "n_topo", "n_homsf", "n_domains"]
    ok = F.lit(True)
    for lo, hi in zip(chain, chain[1:]):
        ok = ok & (F.col(lo) <= F.col(hi))
    return out.withColumn("nested", ok)


# ---- cover and shards -----------------------------------------------------
_COVER = "WITH " + views.EDGES_SQL + """,
res AS (SELECT doc_id AS entry, CASE WHEN n_chars % 5 <> 0 THEN n_chars / 1000.0::DOUBLE END AS resolution FROM documents),
ranked AS (SELECT e.entry, e.cluster, r.resolution, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(r.resolution, 10000), e.entry) AS n FROM edges e JOIN res r USING (entry)),
kept AS (SELECT DISTINCT entry, resolution FROM ranked WHERE n = 1)"""


def _cover(spark, sf):
    e = stage(views.edges(spark, sf), "edges")
    r = table(spark, sf, "documents").select(F.col("doc_id").alias("entry"), F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") / 1000.0).alias("resolution"))
    return e, C.set_cover(e, r)


@query("set_cover", _COVER + " SELECT entry, resolution FROM kept")
def set_cover(spark, sf):
    return _cover(spark, sf)[1]


@query("subset_table", _COVER + """ SELECT CAST(entry AS BIGINT) AS pdb_id, resolution, (SELECT count(*) FROM edges e WHERE e.entry = kept.entry) AS n_clusters_covered,
 (row_number() OVER (ORDER BY coalesce(resolution, 10000), entry) - 1) % 24 AS shard, substring(CAST(entry AS VARCHAR), 2, 2) || '/' || entry || '.cif.gz' AS rel_path FROM kept""")
def subset_table(spark, sf):
    e, kept = _cover(spark, sf)
    return C.subset_table(e, kept)


@query("coverage_verdict", _COVER + """ SELECT count(DISTINCT cluster) AS covered, (SELECT count(DISTINCT cluster) FROM edges) AS n_clusters,
 CASE WHEN count(DISTINCT cluster) = (SELECT count(DISTINCT cluster) FROM edges) THEN 'FULL' ELSE 'PARTIAL' END AS verdict FROM edges WHERE entry IN (SELECT entry FROM kept)""")
def coverage_verdict(spark, sf):
    e, kept = _cover(spark, sf)
    return C.coverage_verdict(e, kept)


@query("resolution_quantiles", _COVER + """, s AS (SELECT list_sort(list(resolution)) AS v FROM kept WHERE resolution IS NOT NULL)
SELECT CAST(len(v) AS BIGINT) AS n_with, (SELECT count(*) FROM kept WHERE resolution IS NULL) AS n_without, v[len(v) // 2 + 1] AS median, v[CAST(floor(0.9 * len(v)) AS BIGINT) + 1] AS p90 FROM s""")
def resolution_quantiles(spark, sf):
    return C.order_statistics(_cover(spark, sf)[1], "resolution", "entry", {"median": 0.5, "p90": 0.9})


def _subsample_sql(limit: int, seed: int) -> str:
    return f"""WITH {views.MANIFEST_SQL}, r AS (SELECT split, render_id, row_number() OVER (PARTITION BY split ORDER BY substr(sha256('{seed}:' || render_id), 1, 15), render_id) AS n FROM manifest)
SELECT split, render_id FROM r WHERE n <= CASE WHEN split = 'train' THEN {limit} ELSE {max(1, limit // 4)} END"""


@query("seeded_subsample", _subsample_sql(200, 7))
def seeded_subsample(spark, sf):
    """A limited run's rows: the limit for training, a quarter of it for each other split."""
    m = views.manifest(spark, sf).select("split", "render_id")
    return bottom_k(m, {"train": 200, "val": 50, "test": 50}, ["render_id"], 7, by="split")


@query("price_order_statistics", """WITH s AS (SELECT list_sort(list(l_extendedprice * (1 - l_discount))) AS v FROM lineitem)
SELECT p AS place, v[p + 1] AS price FROM (SELECT v, unnest([0, len(v) // 4, len(v) // 2, (len(v) * 9) // 10, len(v) - 1]) AS p FROM s)""")
def price_order_statistics(spark, sf):
    """Order statistics of a computed double column by radix selection."""
    rows = table(spark, sf, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    n = rows.count()
    places = [0, n // 4, n // 2, n * 9 // 10, n - 1]
    return spark.createDataFrame(list(zip(places, values_at(rows, "price", places), strict=True)), "place bigint, price double")


@query("config_fingerprint", r"""WITH t AS (SELECT p_partkey, '{"attributes": {"brand": "' || p_brand || '", "size": ' || p_size || ', "type": "' || p_type || '"}, "batch_size": ' || p_size % 7
 || ', "by_key": {"a' || p_size % 3 || '": ' || p_size || ', "b": null}, "flag": ' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ', "name": "' || p_name || '", "steps": [' || p_size || ', ' || p_size + 1 || ']}' AS blob FROM part)
SELECT p_partkey, blob, substr(sha256(blob || '|lr=' || CAST(p_partkey % 10 AS VARCHAR)), 1, 16) AS print FROM t""")
def config_fingerprint(spark, sf):
    """Canonical JSON of nested settings whose fields are declared in no particular order, and its fingerprint."""
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.array(size, size + 1).alias("steps"), (size % 2 == 0).alias("flag"), (size % 7).alias("batch_size"),
        F.create_map(F.lit("b"), F.lit(None).cast("int"), F.concat(F.lit("a"), size % 3), size).alias("by_key"),
        F.struct(F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), size.alias("size")).alias("attributes"))
    names = [c for c in rows.columns if c != "p_partkey"]
    rate = F.concat(F.lit("|lr="), (F.col("p_partkey") % 10).cast("string"))
    whole = F.struct(*names)
    blob = canonical_json(whole, rows.select(whole.alias("x")).schema["x"].dataType)
    return rows.select("p_partkey", blob.alias("blob"), fingerprint(rows, names, suffix=rate).alias("print"))


_OBJ = """WITH idx AS (
  SELECT o_orderkey AS pdb_id, CAST(floor(o_totalprice / 10) AS BIGINT) AS au_atoms, CAST(floor(o_totalprice) AS BIGINT) % 97 AS au_res,
         CAST(coalesce(asm, 0) AS BIGINT) AS asm1_atoms, coalesce(n, 0) * 12 AS asm1_res,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'parse error' ELSE '' END AS error
  FROM orders LEFT JOIN (SELECT l_orderkey, floor(sum(l_quantity) * 600) AS asm, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
flags AS (SELECT *, asm1_atoms <> au_atoms AND asm1_atoms > 0 AS asm1_differs FROM idx),
obj AS (
  SELECT pdb_id || '_au' AS object_id, pdb_id, 'au' AS kind, au_atoms AS atoms FROM flags WHERE error = '' AND au_res >= 30 AND au_atoms > 0 AND au_atoms <= 15000
  UNION ALL SELECT pdb_id || '_asm1', pdb_id, 'asm1', asm1_atoms FROM flags WHERE error = '' AND asm1_differs AND asm1_res >= 30 AND asm1_atoms > 0 AND asm1_atoms <= 50000)"""


def _index(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.floor(F.sum("l_quantity") * 600).alias("asm"), F.count("*").alias("n"))
    o = table(spark, sf, "orders").join(li, "o_orderkey", "left")
    bad = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    rows = o.select(
        F.col("o_orderkey").alias("pdb_id"), F.floor(F.col("o_totalprice") / 10).alias("au_atoms"), (F.floor("o_totalprice") % 97).alias("au_res"),
        F.coalesce("asm", F.lit(0)).cast("bigint").alias("asm1_atoms"), (F.coalesce("n", F.lit(0)) * 12).alias("asm1_res"),
        F.when(bad, "parse error").otherwise("").alias("error"))
    rows = rows.withColumn("asm1_differs", (F.col("asm1_atoms") != F.col("au_atoms")) & (F.col("asm1_atoms") > 0))
    return C.object_flags(rows)


@query("object_filter", _OBJ + " SELECT * FROM obj")
def object_filter(spark, sf):
    return C.objects(_index(spark, sf))


@query("object_filter_per_entry", _OBJ + """ SELECT kind, count(*) AS n, CAST(sum(atoms) AS BIGINT) AS atoms FROM (
  SELECT 'au' AS kind, au_atoms AS atoms FROM flags WHERE error = '' AND au_res >= 30 AND greatest(au_atoms, asm1_atoms) <= 300000
  UNION ALL SELECT 'asm1', asm1_atoms FROM flags WHERE error = '' AND asm1_differs AND asm1_res >= 30 AND greatest(au_atoms, asm1_atoms) <= 300000) GROUP BY 1""")
def object_filter_per_entry(spark, sf):
    return C.objects(_index(spark, sf), "per_entry").groupBy("kind").agg(F.count("*").alias("n"), F.sum("atoms").alias("atoms"))


@query("round_robin_shards", _OBJ + """, d AS (SELECT *, (row_number() OVER (ORDER BY atoms, object_id) - 1) AS i FROM obj)
SELECT object_id, pdb_id, kind, atoms, i % 96 AS shard, row_number() OVER (PARTITION BY i % 96 ORDER BY i DESC) - 1 AS job_order FROM d""")
def round_robin_shards(spark, sf):
    return C.deal_shards(C.objects(_index(spark, sf)), 96)


@query("shards_within_archive", _OBJ + """, d AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY atoms, object_id) - 1) AS i FROM obj)
SELECT kind, i % 4 AS shard, count(*) AS n, CAST(sum(atoms) AS BIGINT) AS atoms FROM d GROUP BY 1, 2""")
def shards_within_archive(spark, sf):
    d = C.deal_shards(C.objects(_index(spark, sf)), 4, by="kind")
    return d.groupBy("kind", "shard").agg(F.count("*").alias("n"), F.sum("atoms").alias("atoms"))


@query("resume_pending", """SELECT o_orderkey AS object_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 4)""")
def resume_pending(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"))
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("view"))
    return C.pending(o, a, 4)


@query("shard_totals", """SELECT l_suppkey AS shard, count(*) AS images, count(*) FILTER (l_returnflag = 'R') AS failed, count(DISTINCT l_orderkey) AS objects,
 round(sum(l_quantity), 2) AS seconds FROM lineitem GROUP BY 1""")
def shard_totals(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(
        F.count("*").alias("images"), F.count_if(F.col("l_returnflag") == "R").alias("failed"),
        F.count_distinct("l_orderkey").alias("objects"), F.round(F.sum("l_quantity"), 2).alias("seconds"))


@query("row_chunks", "SELECT i // 8192 AS chunk, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1")
def row_chunks(spark, sf):
    e = C.chunked(table(spark, sf, "events").select("event_id"), [F.col("event_id")])
    return e.groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("cache_agreement", """WITH p AS (SELECT CAST(embedding AS DOUBLE[]) AS a, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 3)) AS b, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
SELECT count(*) AS sample_size, round(min(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))), 6) AS min_cosine FROM p
WHERE i IN (SELECT CASE WHEN k < 15 THEN CAST(floor(k * ((SELECT max(n) FROM p) - 1) / 15.0::DOUBLE) AS BIGINT) ELSE (SELECT max(n) FROM p) - 1 END FROM range(16) t(k))""")
def cache_agreement(spark, sf):
    """Cosine of cached and fresh vectors at 16 evenly spaced ids (the sample is the operator)."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("b"))
    s = C.evenly_spaced(e, [F.col("vec_id")], 16)
    return s.agg(F.count("*").alias("sample_size"), F.round(F.min(V.cosine("a", "b")), 6).alias("min_cosine"))


# ---- components and splits ------------------------------------------------
_CC = "WITH RECURSIVE " + views.EDGES_SQL + """,
star AS (SELECT entry, min(entry) OVER (PARTITION BY cluster) AS r FROM edges),
link AS (SELECT DISTINCT entry AS a, r AS b FROM star UNION SELECT DISTINCT r, entry FROM star),
cc(n, lab) USING KEY (n) AS (
  SELECT a, min(b) FROM link GROUP BY 1
  UNION SELECT link.a, min(cc.lab) FROM cc JOIN link ON cc.n = link.b JOIN recurring.cc k ON k.n = link.a WHERE cc.lab < k.lab GROUP BY 1),
sizes AS (SELECT lab, count(*) AS component_size FROM cc GROUP BY 1),
comp AS (SELECT lab, component_size, row_number() OVER (ORDER BY component_size DESC, lab) - 1 AS component FROM sizes)"""


@query("components", _CC + " SELECT n AS entry, component, component_size FROM cc JOIN comp USING (lab)")
def components(spark, sf):
    return G.components(views.edges(spark, sf)).select("entry", "component", "component_size")


@query("component_summary", _CC + """, per AS (SELECT cluster, count(*) AS m FROM edges GROUP BY 1)
SELECT CAST(sum(component_size) AS BIGINT) AS n_entries, count(*) AS n_components, max(component_size) AS largest_component, count(*) FILTER (component_size = 1) AS n_singleton_components,
 (SELECT count(*) FROM per) AS clusters_touching_corpus, (SELECT count(*) FROM per WHERE m > 1) AS clusters_multi_entry FROM sizes""")
def component_summary(spark, sf):
    e = stage(views.edges(spark, sf), "edges")
    return G.component_summary(e, stage(G.components(e), "components"))


_PACK = """,
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS g0, CAST(0 AS DOUBLE) AS g1, CAST(0 AS DOUBLE) AS g2, CAST(NULL AS VARCHAR) AS split, CAST(NULL AS BIGINT) AS lab
  UNION ALL
  SELECT i + 1, g0 + CASE WHEN pick = 0 THEN component_size ELSE 0 END, g1 + CASE WHEN pick = 1 THEN component_size ELSE 0 END,
         g2 + CASE WHEN pick = 2 THEN component_size ELSE 0 END, CASE pick WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END, lab
  FROM (SELECT w.i, w.g0, w.g1, w.g2, c.component_size, c.lab,
          CASE WHEN (0.8::DOUBLE * t.n - g0) / greatest(0.8::DOUBLE * t.n, 1) >= (0.1::DOUBLE * t.n - g1) / greatest(0.1::DOUBLE * t.n, 1)
                AND (0.8::DOUBLE * t.n - g0) / greatest(0.8::DOUBLE * t.n, 1) >= (0.1::DOUBLE * t.n - g2) / greatest(0.1::DOUBLE * t.n, 1) THEN 0
               WHEN (0.1::DOUBLE * t.n - g1) / greatest(0.1::DOUBLE * t.n, 1) >= (0.1::DOUBLE * t.n - g2) / greatest(0.1::DOUBLE * t.n, 1) THEN 1 ELSE 2 END AS pick
        FROM walk w JOIN comp c ON c.component = w.i, (SELECT CAST(sum(component_size) AS DOUBLE) AS n FROM comp) t))"""


@query("greedy_pack", _CC + _PACK + " SELECT n AS entry, component, component_size, split FROM cc JOIN comp USING (lab) JOIN walk USING (lab)")
def greedy_pack(spark, sf):
    """Component split by relative deficit; exact ties go to the earlier split."""
    return S.component_split(views.edges(spark, sf), seed=None)


@query("component_split_seeded")
def component_split_seeded(spark, sf):
    """As ``greedy_pack`` with the seeded tie jitter (numpy's generator has no SQL twin)."""
    return S.component_split(views.edges(spark, sf)).groupBy("split").agg(F.count("*").alias("n_entries"), F.count_distinct("component").alias("n_components"))


def _strat_sql(stratum: str, group: str, where: str = "TRUE") -> str:
    return "WITH RECURSIVE " + views.DOMAINS_SQL + _CODES + f""",
sz AS (SELECT {stratum} AS s, {group} AS g, count(*) AS n FROM coded GROUP BY 1, 2),
keep AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM sz) WHERE {where}),
ord AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, g) AS i, CAST(sum(n) OVER (PARTITION BY s) AS DOUBLE) AS total FROM keep),
w AS (
  SELECT s, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS g0, CAST(0 AS DOUBLE) AS g1, CAST(0 AS DOUBLE) AS g2, CAST(NULL AS VARCHAR) AS g, CAST(NULL AS VARCHAR) AS split FROM (SELECT DISTINCT s FROM ord)
  UNION ALL
  SELECT s, i, g0 + CASE WHEN pick = 0 THEN n ELSE 0 END, g1 + CASE WHEN pick = 1 THEN n ELSE 0 END, g2 + CASE WHEN pick = 2 THEN n ELSE 0 END, g,
         CASE pick WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END
  FROM (SELECT w.s, o.i, w.g0, w.g1, w.g2, o.n, o.g,
          CASE WHEN 0.8::DOUBLE * total - g0 >= 0.1::DOUBLE * total - g1 AND 0.8::DOUBLE * total - g0 >= 0.1::DOUBLE * total - g2 THEN 0
               WHEN 0.1::DOUBLE * total - g1 >= 0.1::DOUBLE * total - g2 THEN 1 ELSE 2 END AS pick
        FROM w JOIN ord o ON o.s = w.s AND o.i = w.i + 1))"""


@query("stratified_pack", _strat_sql("cath_arch", "cath_homsf") + " SELECT g AS cath_homsf, split FROM w WHERE g IS NOT NULL")
def stratified_pack(spark, sf):
    return S.grouped_split(_coded(spark, sf), "cath_homsf", stratum="cath_arch", seed=None)


@query("member_split", _strat_sql("cath_topo", "s35", "c >= 3") + """ SELECT s AS cath_topo, g AS s35, split FROM w WHERE g IS NOT NULL
UNION ALL SELECT s, g, 'train' FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM sz) WHERE c < 3""")
def member_split(spark, sf):
    return S.member_split(_coded(spark, sf), "cath_topo", "s35", seed=None)


@query("member_eligible", "WITH " + views.DOMAINS_SQL + _CODES + " SELECT cath_topo, count(DISTINCT s35) AS n_clusters, count(DISTINCT s35) >= 3 AS eligible FROM coded GROUP BY 1")
def member_eligible(spark, sf):
    return _coded(spark, sf).groupBy("cath_topo").agg(F.count_distinct("s35").alias("n_clusters")).withColumn("eligible", F.col("n_clusters") >= 3)


@query("random_split_numpy")
def random_split_numpy(spark, sf):
    """The leaky control, bit-equal to one numpy stream in key order."""
    return S.random_split(views.domains(spark, sf), "domain_id", seed=0)


@query("split_audit")
def split_audit(spark, sf):
    """All four seeded schemes with leak counts and drift."""
    d = _coded(spark, sf).withColumnRenamed("s35", "S35")
    return S.audit(d, S.build_all(d))


_DOC_SPLIT = """WITH docs AS (SELECT *, CASE WHEN CAST(substring(source, 4) AS INTEGER) < 14 THEN 'train' WHEN CAST(substring(source, 4) AS INTEGER) < 17 THEN 'val' ELSE 'test' END AS split FROM documents)"""


def _doc_split(spark, sf):
    n = F.substring("source", 4, 10).cast("int")
    return table(spark, sf, "documents").withColumn("split", F.when(n < 14, "train").when(n < 17, "val").otherwise("test"))


@query("split_value_counts", _DOC_SPLIT + " SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM docs GROUP BY 1")
def split_value_counts(spark, sf):
    c = _doc_split(spark, sf).groupBy("split").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("t")))).select("split", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("tvd_by_class", _DOC_SPLIT + """, c AS (SELECT lang, count(*) FILTER (split = 'train') AS x, count(*) FILTER (split = 'test') AS y FROM docs GROUP BY 1)
SELECT round(sum(abs(x / (SELECT sum(x) FROM c) - y / (SELECT sum(y) FROM c))) / 2, 4) AS tvd FROM c""")
def tvd_by_class(spark, sf):
    return S.tvd(_doc_split(spark, sf), "split", "lang")


@query("straddle_audit", _DOC_SPLIT + " SELECT h AS content FROM (SELECT md5(text) AS h, split FROM docs) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def straddle_audit(spark, sf):
    d = _doc_split(spark, sf).select(F.md5("text").alias("content"), "split")
    return S.straddling(d, "content", "split")


@query("duplicate_content_groups", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content_groups(spark, sf):
    return Crops.duplicate_groups(table(spark, sf, "documents"), "text", "doc_id")


@query("duplicate_members", """SELECT doc_id, first_id, n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1""")
def duplicate_members(spark, sf):
    return Crops.duplicate_links(table(spark, sf, "documents"), "text", "doc_id")


# ---- labels ---------------------------------------------------------------
@query("label_map_unseen", _DOC_SPLIT + """, m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS y FROM (SELECT DISTINCT lang || source AS v FROM docs WHERE split = 'train'))
SELECT doc_id, coalesce(y, -100) AS y FROM docs LEFT JOIN m ON lang || source = v""")
def label_map_unseen(spark, sf):
    d = _doc_split(spark, sf).select("doc_id", "split", F.concat("lang", "source").alias("v"))
    m = L.label_map(d.where("split = 'train'"), "v")
    return L.encode_labels(d, m, "v").select("doc_id", "y")


@query("balanced_weights", """WITH c AS (SELECT p_type AS label, count(*) AS n FROM part GROUP BY 1)
SELECT label, row_number() OVER (ORDER BY label) - 1 AS index, n AS count, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def balanced_weights(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("label"))
    w = L.balanced_weights(L.class_counts(p, L.label_map(p, "label"), "label"))
    return w.withColumn("weight", F.round("weight", 6))


_PAIRS = """WITH p AS (SELECT coalesce(l.quality, -100) AS t, CASE WHEN d.n_chars % 3 = 0 THEN 2 WHEN l.toxic = 1 THEN 0 ELSE 1 END AS y FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (SELECT * FROM p WHERE t <> -100), u AS (SELECT t AS c FROM k UNION SELECT y FROM k),
f AS (SELECT c, (SELECT count(*) FROM k WHERE t = c AND y = c) AS tp, (SELECT count(*) FROM k WHERE t = c) AS nt, (SELECT count(*) FROM k WHERE y = c) AS np FROM u)"""


@query("accuracy_macro_f1", _PAIRS + """ SELECT (SELECT count(*) FROM k) AS n, count(*) AS n_labels, round(sum(tp) / (SELECT count(*) FROM k), 6) AS accuracy,
 round(avg(CASE WHEN nt + np > 0 THEN 2.0::DOUBLE * tp / (nt + np) ELSE 0 END), 6) AS macro_f1, CASE WHEN sum(tp) / (SELECT count(*) FROM k) > 0.542 AND avg(2.0::DOUBLE * tp / (nt + np)) > 0.225 THEN 'CLEARS'
 WHEN sum(tp) / (SELECT count(*) FROM k) > 0.542 OR avg(2.0::DOUBLE * tp / (nt + np)) > 0.225 THEN 'MIXED' ELSE 'BELOW' END AS verdict FROM f""")
def accuracy_macro_f1(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = d.select(F.coalesce("quality", F.lit(-100)).alias("t"), F.when(F.col("n_chars") % 3 == 0, 2).when(F.col("toxic") == 1, 0).otherwise(1).alias("y"))
    out = M.accuracy_macro_f1(rows, "t", "y").withColumn("verdict", M.gate_verdict(F.col("accuracy"), F.col("macro_f1")))
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("macro_f1", F.round("macro_f1", 6))
