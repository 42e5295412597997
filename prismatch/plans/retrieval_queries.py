"""Retrieval: pooling rules, ranks, hits, protocols, coverage, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatch import contracts
from prismatch.functions import vectors as V
from prismatch.operators import exact as E
from prismatch.operators import metrics as M
from prismatch.operators import retrieval as R
from prismatch.operators import similarity as sim
from prismatch.plans import views
from prismatch.plans.registry import query
from prismatch.session import stage

KS = (1, 5, 10, 20)

UNIT = "list_transform(emb, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_dot_product(CAST(emb AS DOUBLE[]), CAST(emb AS DOUBLE[]))), 1e-12))"


def scores_sql(queries: str, gallery: str, k: int, more: str = "") -> str:
    """WITH parts up to ``scores(query_id, truth, entry, score)`` for two SELECTs of manifest rows."""
    return f"""WITH {views.MANIFEST_SQL}{more},
q AS (SELECT render_id AS query_id, entry AS truth, {UNIT} AS u FROM ({queries})),
g AS (SELECT render_id, entry, {UNIT} AS u FROM ({gallery})),
sims AS (SELECT q.query_id, q.truth, g.entry, g.render_id, list_dot_product(q.u, g.u) AS s FROM q CROSS JOIN g),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, entry ORDER BY s DESC) AS n FROM sims),
scores AS (SELECT query_id, truth, entry, round(avg(s), 6) AS score FROM best WHERE n <= {k} GROUP BY ALL)"""


RANKS = """,
ranks AS (SELECT * FROM (SELECT query_id, truth, entry, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS rank FROM scores)
          WHERE entry = truth)"""
OPTIMISTIC = """,
ranks AS (SELECT * FROM (SELECT query_id, truth, entry, score, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM scores)
          WHERE entry = truth)"""

RECALLS = ", ".join(f"round(count(*) FILTER (rank <= {k}) / count(*), 6) AS r_at_{k}" for k in KS)
V0_QUERIES = "SELECT * FROM manifest WHERE view = 0"
V0_GALLERY = "SELECT * FROM manifest WHERE view BETWEEN 1 AND 15"


def metrics_sql(rule: str, median: str = "median(rank)") -> str:
    return f"""
SELECT '{rule}' AS rule, count(*) AS n_queries, (SELECT count(*) FROM g) AS n_gallery_images,
       (SELECT count(DISTINCT entry) FROM g) AS n_gallery_entries, (SELECT count(*) FROM q) - count(*) AS n_dropped,
       {RECALLS}, round(avg(1.0::DOUBLE / rank), 6) AS mrr, CAST({median} AS DOUBLE) AS median_rank, round(avg(rank), 6) AS mean_rank
FROM ranks"""


def _protocol_query(rule: str):
    def run(spark, sf):
        q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)
        return R.evaluate(q, g, rule=rule, digits=6)

    return run


for _rule, _k in sim.RULES.items():
    query(f"retrieval_{_rule}", scores_sql(V0_QUERIES, V0_GALLERY, _k) + RANKS + metrics_sql(_rule))(_protocol_query(_rule))


@query("retrieval_optimistic_rank", scores_sql(V0_QUERIES, V0_GALLERY, 1) + OPTIMISTIC + metrics_sql("max", "quantile_disc(rank, 0.5)"))
def retrieval_optimistic_rank(spark, sf):
    q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)
    return R.evaluate(q, g, rule="max", ties="optimistic", median="lower", digits=6)


@query("retrieval_exact_unrounded", scores_sql(V0_QUERIES, V0_GALLERY, 5).replace("round(avg(s), 6)", "avg(s)") + RANKS + """
SELECT query_id, entry, round(score, 6) AS score, rank FROM ranks""")
def retrieval_exact_unrounded(spark, sf):
    """Ranks of exact scores; only the printed score is rounded."""
    q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)
    ranks = sim.entry_ranks(sim.build_index(g), q, rule="top5", query_id="render_id")
    return ranks.select("query_id", "entry", F.round("score", 6).alias("score"), "rank")


@query("retrieval_topk_hits", scores_sql(V0_QUERIES, V0_GALLERY, 5) + """
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS rank, entry, score FROM scores)
WHERE rank <= 20""")
def retrieval_topk_hits(spark, sf):
    q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)
    hits = sim.top_hits(sim.build_index(g), q, k=20, rule="top5", query_id="render_id", digits=6)
    return hits.select("query_id", "rank", "entry", "score")


@query("retrieval_best_image", scores_sql(V0_QUERIES, V0_GALLERY, 3) + """,
top AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS rank, entry, score FROM scores) WHERE rank <= 10),
img AS (SELECT query_id, entry, render_id AS best_image, round(s, 6) AS best_cosine,
               row_number() OVER (PARTITION BY query_id, entry ORDER BY round(s, 6) DESC, render_id) AS m FROM sims)
SELECT top.*, best_image, best_cosine FROM top JOIN img USING (query_id, entry) WHERE m = 1""")
def retrieval_best_image(spark, sf):
    q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)
    return sim.top_hits(sim.build_index(g), q, k=10, rule="top3", query_id="render_id", digits=6)


def _full(view: int, excluded: str) -> tuple[str, str]:
    return (f"SELECT * FROM manifest WHERE split = 'test' AND view = {view}",
            f"SELECT * FROM manifest WHERE NOT (split = 'test' AND view IN ({excluded}))")


for _p, (_q, _g) in {"view0_query": _full(0, "0"), "style_matched": _full(15, "0, 15")}.items():
    def _run(spark, sf, name=_p):
        q, g = R.full_minus_cohort(views.manifest(spark, sf), R.PROTOCOLS[name], F.col("split") == "test")
        return R.evaluate(q, g, rule="top5", digits=6)

    query(f"full_index_{_p}", scores_sql(_q, _g, 5) + RANKS + metrics_sql("top5"))(_run)


_EMPTY = """,
vocab AS (SELECT DISTINCT entry FROM manifest),
empty AS (SELECT entry, row_number() OVER (ORDER BY entry) AS place FROM vocab WHERE entry NOT IN (SELECT entry FROM g)),
everyone AS (SELECT query_id, rank FROM ranks
             UNION ALL SELECT q.query_id, (SELECT count(DISTINCT entry) FROM g) + place FROM q JOIN empty ON q.truth = empty.entry)"""
_VAL = ("SELECT * FROM manifest WHERE split = 'val' AND view = 0", "SELECT * FROM manifest WHERE NOT (split = 'val' AND view = 0)")


def _val_rule(i: int, rule: str, k: int) -> str:
    return f"""SELECT * FROM ({scores_sql(*_VAL, k)}{RANKS}{_EMPTY}
SELECT {i} AS place, '{rule}' AS rule, count(*) AS n_queries, round(count(*) FILTER (rank <= 1) / count(*), 6) AS r_at_1,
       round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM everyone)"""


@query("rule_selection", "SELECT rule, n_queries, r_at_1, mrr FROM (" + " UNION ALL ".join(
    _val_rule(i, r, k) for i, (r, k) in enumerate(sim.RULES.items())) + ") ORDER BY r_at_1 DESC, mrr DESC, place LIMIT 1")
def rule_selection(spark, sf):
    """Pooling rule with the best validation recall; entries without gallery rows still take ranks."""
    m = views.manifest(spark, sf)
    q, g = R.full_minus_cohort(m, R.VIEW0_QUERY, F.col("split") == "val")
    index = sim.build_index(g)
    rows, n_entries = None, m.select("entry").distinct().count()
    for rule in sim.RULES:
        ranks = R.ranks_with_empty_entries(index, q, m, rule=rule, digits=6)
        one = M.rank_metrics(ranks, ks=(1,), digits=6, max_rank=n_entries).select(F.lit(rule).alias("rule"), F.col("n").alias("n_queries"), "r_at_1", "mrr")
        rows = one if rows is None else rows.unionByName(one)
    return M.select_rule(rows, list(sim.RULES))


_LEVELS = {"homsf": "label", "topo": "label // 2", "arch": "label // 4"}
_LEVEL_SQL = f"""WITH {views.MANIFEST_SQL},
lv AS (SELECT render_id, {UNIT} AS u, label AS homsf, label // 2 AS topo, label // 4 AS arch FROM manifest),
s AS (SELECT a.render_id AS query_id, b.render_id AS entry, round(list_dot_product(a.u, b.u), 6) AS score FROM lv a CROSS JOIN lv b WHERE a.render_id <> b.render_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS rank FROM s) WHERE rank <= 10)"""


def _level_part(level: str) -> str:
    return f"""SELECT '{level}' AS level, count(*) AS n_query, count(*) FILTER (same > 1) AS answerable,
 {', '.join(f"round(count(*) FILTER (f <= {k}) / count(*), 4) AS recall_{k}" for k in (1, 5, 10))},
 {', '.join(f"round(count(*) FILTER (f <= {k} AND same > 1) / count(*) FILTER (same > 1), 4) AS recall_{k}_answerable" for k in (1, 5, 10))},
 round(sum(coalesce(1.0::DOUBLE / f, 0)) / count(*), 4) AS mrr, round(avg(same / (SELECT count(*) FROM lv)), 5) AS chance_at_1
FROM (SELECT a.render_id, count(*) OVER (PARTITION BY a.{level}) AS same, x.f FROM lv a
      LEFT JOIN (SELECT nn.query_id, min(nn.rank) AS f FROM nn JOIN lv q ON q.render_id = nn.query_id JOIN lv i ON i.render_id = nn.entry
                 WHERE q.{level} = i.{level} GROUP BY 1) x ON x.query_id = a.render_id)"""


@query("retrieval_self_excluded_levels", _LEVEL_SQL + " " + " UNION ALL ".join(_level_part(c) for c in _LEVELS))
def retrieval_self_excluded_levels(spark, sf):
    m = views.manifest(spark, sf).select(
        "render_id", "emb", F.col("label").alias("homsf"), F.floor(F.col("label") / 2).alias("topo"), F.floor(F.col("label") / 4).alias("arch"))
    index = sim.build_index(m, entry="render_id")
    hits = sim.top_hits(index, m, k=10, rule="max", query_id="render_id", digits=6, exclude_self=True)
    return R.level_report(hits, m, m, list(_LEVELS))


@query("chance_rate", f"""WITH {views.MANIFEST_SQL}
SELECT round(avg(coalesce(c, 0) / (SELECT count(*) FROM manifest WHERE view > 0)), 6) AS chance
FROM (SELECT entry FROM manifest WHERE view = 0) q LEFT JOIN (SELECT entry, count(*) AS c FROM manifest WHERE view > 0 GROUP BY 1) USING (entry)""")
def chance_rate(spark, sf):
    q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)
    return M.chance_rate(g, q, "entry").select(F.round("chance", 6).alias("chance"))


@query("unanswerable_queries", f"""WITH {views.MANIFEST_SQL}
SELECT split, count(*) AS n_asked, count(*) FILTER (entry IN (SELECT entry FROM manifest WHERE view BETWEEN 1 AND 14)) AS n_answerable
FROM manifest WHERE view = 15 GROUP BY 1""")
def unanswerable_queries(spark, sf):
    q, g = R.same_split(views.manifest(spark, sf), R.STYLE_MATCHED)
    ok = R.answerable(q, g).groupBy("split").agg(F.count("*").alias("ok"))
    asked = q.groupBy("split").agg(F.count("*").alias("n_asked"))
    return asked.join(ok, "split", "left").select("split", "n_asked", F.coalesce("ok", F.lit(0)).alias("n_answerable"))


_CROP_RANKS = f"""WITH {views.MANIFEST_SQL}, {views.CROPS_SQL},
q AS (SELECT crop_id AS query_id, pdb_ids, {UNIT} AS u FROM crops),
g AS (SELECT render_id, entry, {UNIT} AS u FROM manifest),
uq AS (SELECT u, min(query_id) AS uid FROM q GROUP BY u),
sims AS (SELECT uq.uid, g.entry, list_dot_product(uq.u, g.u) AS s FROM uq CROSS JOIN g),
best AS (SELECT *, row_number() OVER (PARTITION BY uid, entry ORDER BY s DESC) AS n FROM sims),
scores AS (SELECT uid, entry, round(avg(s), 6) AS score FROM best WHERE n <= 5 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, entry) AS rank FROM scores),
coverage AS (SELECT DISTINCT l.query_id AS crop_id, l.pdb_id, r.rank IS NOT NULL AS present, r.rank, r.score, coalesce(sp.split, 'absent') AS corpus_split
  FROM (SELECT query_id, u, unnest(pdb_ids) AS pdb_id FROM q) l JOIN uq ON uq.u = l.u
  LEFT JOIN ranked r ON r.uid = uq.uid AND r.entry = l.pdb_id
  LEFT JOIN (SELECT DISTINCT entry, split FROM manifest) sp ON sp.entry = l.pdb_id)"""


def _coverage(spark, sf):
    crops = views.crops(spark, sf)
    index = sim.build_index(views.manifest(spark, sf))
    return crops, R.source_coverage(index, crops, views.splits(spark, sf), digits=6), index


@query("source_coverage", _CROP_RANKS + " SELECT * REPLACE (CAST(rank AS DOUBLE) AS rank) FROM coverage")
def source_coverage(spark, sf):
    return _coverage(spark, sf)[1].withColumn("rank", F.col("rank").cast("double"))


_SUBSETS = """,
best_rank AS (SELECT c.*, b.best_source_rank FROM crops c LEFT JOIN (SELECT crop_id, min(rank) AS best_source_rank FROM coverage GROUP BY 1) b USING (crop_id)),
flags AS (SELECT *, best_source_rank IS NOT NULL AS cov,
  best_source_rank IS NOT NULL AND mapping_status <> 'panel_candidates' AND NOT list_contains(review_flags, 'rna_only') AS mapped FROM best_rank),
members AS (
  SELECT 'confirmed_single_source_covered' AS subset, best_source_rank AS rank FROM flags WHERE mapped AND mapping_status = 'source_mapped' AND len(pdb_ids) = 1
  UNION ALL SELECT 'source_mapped_or_multiple_depicted_covered', best_source_rank FROM flags WHERE mapped
  UNION ALL SELECT 'all_candidate_covered_exploratory', best_source_rank FROM flags WHERE cov
  UNION ALL SELECT 'all_queries_candidate_hits_including_absent', best_source_rank FROM flags
  UNION ALL SELECT 'new_crops_candidate_covered_exploratory', best_source_rank FROM flags WHERE cov AND legacy_crop_id IS NULL
  UNION ALL SELECT 'previous_crops_candidate_covered', best_source_rank FROM flags WHERE cov AND legacy_crop_id IS NOT NULL)"""


@query("subset_metrics", _CROP_RANKS + _SUBSETS + " SELECT subset, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (rank <= {k}) AS hit_at_{k}, round(count(*) FILTER (rank <= {k}) / count(*), 6) AS r_at_{k}" for k in (1, 5, 10, 20, 50))
    + ", round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mrr, CAST(median(rank) AS DOUBLE) AS median_rank FROM members GROUP BY 1")
def subset_metrics(spark, sf):
    crops, cov, index = _coverage(spark, sf)
    rows = M.subset_memberships(R.best_source_rank(crops.drop("emb"), cov))
    out = M.rank_metrics(rows, rank="best_source_rank", ks=(1, 5, 10, 20, 50), group=["subset"], digits=6, max_rank=index.n_entries)
    return out.drop("mean_rank", "n_ranked")


@query("recomputed_metrics", _CROP_RANKS + _SUBSETS + " SELECT subset, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (rank <= {k}) AS hit_at_{k}" for k in (1, 5, 10, 20, 50))
    + ", round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 9) AS mrr, CAST(0 AS BIGINT) AS n_different FROM members GROUP BY 1")
def recomputed_metrics(spark, sf):
    """Metrics of the report from the stored ranks by exact sums, and how many differ from the report by more than 1e-12."""
    crops, cov, index = _coverage(spark, sf)
    ks = (1, 5, 10, 20, 50)
    rows = stage(M.subset_memberships(R.best_source_rank(crops.drop("emb"), cov)).select("subset", "best_source_rank"), "members")
    report = M.rank_metrics(rows, rank="best_source_rank", ks=ks, group=["subset"], max_rank=index.n_entries)
    again = stage(E.recomputed_metrics(rows, ["subset"], "best_source_rank", ks), "recomputed")
    bad = E.disagreements(report, again, ["subset"], [*[f"r_at_{k}" for k in ks], *[f"hit_at_{k}" for k in ks], "mrr"], 1e-12)
    n_bad = bad.groupBy("subset").agg(F.count(F.lit(1)).alias("n_different"))
    return again.join(n_bad, "subset", "left").select(
        "subset", "n", *[f"hit_at_{k}" for k in ks], F.round("mrr", 9).alias("mrr"), F.coalesce("n_different", F.lit(0)).alias("n_different"))


@query("recomputed_scores", scores_sql(V0_QUERIES, V0_GALLERY, 5) + """
SELECT query_id, entry, score AS recomputed, true AS agrees FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS rank FROM scores) WHERE rank <= 20""")
def recomputed_scores(spark, sf):
    """Top-5 pooled scores of stored hits, once more from the vectors alone, within 2e-6 of what the search stored."""
    q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)
    hits = stage(sim.top_hits(sim.build_index(g), q, k=20, rule="top5", query_id="render_id"), "hits")
    again = E.recomputed_scores(hits, q, g, k=5)
    both = hits.select("query_id", "entry", "score").join(again, ["query_id", "entry"], "left")
    near = F.coalesce(F.abs(F.col("score") - F.col("recomputed")) <= 2e-6, F.lit(False))
    return both.select("query_id", "entry", F.round("recomputed", 6).alias("recomputed"), near.alias("agrees"))


@query("population_counts", _CROP_RANKS + _SUBSETS + """ SELECT count(*) AS n_queries, count(DISTINCT source_id) AS n_source_figures,
 count(*) FILTER (cov) AS n_any_source_present, count(*) FILTER (NOT cov) AS n_no_source_present,
 count(*) FILTER (mapping_status = 'panel_candidates') AS n_accession_unresolved,
 count(*) FILTER (list_contains(review_flags, 'rna_only')) AS n_rna_only_diagnostic FROM flags""")
def population_counts(spark, sf):
    crops, cov, _ = _coverage(spark, sf)
    return M.population_counts(R.best_source_rank(crops.drop("emb"), cov))


@query("rank_theta_equivalence", scores_sql(V0_QUERIES, V0_GALLERY, 5) + RANKS + """
SELECT count(*) AS n_queries, count(*) FILTER (rank <= 20) AS n_listed, CAST(0 AS BIGINT) AS n_different FROM ranks""")
def rank_theta_equivalence(spark, sf):
    """The counted rank of a target equals its place in the ranked list, wherever the list reaches it."""
    q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)
    index = sim.build_index(g)
    counted = sim.entry_ranks(index, q, rule="top5", query_id="render_id", digits=6)
    listed = sim.top_hits(index, q, k=20, rule="top5", query_id="render_id", digits=6).select("query_id", "entry", F.col("rank").alias("place"))
    both = counted.join(listed, ["query_id", "entry"], "left")
    within = F.when(F.col("rank") <= 20, F.col("rank"))
    return both.agg(F.count("*").alias("n_queries"), F.count_if(within.isNotNull()).alias("n_listed"),
                    F.count_if(~within.eqNullSafe(F.col("place"))).alias("n_different"))


@query("ranked_list_integrity", f"""WITH {views.MANIFEST_SQL}
SELECT count(*) AS n_queries, CAST(0 AS BIGINT) AS wrong_length, CAST(0 AS BIGINT) AS repeated_entry, CAST(0 AS BIGINT) AS rank_gap, CAST(0 AS BIGINT) AS wrong_order
FROM manifest WHERE view = 0""")
def ranked_list_integrity(spark, sf):
    q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)
    hits = sim.top_hits(sim.build_index(g), q, k=20, rule="top5", query_id="render_id", digits=6)
    return R.ranked_list_violations(hits, 20)


@query("ranking_regression", f"""WITH {views.MANIFEST_SQL}
SELECT count(*) AS n_queries, count(*) AS matching_source_ranks, count(*) AS matching_top_lists, 0.0::DOUBLE AS max_score_error FROM manifest WHERE view = 0""")
def ranking_regression(spark, sf):
    """Two layouts of the same gallery (whole entries, split entries) must rank alike."""
    q, g = R.same_split(views.manifest(spark, sf), R.VIEW0_QUERY)

    def run(hot_rows):
        index = sim.build_index(g, hot_rows=hot_rows)
        hits = sim.top_hits(index, q, k=20, rule="top5", query_id="render_id", digits=6)
        item = F.struct("rank", "entry", "score")
        return hits.groupBy("query_id").agg(
            F.array_sort(F.collect_list(item)).alias("top"), F.min("score").alias("low")
        ).select("query_id", "top", F.element_at("top", 1)["rank"].alias("best_source_rank"))

    out = M.compare_rankings(run(None), run(2), "query_id")
    return out.withColumn("max_score_error", F.round("max_score_error", 6))


@query("supcon_loss", f"""WITH {views.MANIFEST_SQL},
z AS (SELECT render_id, label, {UNIT} AS u FROM manifest),
p AS (SELECT a.render_id, a.label = b.label AS pos, list_dot_product(a.u, b.u) / 0.07::DOUBLE AS l FROM z a CROSS JOIN z b WHERE a.render_id <> b.render_id),
t AS (SELECT render_id, count(*) FILTER (pos) AS n_pos, ln(sum(exp(l - 1 / 0.07::DOUBLE))) + 1 / 0.07::DOUBLE AS lse, sum(l) FILTER (pos) AS s FROM p GROUP BY 1)
SELECT count(*) AS n_rows, count(*) FILTER (n_pos > 0) AS n_kept, round(avg(-(s - n_pos * lse) / n_pos) FILTER (n_pos > 0), 6) AS loss FROM t""")
def supcon_loss(spark, sf):
    m = views.manifest(spark, sf)
    terms = sim.contrastive_terms(sim.build_index(m, entry="label"), m, label="label")
    return terms.agg(F.count("*").alias("n_rows"), F.count("loss").alias("n_kept"), F.round(F.avg("loss"), 6).alias("loss"))


@query("embedding_contract", """SELECT count(*) AS n_rows, count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS wrong_size,
 count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite,
 count(*) FILTER (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) <= 1e-8) AS zero_norm FROM embeddings""")
def embedding_contract(spark, sf):
    return contracts.vector_violations(views.table(spark, sf, "embeddings"), "embedding", 64)


@query("index_integrity", """SELECT CAST(sum(i) AS BIGINT) AS n_index, CAST(sum(m) AS BIGINT) AS n_manifest, count(*) FILTER (i > 1) AS repeated_in_index,
 count(*) FILTER (i = 0) AS missing_in_index, count(*) FILTER (m = 0) AS unknown_in_index
FROM (SELECT id, count(*) FILTER (side = 'i') AS i, count(*) FILTER (side = 'm') AS m FROM
 (SELECT 'i' AS side, vec_id AS id FROM embeddings UNION ALL SELECT 'm', doc_id FROM documents) GROUP BY 1)""")
def index_integrity(spark, sf):
    """Vectors against the documents they should describe."""
    i = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    m = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return contracts.index_integrity(i, m, "id")


@query("l2_normalise", f"""WITH {views.MANIFEST_SQL}, u AS (SELECT render_id, {UNIT} AS u FROM manifest)
SELECT render_id, round(u[1], 6) AS first, round(u[64], 6) AS last, round(list_dot_product(u, u), 6) AS squared FROM u""")
def l2_normalise(spark, sf):
    u = views.manifest(spark, sf).select("render_id", V.l2_normalise("emb").alias("u"))
    return u.select("render_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"),
                    F.round(V.dot("u", "u"), 6).alias("squared"))


@query("gallery_standardise", f"""WITH {views.MANIFEST_SQL},
x AS (SELECT render_id, view, unnest(range(1, 65)) AS i, unnest(CAST(emb AS DOUBLE[])) AS v FROM manifest),
f AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM x WHERE view BETWEEN 1 AND 15 GROUP BY 1)
SELECT render_id, round(sum((v - mu) / (sd + 1e-6)), 5) AS total, round(max((v - mu) / (sd + 1e-6)), 5) AS top FROM x JOIN f USING (i) GROUP BY 1""")
def gallery_standardise(spark, sf):
    """Standardise every row with mean and spread of the gallery rows only."""
    m = views.manifest(spark, sf)
    fit = V.fit_standardiser(m.where("view between 1 and 15"), "emb")
    z = V.standardise(m, "emb", fit).select("render_id", F.col("emb").alias("z"))
    return z.select("render_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.array_max("z"), 5).alias("top"))


@query("service_index_summary", f"""WITH {views.MANIFEST_SQL}
SELECT count(*) AS images, count(DISTINCT entry) AS pdb_entries, count(DISTINCT (entry, view % 2)) AS objects, max(len(emb)) AS dimensions FROM manifest""")
def service_index_summary(spark, sf):
    m = views.manifest(spark, sf)
    return m.agg(F.count("*").alias("images"), F.count_distinct("entry").alias("pdb_entries"),
                 F.count_distinct("entry", F.col("view") % 2).alias("objects"), F.max(F.size("emb")).cast("bigint").alias("dimensions"))
