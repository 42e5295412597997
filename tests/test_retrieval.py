"""Tile search against plain numpy, on every layout."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismatch.operators import metrics as M
from prismatch.operators import retrieval as R
from prismatch.operators import similarity as S

RNG = np.random.default_rng(3)


def toy(n=240, d=8, entries=17, hot=90):
    """Rows of which one entry holds more than a third."""
    e = np.where(np.arange(n) < hot, "E00", [f"E{i:02d}" for i in RNG.integers(0, entries, n)])
    x = RNG.normal(size=(n, d)).astype(np.float32)
    return pd.DataFrame({"render_id": np.arange(n), "entry": e, "view": np.arange(n) % 6, "emb": [v.tolist() for v in x]})


def brute(rows, k, ties="alphabetical", own=False, digits=6):
    q, g = rows[rows.view == 0], rows[rows.view > 0] if not own else rows
    unit = lambda f: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.array(f.emb.tolist(), dtype=np.float32).astype(float))
    sim = unit(q) @ unit(g).T
    if own:
        sim[q.render_id.to_numpy()[:, None] == g.render_id.to_numpy()[None]] = -np.inf
    names = sorted(set(g.entry))
    pooled = []
    for n in names:
        top = np.sort(sim[:, (g.entry == n).to_numpy()], axis=1)[:, ::-1][:, :k]
        pooled.append(np.array([t[np.isfinite(t)].mean() for t in top]))
    scores = np.stack(pooled, 1)
    scores = scores if digits is None else np.round(scores, digits)
    ranks, lists = {}, {}
    for i, (qid, e) in enumerate(zip(q.render_id, q.entry)):
        order = np.argsort(-scores[i], kind="stable")
        lists[qid] = [(names[j], scores[i, j]) for j in order]
        if e in names:
            j = names.index(e)
            ranks[qid] = 1 + int((scores[i] > scores[i, j]).sum()) if ties == "optimistic" else [n for n, _ in lists[qid]].index(e) + 1
    return ranks, lists


LAYOUTS = {"whole": {}, "split": {"hot_rows": 7}, "many blocks": {"block_rows": 16, "hot_rows": 5}}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("parts", [False, True])
@pytest.mark.parametrize("rule", ["max", "top5"])
def test_ranks_and_hits_match_numpy(spark, monkeypatch, layout, parts, rule):
    if parts:
        monkeypatch.setattr(S, "HELD_ROWS", 8)  # tasks merge what they hold again and again
    size = 9 * (4 * 8 + 64) if parts else S.BROADCAST_BYTES
    rows = toy()
    df = spark.createDataFrame(rows)
    index = S.build_index(df.where("view > 0"), **LAYOUTS[layout])
    q = df.where("view = 0")
    want, lists = brute(rows, S.RULES[rule])
    got = S.entry_ranks(index, q, rule=rule, query_id="render_id", digits=6, broadcast_bytes=size).toPandas()
    assert dict(zip(got.query_id, got["rank"])) == want
    hits = S.top_hits(index, q, k=5, rule=rule, query_id="render_id", digits=6, broadcast_bytes=size).toPandas().sort_values(["query_id", "rank"])
    for qid, part in hits.groupby("query_id"):
        assert list(zip(part.entry, part.score)) == lists[qid][:5]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("rule", list(S.RULES))
@pytest.mark.parametrize("ties", ["alphabetical", "optimistic"])
def test_unrounded_ranks(spark, layout, rule, ties):
    """Ranks of exact scores; with every entry twice, the twin adds one place for each better entry."""
    rows = toy()
    df = spark.createDataFrame(rows)
    q = df.where("view = 0")
    want = brute(rows, S.RULES[rule], ties, digits=None)[0]
    gallery = df.where("view > 0")
    once = S.entry_ranks(S.build_index(gallery, **LAYOUTS[layout]), q, rule=rule, ties=ties, query_id="render_id").toPandas()
    assert dict(zip(once.query_id, once["rank"])) == want
    twins = gallery.unionByName(gallery.withColumn("entry", F.concat("entry", F.lit("x"))).withColumn("render_id", F.col("render_id") + 1000))
    twice = S.entry_ranks(S.build_index(twins, **LAYOUTS[layout]), q, rule=rule, ties=ties, query_id="render_id").toPandas()
    assert dict(zip(twice.query_id, twice["rank"])) == {i: 2 * r - 1 for i, r in want.items()}


def test_optimistic_ties_and_self_exclusion(spark):
    rows = toy()
    rows["emb"] = [[1.0, float(i % 3), 0.0] for i in range(len(rows))]  # many exact ties
    df = spark.createDataFrame(rows)
    for layout in LAYOUTS.values():
        index = S.build_index(df, **layout)
        for ties in ("alphabetical", "optimistic"):
            got = S.entry_ranks(index, df.where("view = 0"), rule="top3", ties=ties, query_id="render_id", digits=6, exclude_self=True).toPandas()
            assert dict(zip(got.query_id, got["rank"])) == brute(rows, 3, ties, own=True)[0]


def test_pooling_fixture(spark):
    """Ragged groups: entry 1 has one view, entry 2 three; positive and negative similarities."""
    sim = [[0.9, 0.5, 0.7, 0.1, 0.8, 0.3], [-0.2, -0.4, -0.9, -0.7, -0.6, -0.8]]
    groups = [0, 0, 1, 2, 2, 2]
    block = object.__new__(S._Block)
    block.starts, block.ends = np.array([0, 2, 3]), np.array([2, 3, 6])
    for rule, want in {"max": [[0.9, 0.7, 0.8], [-0.2, -0.9, -0.6]], "top3": [[0.7, 0.7, 0.4], [-0.3, -0.9, -0.7]], "top5": [[0.7, 0.7, 0.4], [-0.3, -0.9, -0.7]]}.items():
        np.testing.assert_allclose(S._pool(np.array(sim), block, S.RULES[rule]), want)
    assert len(groups) == 6
    with pytest.raises(ValueError):
        S.rule_width("top4")


def test_saved_index(spark, tmp_path):
    df = spark.createDataFrame(toy())
    made = S.build_index(df, hot_rows=20, path=str(tmp_path / "index"))
    opened = S.open_index(spark, str(tmp_path / "index"))
    assert (opened.dim, opened.n_rows, opened.n_entries, opened.n_blocks, opened.has_split) == (8, 240, made.n_entries, made.n_blocks, True)
    a, b = (S.top_hits(i, df.where("view = 0"), k=3, query_id="render_id", digits=6).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True) for i in (made, opened))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("median,value", [("interpolated", 4.0), ("lower", 3.0)])
@pytest.mark.parametrize("bound", [None, 100])
def test_rank_metrics(spark, median, value, bound):
    ranks = spark.createDataFrame([(1,), (3,), (5,), (9000,), (None,)], "rank int")
    row = M.rank_metrics(ranks, ks=(1, 5), median=median, max_rank=bound).first()
    assert row["median_rank"] == value
    assert (row["n"], row["n_ranked"], row["hit_at_5"], row["r_at_1"]) == (5, 4, 3, 0.2)
    assert row["mrr"] == pytest.approx((1 + 1 / 3 + 1 / 5 + 1 / 9000) / 5)
    empty = M.rank_metrics(ranks.where("false"), ks=(1,), max_rank=bound).first()
    assert empty["r_at_1"] is None and empty["median_rank"] is None


def test_empty_entries_take_the_last_ranks(spark):
    rows = toy(60, 4, 5, 10)
    df = spark.createDataFrame(rows)
    extra = spark.createDataFrame([("E98",), ("E99",)], "entry string")
    index = S.build_index(df.where("view > 0"))
    q = df.where("view = 0").withColumn("entry", F.lit("E99"))
    got = R.ranks_with_empty_entries(index, q, df.select("entry").unionByName(extra), rule="max").toPandas()
    assert (got["rank"] == index.n_entries + 2).all() and len(got) == (rows.view == 0).sum()


def test_supcon_matches_numpy(spark):
    rows = toy(50, 5, 4, 20)
    x = np.array(rows.emb.tolist(), dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T / 0.07
    np.fill_diagonal(s, -np.inf)
    same = (rows.entry.to_numpy()[:, None] == rows.entry.to_numpy()[None]) & ~np.eye(50, dtype=bool)
    lse = np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1)
    want = np.array([-(s[i][same[i]] - lse[i]).mean() if same[i].any() else np.nan for i in range(50)])
    df = spark.createDataFrame(rows)
    got = S.contrastive_terms(S.build_index(df, block_rows=16, hot_rows=4), df).toPandas().sort_values("query_id")
    np.testing.assert_allclose(got.loss.to_numpy(float), want, atol=1e-9)


def test_broken_ranked_lists_are_counted(spark):
    good = [("q", r, f"E{r}", 1.0 - r / 10) for r in range(1, 4)]
    bad = [("p", 1, "A", 0.1), ("p", 2, "B", 0.9), ("p", 3, "B", 0.05)]
    row = R.ranked_list_violations(spark.createDataFrame(good + bad, "query_id string, rank int, entry string, score double"), 3).first()
    assert (row["n_queries"], row["wrong_length"], row["repeated_entry"], row["rank_gap"], row["wrong_order"]) == (2, 0, 1, 0, 1)


def test_rule_selection_prefers_simpler_rule(spark):
    rows = spark.createDataFrame([("max", 0.5, 0.6), ("top3", 0.5, 0.6), ("top5", 0.4, 0.9)], "rule string, r_at_1 double, mrr double")
    assert M.select_rule(rows, list(S.RULES)).first()["rule"] == "max"


def test_macro_f1_over_both_label_sets(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (-100, 0), (1, 2)], "t int, p int")
    row = M.accuracy_macro_f1(rows, "t", "p").first()
    assert (row["n"], row["n_labels"], row["accuracy"]) == (4, 3, 0.5)
    assert row["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_crops_of_equal_vectors_are_one_query(spark, monkeypatch):
    """Forty crops share two vectors; the search is asked for the two, and rows are as when each crop asks alone."""
    rng = np.random.default_rng(8)
    rows = [(i, f"E{i % 5}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(40)]
    index = S.build_index(spark.createDataFrame(rows, "render_id long, entry string, emb array<float>"))
    pair = [r[2] for r in rows[:2]]
    crops = spark.createDataFrame([(i, pair[i % 2], [f"e{i % 5}", "E9"]) for i in range(40)], "crop_id long, emb array<float>, pdb_ids array<string>")
    splits = spark.createDataFrame([(f"E{i}", "train") for i in range(5)], "pdb_id string, split string")
    asked, ranks = [], S.entry_ranks

    def seen(index, queries, **more):
        asked.append(queries.select(more["query_id"]).distinct().count())
        return ranks(index, queries, **more)

    want = {(r.query_id, r.entry): (r.rank, r.score) for r in ranks(index, crops.selectExpr("crop_id query_id", "emb", "upper(pdb_ids[0]) entry")).collect()}
    monkeypatch.setattr(S, "entry_ranks", seen)
    got = R.source_coverage(index, crops, splits).collect()
    assert asked == [2] and len(got) == 80
    assert {(r.crop_id, r.pdb_id): (r["rank"], r.score) for r in got if r.present} == want


def test_result_rows_are_formed_for_a_bounded_number_of_queries(monkeypatch):
    monkeypatch.setattr(S, "KERNEL_QUERIES", 4)
    shared = SimpleNamespace(value=pa.table({"query_id": list(range(9, -1, -1)), "vector": [[float(i), 1.0] for i in range(10)]}))
    block = pa.record_batch([pa.array([["a", "b"]]), pa.array([[1, 2]]), pa.array([[True, True]]), pa.array([np.eye(2, dtype=np.float32).tobytes()])],
                            names=["entries", "images", "whole", "matrix"])
    seen = []
    list(S._scanner(shared, 2, True, lambda q, b: seen.append(q.ids.tolist()), None)(iter([block])))
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def _kernel(monkeypatch, call):
    """The kernel that a search hands to its tasks."""
    kept, run = [], S._run
    monkeypatch.setattr(S, "_run", lambda index, queries, kernel, *more: kept.append(kernel) or run(index, queries, kernel, *more))
    call()
    return kept[-1]


def test_only_near_ties_are_compared_exactly(spark, monkeypatch):
    """Single precision decides what it can; vectors closer than it tells apart still get their exact order."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 8))
    m[20:40] = m[:20] + rng.normal(size=(20, 8)) * 1e-7
    m[40:50] = m[:10]
    m = m.astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"render_id": range(60), "entry": [f"E{i:02d}" for i in range(60)], "emb": [[float(x) for x in v] for v in m]}), "render_id long, entry string, emb array<float>")
    index = S.build_index(df, entry="render_id")
    kernel = _kernel(monkeypatch, lambda: S.top_hits(index, df, k=10, rule="max", query_id="render_id", exclude_self=True))
    row = {"entries": pa.array(range(60)), "images": pa.array(range(60)), "whole": pa.array([True] * 60), "matrix": m.tobytes()}
    block = S._Block(row, 8, True)
    asked = S._Queries(pa.table({"query_id": list(range(60)), "vector": m.tolist()}), 8, True)
    exact = asked.vectors.dot(block.vectors)
    np.fill_diagonal(exact, -np.inf)
    monkeypatch.setattr(S._Exact, "dot", None)
    got = kernel(asked, block).to_pandas()
    for i, own in got.groupby("query_id"):
        order = sorted(range(60), key=lambda j: (-exact[i, j], j))[:10]
        assert own.entry.tolist() == order and own.value.tolist() == own.cosine.tolist() == [exact[i, j] for j in order]


def test_coverage_searches_once_and_entries_of_half_a_block_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 4 * 3 * 100)  # a block of 100 images
    rng = np.random.default_rng(6)
    gallery = pd.DataFrame({"render_id": range(160), "entry": ["A"] * 45 + ["B"] * 48 + [f"C{i}" for i in range(67)], "emb": rng.normal(size=(160, 3)).tolist()})
    index = S.build_index(spark.createDataFrame(gallery, "render_id long, entry string, emb array<float>"))
    assert not index.has_split
    crops = spark.createDataFrame([(i, gallery.emb[i], ["A", "B", f"C{i}", "none"]) for i in range(40)], "crop_id long, emb array<float>, pdb_ids array<string>")
    splits = spark.createDataFrame([("A", "train"), ("B", "test")], "pdb_id string, split string")
    out = R.source_coverage(index, crops, splits)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # the search itself is done and kept
    u = np.array(gallery.emb.tolist(), np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {}
    for i in range(40):
        scores = {e: np.sort(u[own.index] @ u[i])[::-1][:5].mean() for e, own in gallery.groupby("entry")}
        ranked = sorted(scores, key=lambda e: (-scores[e], e))
        want |= {(i, e): ranked.index(e) + 1 if e in scores else None for e in ("A", "B", f"C{i}".upper(), "none".upper())}
    assert {(r.crop_id, r.pdb_id): r["rank"] for r in out.collect()} == want
