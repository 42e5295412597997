"""Ordering, graph, packing, cover, splits, corpus against plain loops."""

import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismatch import contracts
from prismatch.operators import corpus as C
from prismatch.operators import graph as G
from prismatch.operators import labels as L
from prismatch.operators import ordering as O
from prismatch.operators import packing as P
from prismatch.operators import splits as Sp


def test_ordering(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(500), "v": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf)
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).reset_index(drop=True)
    order = [F.col("v").desc(), F.col("id")]
    pos = O.with_position(df, order).toPandas().sort_values("position")
    assert pos.id.tolist() == want.id.tolist() and pos.position.tolist() == list(range(500))
    run = O.with_running_total(df, order, "v", inclusive=False).toPandas().set_index("id").running
    assert run[want.id].tolist() == (want.v.cumsum() - want.v).tolist()
    prev = O.with_previous(df, order, ["id"]).toPandas().set_index("id").prev_id
    assert np.isnan(prev[want.id[0]]) and prev[want.id[1:]].tolist() == want.id[:-1].tolist()


def test_int_quantiles(spark):
    v = np.random.default_rng(1).integers(0, 50_000, 999)
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(999) % 2, "v": v}))
    got = O.int_quantiles(df, "v", {"lo": F.floor((F.col("n") - 1) / 2), "hi": F.floor(F.col("n") / 2)}, ["g"]).toPandas().set_index("g")
    for g in (0, 1):
        s = np.sort(v[g::2])
        assert (got.lo[g], got.hi[g]) == (s[(len(s) - 1) // 2], s[len(s) // 2])


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for e, c in edges:
        a, b = root(first.setdefault(c, e)), root(e)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("small_rows", [G.SMALL_ROWS, 0])
@pytest.mark.parametrize("shape", ["random", "chain", "hub"])
def test_components(spark, monkeypatch, small_rows, shape):
    monkeypatch.setattr(G, "MAX_HOT_KEYS", 20)  # with few rows, so that hot keys exist
    monkeypatch.setattr(G.skew_safe_lookup, "__defaults__", ("inner", None, small_rows))
    rng = np.random.default_rng(5)
    edges = {
        "random": [(int(e), int(c)) for e, c in rng.integers(0, 120, (90, 2))],
        "chain": [(i + d, i) for i in range(60) for d in (0, 1)],
        "hub": [(i, 0) for i in range(50)] + [(i, i + 1) for i in range(40, 90)],
    }[shape]
    df = spark.createDataFrame(edges, "entry long, cluster long")
    nodes = sorted({e for e, _ in edges})
    want = union_find(edges, nodes)
    got = G.components(df).toPandas()
    assert dict(zip(got.entry, got.root)) == want
    size = pd.Series(want).value_counts()
    order = sorted(size.index, key=lambda r: (-size[r], r))
    assert dict(zip(got.entry, got.component)) == {n: order.index(want[n]) for n in nodes}


def test_components_keep_isolated_corpus_entries(spark):
    edges = spark.createDataFrame([("a", 1), ("b", 1), ("x", 1)], "entry string, cluster int")
    corpus = spark.createDataFrame([("a",), ("b",), ("c",)], "entry string")
    got = {r["entry"]: r["root"] for r in G.components(edges, corpus).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def pack_loop(sizes, fractions, relative, seed=None):
    target, got, out = np.array(fractions) * float(sum(sizes)), np.zeros(len(fractions)), []
    rng = np.random.default_rng(seed)
    for s in sizes:
        d = target - got
        if relative:
            d = d / np.maximum(target, 1)
            if seed is not None:
                d = d + rng.random(len(fractions)) * 1e-9
        k = int(np.argmax(d))
        out.append(k)
        got[k] += s
    return out


def pack_runs(sizes, fractions, relative, seed=None):
    sizes = np.array(sizes)
    target, got, out = np.array([fractions]) * float(sizes.sum()), np.zeros((1, len(fractions))), []
    for n, m in zip(*np.unique(-sizes, return_counts=True)):
        o = np.arange(m)
        d = P.Deficits(np.repeat(target, m, 0), np.repeat(got, m, 0), np.full(m, -float(n)), relative)
        split, counts = d.at(o) if seed is None else d.at_jittered(o, o + len(out), seed)
        out += split.tolist()
        got = got + counts[-1:] * -n
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=150), st.sampled_from([(0.8, 0.1, 0.1), (0.5, 0.5), (1 / 3, 1 / 3, 1 / 3), (0.7, 0.2, 0.1)]))
def test_packing_equals_the_loop(sizes, fractions):
    sizes = sorted(sizes, reverse=True)
    for relative, seed in ((False, None), (True, None), (True, 7)):
        assert pack_runs(sizes, fractions, relative, seed) == pack_loop(sizes, fractions, relative, seed)


@pytest.mark.parametrize("relative,seed", [(True, 20260919), (True, None), (False, 3), (False, None)])
def test_pack_on_spark(spark, relative, seed):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"group": [f"g{i:04d}" for i in range(400)], "size": np.minimum(rng.zipf(1.7, 400), 60)})
    got = P.pack(spark.createDataFrame(pdf), relative=relative, seed=seed).toPandas().set_index("group").split
    order = pdf
    if not relative and seed is not None:
        order = pdf.assign(j=np.random.default_rng(seed).random(400)).sort_values(["size", "j"], ascending=[False, True])
    else:
        order = pdf.sort_values(["size", "group"], ascending=[False, True])
    want = pack_loop(order["size"].tolist(), P.FRACTIONS, relative, seed if relative else None)
    assert got[order.group].tolist() == [P.SPLITS[k] for k in want]


def test_stratified_jitter_is_one_stream(spark):
    """Strata share one generator: the jitter of a stratum starts where the one before ended."""
    pdf = pd.DataFrame({"arch": ["a"] * 5 + ["b"] * 7, "h": [f"h{i:02d}" for i in range(12)]})
    got = {r["h"]: r["split"] for r in Sp.grouped_split(spark.createDataFrame(pdf), "h", stratum="arch", seed=4).collect()}
    rng, want = np.random.default_rng(4), {}
    for _, part in pdf.groupby("arch"):
        order = part.assign(j=rng.random(len(part))).sort_values("j")
        want |= dict(zip(order.h, [P.SPLITS[k] for k in pack_loop([1] * len(part), P.FRACTIONS, False)]))
    assert got == want


def test_random_split_equals_numpy(spark):
    got = Sp.random_split(spark.range(1000), "id", seed=0).toPandas().sort_values("id").split.tolist()
    u = np.random.default_rng(0).random(1000)
    assert got == np.where(u < 0.8, "train", np.where(u < 0.9, "val", "test")).tolist()


def test_leak_is_refused(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "test")], "cluster int, split string")
    with pytest.raises(contracts.ContractError):
        Sp.assert_no_leak(rows, "cluster", "split")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 9)), min_size=1, max_size=40), st.integers(0, 99))
def test_set_cover_equals_the_loop(spark, pairs, seed):
    rng = np.random.default_rng(seed)
    res = {e: (None if rng.random() < 0.3 else float(rng.integers(1, 4))) for e in {e for e, _ in pairs}}
    held = {}
    for e, c in pairs:
        held.setdefault(e, set()).add(c)
    covered, kept = set(), set()
    for e in sorted(held, key=lambda e: (res[e] or 10_000.0, e)):
        if held[e] - covered:
            kept.add(e)
            covered |= held[e]
    edges = spark.createDataFrame(pairs, "entry int, cluster int")
    got = C.set_cover(edges, spark.createDataFrame(list(res.items()), "entry int, resolution double"))
    assert {r["entry"] for r in got.collect()} == kept


def test_shards_resume_and_parts(spark):
    objs = spark.createDataFrame([(f"o{i}", i * 7 % 11) for i in range(11)], "object_id string, atoms int")
    dealt = C.deal_shards(objs, 3).toPandas().sort_values(["shard", "job_order"])
    for shard, part in dealt.groupby("shard"):
        assert part.atoms.tolist() == [a for a in range(10, -1, -1) if a % 3 == shard]
    tried = spark.createDataFrame([("o0", v) for v in range(4)] + [("o1", 0)], "object_id string, view int")
    left = {r["object_id"] for r in C.pending(objs, tried, 4).collect()}
    assert "o0" not in left and "o1" in left
    files = spark.createDataFrame([("/r/shard_001_p00.tar",), ("/r/shard_001_p02.tar",), ("/r/shard_002_p00.tar",)], "path string")
    assert {r["shard"]: r["next_part"] for r in C.next_part(files).collect()} == {"shard_001": 3, "shard_002": 1}


def test_even_spacing_matches_linspace(spark):
    for n in (16, 17, 100, 357):
        got = sorted(r["id"] for r in C.evenly_spaced(spark.range(n), [F.col("id")], 16).collect())
        assert got == sorted(set(np.linspace(0, n - 1, 16, dtype=int).tolist()))


def test_label_map_and_weights(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",)], "y string")
    m = L.label_map(train, "y")
    coded = L.encode_labels(spark.createDataFrame([("a",), ("z",)], "y string"), m, "y", "code")
    assert {r["y"]: r["code"] for r in coded.collect()} == {"a": 0, "z": -100}
    w = {r["y"]: r["weight"] for r in L.balanced_weights(L.class_counts(train.where("y = 'a'"), m, "y")).collect()}
    assert w == {"a": 0.5, "b": 1.0}


def test_frames_and_contracts(spark):
    r = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1)], "domain_id int, view int")
    lab = spark.createDataFrame([(1, "x"), (2, "y")], "domain_id int, cath_arch string")
    sp = spark.createDataFrame([(1, "train"), (2, "val")], "domain_id int, split_homsf string")
    f = L.frames(r, lab, sp, "split_homsf")
    assert (f["train"].count(), f["val"].count(), f["test"].count()) == (2, 1, 0)
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(r, lab.unionByName(lab), ["domain_id"])
    with pytest.raises(contracts.ContractError):
        contracts.aligned(lab, spark.createDataFrame([(3,)], "domain_id int"), "domain_id")
    with pytest.raises(contracts.ContractError):
        contracts.assert_vectors(spark.createDataFrame([([0.0, 0.0],)], "v array<double>"), "v", 2)
    contracts.assert_same_keys(lab, sp, ["domain_id"])
    with pytest.raises(contracts.ContractError):
        contracts.assert_disjoint(lab, sp, ["domain_id"])


def test_earlier_max_across_partitions(spark):
    """One key fills most partitions."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": range(300), "k": np.where(np.arange(300) < 250, 1, np.arange(300) % 9), "v": rng.integers(0, 1000, 300)})
    got = O.with_earlier_max(spark.createDataFrame(pdf), ["k"], [F.col("id")], "v").toPandas().set_index("id").earlier_max
    want = pdf.groupby("k").v.transform(lambda s: s.cummax().shift())
    assert got.sort_index().fillna(-1).tolist() == want.fillna(-1).tolist()


def test_every_domain_gets_its_row(spark):
    """Missing codes leave the schemes that need them open, not the domain out."""
    rows = [("a", 1, 1, 1, 1), ("b", 1, 1, None, 2), ("c", None, None, 3, None), ("d", 1, None, None, None), ("e", 2, 2, 1, 1)]
    df = spark.createDataFrame(rows, "domain_id string, cath_arch int, cath_topo int, cath_homsf int, S35 int")
    out = {r.domain_id: r for r in Sp.build_all(df).collect()}
    assert set(out) == {"a", "b", "c", "d", "e"} and all(r.split_random for r in out.values())
    assert out["b"].split_homsf is None and out["c"].split_topo is None and out["c"].split_homsf is not None
    assert out["d"].split_member is None and out["a"].split_member is not None


def test_settled_results_leave_nothing_else(spark, tmp_path, monkeypatch):
    from prismatch import session

    monkeypatch.setattr(session, "staging_root", lambda _: f"file://{tmp_path}")

    def build():
        a = session.stage(spark.range(5), "a")
        b = session.settled(spark, lambda: session.stage(a.withColumn("x", F.col("id") * 2), "b").where("x > 2"), "c")
        assert len(os.listdir(tmp_path)) == 2
        return b.join(a, "id")

    out = session.settled(spark, build, "kept")
    assert len(os.listdir(tmp_path)) == 1 and out.count() == 3
    with pytest.raises(ZeroDivisionError):
        session.settled(spark, lambda: session.stage(spark.range(3)) and 1 / 0)
    assert len(os.listdir(tmp_path)) == 1
