"""Samples, order statistics, exact sums, canonical JSON."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatch.functions import canonical as C
from prismatch.operators import exact as E
from prismatch.operators import selection as S


@pytest.mark.parametrize("k", [0, 1, 37, 300, 5000])
def test_bottom_k_is_the_same_under_every_partitioning(spark, k):
    rows = spark.range(1000).withColumn("x", F.col("id") % 7)
    number = lambda i: int(hashlib.sha256(f"3:{i}".encode()).hexdigest()[:15], 16)
    want = sorted(sorted(range(1000), key=number)[:k])
    for parts in (1, 13):
        assert sorted(r.id for r in S.bottom_k(rows.repartition(parts), k, ["id"], 3).collect()) == want
    by = {"0": 5, "3": 10**6, "6": 1}
    got = S.bottom_k(rows, by, ["id"], 3, by="x").groupBy("x").count().collect()
    assert {r["x"]: r["count"] for r in got} == {0: 5, 3: 143, 6: 1}


def test_bottom_k_with_ties(spark):
    """Rows that share their keys share their number; the size is exact all the same."""
    rows = spark.createDataFrame([(1, i, None) for i in range(50)] + [(2, i, "x") for i in range(3)], "k int, v int, number string")
    for k in (1, 20, 51, 53, 60):
        a, b = (sorted(tuple(r) for r in S.bottom_k(rows.repartition(p), k, ["k"], 1).collect()) for p in (1, 5))
        assert len(a) == min(k, 53) and a == b and len(a[0]) == 3
    assert S.bottom_k(rows.limit(0), 5, ["k"], 1).count() == 0


def test_values_at_places(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=400), rng.normal(size=100) * 1e-300, [0.0, -0.0, np.inf, -np.inf, 5e-324, 1.7e308], np.full(300, 2.5)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "v double").repartition(5)
    places = [0, 1, 200, 402, 500, 700, len(x) - 1]
    assert S.values_at(df, "v", places) == np.sort(x)[places].tolist()
    assert S.values_at(df, "v", []) == []


def test_exact_sums_do_not_depend_on_order(spark):
    rng = random.Random(4)
    groups = {
        "wide": [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(500)],
        "cancel": [1e16, 1.0, -1e16, 1e-8] * 50,
        "small": [5e-324] * 9 + [2.0**-1060],
        "near": [0.1] * 1000,
        "large": [1.7e308, -1.7e308, 1.0, 8e307],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("zero", 0.0), ("wild", math.inf), ("wild", 1.0)]
    want = {k: math.fsum(vs) for k, vs in groups.items()} | {"none": 0.0, "zero": 0.0, "wild": math.inf}
    for parts in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
        assert {r.k: r.s for r in E.exact_sum(df, ["k"], "v", "s").collect()} == want


def test_disagreements(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0), (3, 0.0, 0.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0 + 1e-13, None), (2, 2.1, None), (4, 0.0, 0.0)], "k int, x double, y double")
    got = {(r.k, r.column) for r in E.disagreements(a, b, ["k"], ["x", "y"], 1e-12).collect()}
    assert got == {(2, "x"), (2, "y"), (3, "x"), (3, "y"), (4, "x"), (4, "y")}


def test_canonical_json_equals_sorted_dumps(spark):
    value = {"b": 1, "a": {"z": [1, 2, None], "y": None}, "t": 'q"\\\né', "m": {"k2": 0.5, "k1": -3.25}, "f": True, "e": [], "n": None}
    ddl = {"b": "b bigint", "a": "a struct<z:array<int>,y:string>", "t": "t string", "m": "m map<string,double>", "f": "f boolean", "e": "e array<struct<x:int>>", "n": "n date"}
    seen = set()
    for order in (list(ddl), list(ddl)[::-1], sorted(ddl)):
        df = spark.createDataFrame([tuple(value[c] for c in order)], ", ".join(ddl[c] for c in order))
        whole = F.struct(*order)
        kind = df.select(whole.alias("x")).schema["x"].dataType
        row = df.select(C.canonical_json(whole, kind).alias("j"), C.fingerprint(df, order).alias("p")).first()
        assert row.j == json.dumps(value, sort_keys=True, ensure_ascii=False)
        assert row.p == hashlib.sha256(row.j.encode()).hexdigest()[:16]
        seen.add(row.p)
    assert len(seen) == 1


def test_recomputed_scores_meet_in_squares(spark, monkeypatch):
    """Copies, a query in many squares, and no row for a pair of vectors."""
    monkeypatch.setattr(E, "SIDE", 3)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(30, 6)).astype(np.float32)
    v[3:9], v[20] = v[2], 0
    gallery = spark.createDataFrame([(i, f"E{i % 2}", v[i].tolist()) for i in range(30)], "render_id long, entry string, emb array<float>")
    queries = gallery.where("render_id % 3 = 0")
    hits = queries.crossJoin(spark.createDataFrame([("E0",), ("E1",), ("gone",)], "name string")).select(F.col("render_id").alias("query_id"), F.col("name").alias("entry"))
    out = E.recomputed_scores(hits, queries, gallery, k=5)
    assert "arrays_zip" not in out._jdf.queryExecution().toString()
    x = v.astype(float)
    size = [max(math.sqrt(math.fsum(a * a)), 1e-12) for a in x]
    want = {}
    for q in range(0, 30, 3):
        for e in range(2):
            best = sorted((math.fsum(x[q] * x[i]) / (size[q] * size[i]) for i in range(e, 30, 2)), reverse=True)[:5]
            want[q, f"E{e}"] = math.fsum(best) / 5
    assert {(r.query_id, r.entry): r.recomputed for r in out.collect()} == want
