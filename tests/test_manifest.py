"""Reuse by chunk and the domain manifest."""

import pytest
from pyspark.sql import functions as F

from prismatch.contracts import ContractError
from prismatch.functions import text as X
from prismatch.functions import vectors as V
from prismatch.operators import chunk_cache as CC
from prismatch.operators import manifest
from prismatch.operators.manifest import domain_manifest, missing_ids

SCHEMA = "id bigint, chunk bigint, x double, note string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(n):
    return [(i, i // 50, float(i % 7), None if i % 5 == 0 else f"n{i}") for i in range(n)]


def double(seen):
    def compute(rows):
        got = rows.count()
        seen.append(got)
        return rows.withColumn("y", F.col("x") * 2)

    return compute


RULE = {"chunk": "chunk", "columns": ["id", "x", "note"], "config": "v1"}


def plain(df):
    return sorted((r.id, r.chunk, r.x, r.y) for r in df.collect())


def test_only_changed_chunks_are_computed(spark, tmp_path):
    path, seen, rows = str(tmp_path / "c"), [], rows_of(1000)
    CC.cached_chunks(table(spark, rows), double(seen), path, **RULE)
    again = CC.cached_chunks(table(spark, rows[::-1]).repartition(3), double(seen), path, **RULE)
    assert seen == [1000, 0] and plain(again.result) == [(i, c, x, x * 2) for i, c, x, _ in rows]
    assert {r.state for r in again.chunks.collect()} == {"reused"}
    # a null becomes text, two equal rows swap nothing, a chunk goes, rows come
    changed = [(i, c, x, "new" if i == 305 else t) for i, c, x, t in rows if c != 2] + [(2000, 40, 1.0, None)]
    third = CC.cached_chunks(table(spark, changed), double(seen), path, **RULE)
    assert seen[-1] == 51 and plain(third.result) == sorted((i, c, x, x * 2) for i, c, x, _ in changed)
    assert sorted(r.chunk for r in third.chunks.where("state = 'computed'").collect()) == [6, 40]
    assert plain(CC.read_chunks(spark, path)) == plain(third.result)
    other = CC.cached_chunks(table(spark, changed), double(seen), path, **{**RULE, "config": "v2"})
    assert seen[-1] == len(changed) and plain(other.result) == plain(third.result)


def test_repeated_rows_null_chunks_and_empty_tables(spark, tmp_path):
    path, seen = str(tmp_path / "c"), []
    twice = [(1, None, 1.0, "a"), (1, None, 1.0, "a"), (None, 1, None, None)]
    CC.cached_chunks(table(spark, twice), double(seen), path, **RULE)
    once = CC.cached_chunks(table(spark, twice[1:]), double(seen), path, **RULE)
    assert seen == [3, 1] and once.result.count() == 2
    none = CC.cached_chunks(table(spark, []), double(seen), path, **RULE)
    assert none.result.count() == 0 and none.result.columns == once.result.columns
    with pytest.raises(ContractError):
        CC.read_chunks(spark, str(tmp_path / "nothing"))


def test_a_failed_run_leaves_the_last_manifest(spark, tmp_path):
    path, seen, rows = str(tmp_path / "c"), [], rows_of(200)
    CC.cached_chunks(table(spark, rows), double(seen), path, **RULE)
    changed = table(spark, [(i, c, x + (i == 3), t) for i, c, x, t in rows])
    with pytest.raises(Exception, match="broken"):
        CC.cached_chunks(changed, lambda r: r.withColumn("y", F.raise_error(F.lit("broken")).cast("double")), path, **RULE)
    assert plain(CC.read_chunks(spark, path)) == [(i, c, x, x * 2) for i, c, x, _ in rows]
    assert CC.cached_chunks(changed, double(seen), path, **RULE).result.count() == 200 and seen == [200, 50]


def test_stored_vectors_are_compared_before_reuse(spark):
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    CC.agreement(old, old.withColumn("v", F.transform("v", lambda x: x * 3)), "id", "v", V.cosine, 0.9999)
    with pytest.raises(ContractError):
        CC.agreement(old, old.withColumn("v", F.reverse("v")), "id", "v", V.cosine, 0.9999)


def test_domain_manifest(spark):
    domains = spark.createDataFrame(
        [("1oaiA00", 1, 10, 8, 10, 1.0), ("2abcB12", 2, 20, 30, 40, 999.0), ("3xyzC01", 1, 10, 9, 1, None), ("9zzz", 1, 1, 1, 1, 2.0)],
        "domain_id string, C int, A int, T int, H int, resolution float")
    ids = spark.createDataFrame([("1oaiA00",), ("1oaiA00",), ("2abcB12",), ("9zzz",), ("absent0",)], "id string")
    names = spark.createDataFrame([("1", "alpha"), ("1.10", "bundle"), ("2.20.30.40", "fold")], "node string, label string")
    files = spark.createDataFrame([("1oaiA00",), ("2abcB12",), ("2abcB12",)], "id string")
    got = {r.domain_id: r for r in domain_manifest(domains, ids, names, files, "s40", "/d/").collect()}
    assert set(got) == {"1oaiA00", "2abcB12"}
    a, b = got["1oaiA00"], got["2abcB12"]
    assert (a.pdb_id, a.chain, a.domain_idx, a.cath_class_name, a.cath_arch_name, a.cath_topo_name) == ("1oai", "A", 0, "alpha", "bundle", None)
    assert (b.domain_idx, b.resolution, b.is_nmr_or_unknown_res, b.cath_homsf_name) == (12, None, True, "fold")
    assert (a.pdb_path, a.has_pdb, a.nr_level) == ("/d/1oaiA00", True, "S40")
    loose = domain_manifest(domains, ids, names, None, "S40", "/d", require_file=False)
    assert loose.count() == 3 and loose.where("has_pdb").count() == 0 and loose.where("domain_id = '9zzz'").first().domain_idx is None
    assert [r.id for r in missing_ids(domains, ids).collect()] == ["absent0"]
    link = spark.createDataFrame([("1abc",)], "e string").select(*X.hit_links("e")).first()
    assert tuple(link) == ("1ABC", "https://www.rcsb.org/structure/1ABC", "https://cdn.rcsb.org/images/structures/1abc_assembly-1.jpeg")


def test_domain_manifest_names_classes_once(spark, monkeypatch):
    """However many levels have names, a split lookup reads the domains for a few joins, not again for each level's parts."""
    lookup = manifest.skew_safe_lookup
    monkeypatch.setattr(manifest, "skew_safe_lookup", lambda *a, **k: lookup(*a, **{**k, "small_rows": 0}))
    domains = spark.createDataFrame(
        [(f"{i:04d}A00", c, a, i % 3, 1, 2.0) for i, (c, a) in enumerate([(1, 3), (1, None), (None, 1), (2, 3)] * 5)], "domain_id string, C int, A int, T int, H int, resolution float")
    ids = domains.select(F.col("domain_id").alias("id"))
    names = spark.createDataFrame([("1", "one"), ("1.3", "bundle"), ("2.3.0", "fold"), (None, "none")], "node string, label string")
    got = manifest.domain_manifest(domains, ids, names, ids, "s40", "d")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") < 20
    for r in got.collect():
        i = int(r.domain_id[:4])
        codes = [str(x) for x in ([(1, 3), (1, None), (None, 1), (2, 3)][i % 4] + (i % 3, 1))]
        want = [".".join(x for x in codes[: k + 1] if x != "None") for k in range(4)]
        assert [r.cath_class, r.cath_arch, r.cath_topo, r.cath_homsf] == want
        assert [r.cath_class_name, r.cath_arch_name, r.cath_topo_name] == [{"1": "one", "1.3": "bundle", "2.3.0": "fold"}.get(w) for w in want[:3]]
    assert got.count() == 20
