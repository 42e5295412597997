"""Sources, sinks, admission, streams, catalogue."""

import io
import json
import math
import os
import tarfile
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prismatch.contracts import ContractError
from prismatch.plans import catalogue
from prismatch.sources import archives as A
from prismatch.sources import records as Rec
from prismatch.sources import sinks as K
from prismatch.sources import text as T
from prismatch.streaming import admission as Adm


def lines(spark, text):
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line_no int, line string")


def test_text_formats(spark, tmp_path):
    (tmp_path / "domains.txt").write_text("# head\n1oaiA00 1 10 8 10 1 1 1 1 1 59 1.000\n\n2abcB01 3 40 50 7 2 1 1 1 3 120 999.000\n")
    d = T.read_domain_list(spark, str(tmp_path / "domains.txt")).collect()
    assert [(r["domain_id"], r["T"], r["resolution"]) for r in d] == [("1oaiA00", 8, 1.0), ("2abcB01", 50, 999.0)]
    names = T.parse_names(spark.createDataFrame([("# x",), ("3.40.50  1abcA00  :Rossmann fold",), ("",)], "value string")).collect()
    assert [tuple(r) for r in names] == [("3.40.50", "Rossmann fold")]
    (tmp_path / "clusters.txt").write_text("1ABC_1 2DEF_2\n\n1ABC_3 1abc_4 3GHI_1\n")
    got = T.read_clusters(spark, str(tmp_path / "clusters.txt"))
    assert sorted(map(tuple, got.select("cluster", "entry").collect())) == [(0, "1abc"), (0, "2def"), (2, "1abc"), (2, "3ghi")]
    counts = T.cluster_counts(lines(spark, "1ABC_1 2DEF_2\n\n3GHI_1")).first()
    assert tuple(counts) == (3, 2, 3)
    res = T.parse_resolution(lines(spark, "head\n100D    ;       1.90\n101D ; -1.00\n100d;2.5\nLONGID ; 1\n102D ; x"))
    assert [tuple(r) for r in res.collect()] == [("100d", 2.5)]
    ids = T.parse_json_ids(spark.createDataFrame([('["1ABC","1abc","2DEF"]',)], "value string"))
    assert sorted(r["id"] for r in ids.collect()) == ["1abc", "2def"]
    recs = T.split_records(spark.createDataFrame([("f", "skip\ndata_A\nx\ndata_B\ny")], "k string, v string"), "k", "v").collect()
    assert [(r["record_no"], r["name"]) for r in recs] == [(1, "A"), (2, "B")]


ATOMS = [
    "ATOM      1  N   ALA A   1      11.000  12.000  13.000  1.00  0.00",
    "ATOM      2  CA AALA A   1       1.000   2.000   3.000  0.40  0.00",
    "ATOM      3  CA BALA A   1       4.000   5.000   6.000  0.60  0.00",
    "ATOM      4  CA CALA A   1       7.000   8.000   9.000  0.60  0.00",
    "ATOM      5  C   ALA A   1      10.000  10.000  10.000  1.00  0.00",
    "ATOM      6  O   ALA A   1      10.000  10.000  11.000  bad   0.00",
    "ATOM      7  CB  ALA A   1      10.000  10.000  11.000  1.00  0.00",
    "HETATM    8  N   MSE A   2      10.000  10.000  11.000  1.00  0.00",
    "ATOM      9  N   GLY A   2      10.000  10.000  11.000  1.00  0.00",
]


def test_atom_records(spark, tmp_path):
    (tmp_path / "d.pdb").write_text("\n".join(ATOMS) + "\n")
    atoms = Rec.parse_atoms(Rec.read_lines(spark, str(tmp_path / "d.pdb"))).cache()
    s = Rec.backbone_summary(atoms).first()
    # N, CA (0.4), CA (0.6), C, O and N of the second residue are accepted
    assert (s["n_atoms_seen"], s["n_res"], s["n_res_dropped"]) == (6, 1, 1)
    r = Rec.backbone(atoms).collect()
    assert len(r) == 1 and r[0]["code"] == "A" and r[0]["residue"] == "A1" and r[0]["coords"][1] == [4.0, 5.0, 6.0]


def test_npz_and_tar(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(50, 6)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"render_id": [f"r{i:02d}" for i in range(50)], "emb": [v.tolist() for v in x]}))
    df = df.select("render_id", F.col("emb").cast("array<float>").alias("emb"))
    parts = A.write_npz(df.repartition(3), str(tmp_path / "npz"), rows_per_part=10).collect()
    assert sum(p["rows"] for p in parts) == 50 and all(zipfile.is_zipfile(tmp_path / "npz" / p["part"]) for p in parts)
    back = A.read_npz(spark, str(tmp_path / "npz/*.npz")).toPandas().sort_values("render_id")
    np.testing.assert_allclose(np.stack(back.emb), x.astype(np.float16).astype(np.float32))
    docs = spark.createDataFrame([(i % 2, f"d/{i}.webp" if i < 7 else f"{i}.txt", f"body {i}") for i in range(9)], "shard int, member string, content string")
    A.write_tar_parts(docs, str(tmp_path / "tar"), members_per_part=3).collect()
    assert sorted(f for f in os.listdir(tmp_path / "tar") if f.endswith(".tar")) == ["shard_000_p00.tar", "shard_000_p01.tar", "shard_001_p00.tar", "shard_001_p01.tar"]
    assert spark.read.parquet(str(tmp_path / "tar/*.parquet")).count() == 9
    web = A.read_tar(spark, str(tmp_path / "tar/*.tar"), suffix=".webp", flatten=True)
    assert sorted(r["member"] for r in web.collect()) == [f"{i}.webp" for i in range(7)]
    done = spark.createDataFrame([("shard_000_p00.tar",)], "archive string")
    assert A.pending_archives(web.select("archive").distinct(), done).count() == 3


def test_archives_are_read_in_ranges(spark, tmp_path):
    """Every row and member once, for all range sizes, with and without an index, compressed or not, by URI."""
    x = np.arange(900, dtype=np.float32).reshape(300, 3) + 1
    ids = np.array([f"id{i}" for i in range(300)])
    np.savez(tmp_path / "a.npz", render_id=ids, emb=x.astype(np.float16))
    np.savez_compressed(tmp_path / "b.npz", emb=x, render_id=ids.astype("S"))
    body = {f"m{i:03d}" + ("/" + "n" * 150 if i % 9 == 0 else ""): os.urandom(i * 7 % 2000) for i in range(120)}
    for name, mode in (("c.tar", "w"), ("d.tgz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as tar:
            for m, content in body.items():
                info = tarfile.TarInfo(m)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
    here = f"file://{tmp_path}"
    for split in (1 << 26, 1100, 20_000):
        for name in ("a.npz", "b.npz"):
            df = A.read_npz(spark, f"{here}/{name}", split_bytes=split)
            assert df.rdd.getNumPartitions() > 1 or split > 1100
            got = df.toPandas()
            assert sorted(got.render_id) == sorted(ids) and np.isclose(np.stack(got.emb).sum(), x.astype(np.float16 if name == "a.npz" else np.float32).astype(np.float64).sum())
        for name in ("c.tar", "d.tgz"):
            got = A.read_tar(spark, f"{here}/{name}", split_bytes=split).collect()
            assert len(got) == 120 and {r.member: bytes(r.content) for r in got} == body
    rows = spark.createDataFrame([(3, m, bytearray(c)) for m, c in body.items()], "shard int, member string, content binary")
    parts = A.write_tar_parts(rows, f"{here}/out", members_per_part=50).collect()
    assert sorted(tuple(p) for p in parts) == [("shard_003_p00", 50), ("shard_003_p01", 50), ("shard_003_p02", 20)]
    got = A.read_tar(spark, f"{here}/out/*.tar", split_bytes=3000).collect()
    assert len(got) == 120 and {r.member: bytes(r.content) for r in got} == body
    direct = spark.read.format("tar").option("path", f"{tmp_path}/out/*.tar").option("split_bytes", 9000).load()
    assert direct.count() == 120
    with pytest.raises(FileNotFoundError):
        A.read_npz(spark, f"{here}/none*.npz")


def test_commit_keeps_one_attempt_and_abort_none(spark, tmp_path, monkeypatch):
    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([[1.0, 2.0]] * 3, pa.list_(pa.float32()))], names=["render_id", "emb"])
    writer = A.NpzWriter({"path": str(tmp_path / "w"), "rows_per_part": "2"}, False)
    messages = []
    for attempt in (7, 8):  # the second one runs as well, as after a lost executor
        monkeypatch.setattr("pyspark.TaskContext.get", lambda attempt=attempt: Task(attempt))
        messages.append(writer.write(iter([batch])))
    writer.commit([messages[1], None])
    assert len([f for f in os.listdir(tmp_path / "w") if f.endswith(".npz")]) == 2
    assert sorted(os.listdir(tmp_path / "w"))[0].startswith("manifest") and len(os.listdir(tmp_path / "w")) == 3
    monkeypatch.undo()
    bad = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0])], "render_id string, emb array<float>").repartition(2)
    with pytest.raises(Exception, match="not zero"):
        A.write_npz(bad, str(tmp_path / "bad"))
    assert os.listdir(tmp_path / "bad") == []


def test_records_are_read_once_over_all_splits(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = {
        "a.cif": "head\n" + "".join(f"data_{k}\n" + "x y\n" * int(rng.integers(0, 9)) for k in range(40)),
        "b.cif": "data_first\nbody\n\ndata_\nlast data_not a record",
        "c.cif": "no record at all\n",
        "d.cif": "data_only",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    whole = spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, v string")
    want = sorted(tuple(r) for r in T.split_records(whole, "path", "v").select("path", "record_no", "name", "body").collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (3, 11, 64, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = T.read_records(spark, str(tmp_path / "*.cif")).withColumn("path", F.substring_index("path", "/", -1))
            assert sorted(tuple(r) for r in got.collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "render_id string, emb array<float>")
    K.write_embeddings(df, str(tmp_path / "e"), 2)
    with pytest.raises(AnalysisException):
        K.write_embeddings(df, str(tmp_path / "e"), 2)
    with pytest.raises(ContractError):
        K.write_embeddings(df.unionByName(df), str(tmp_path / "f"), 2)
    man = spark.createDataFrame([("a", "1ABC", "o1"), ("b", "1abc", "o2")], "render_id string, pdb_id string, object_id string")
    assert tuple(K.write_service_index(df, man, str(tmp_path / "i")).first()) == (2, 1, 2, 2)
    K.write_csv(df.withColumn("t", F.lit("@x")), str(tmp_path / "c"), ["t"])
    row = spark.read.csv(str(tmp_path / "c"), header=True, escape='"').orderBy("render_id").first()
    assert (row["emb"], row["t"]) == ("[1.0,2.0]", "'@x")
    with pytest.raises(ContractError):
        T.read_csv_contract(spark, str(tmp_path / "c"), ["missing"])
    K.write_json(str(tmp_path / "r.json"), {"b": 1, "a": 2})
    assert list(json.loads((tmp_path / "r.json").read_text())) == ["a", "b"]
    K.append_json(df, str(tmp_path / "log"))
    K.append_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    (tmp_path / "q.json").write_text(json.dumps({"crops": [{"crop_id": "c1", "pdb_ids": ["1ABC"], "box_source_xyxy": [0, 0, 5, 5]}]}))
    q = T.read_nested(spark, str(tmp_path / "q.json"), T.CROP_SCHEMA, "crops").first()
    assert (q["crop_id"], q["pdb_ids"], q["box_source_xyxy"]) == ("c1", ["1ABC"], [0, 0, 5, 5])
    (tmp_path / "v0" / "ab").mkdir(parents=True)
    (tmp_path / "v0" / "ab" / "abcd.png").write_bytes(b"x")
    assert [tuple(r)[:2] for r in T.scan_views(spark, str(tmp_path)).select("domain_id", "view").collect()] == [("abcd", 0)]
    found = T.checksums(spark, [str(tmp_path / "r.json"), str(tmp_path / "q.json")])
    good = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in found.collect()}
    want = spark.createDataFrame([("r.json", good["r.json"]), ("q.json", "0"), ("gone", "0")], "name string, sha256 string")
    assert {tuple(r) for r in T.checksum_violations(found, want).collect()} == {("q.json", "different"), ("gone", "missing")}


def traffic(seed, n=400, clients=4, pause=1.2):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": range(n), "client": [f"c{i}" for i in rng.integers(0, clients, n)],
                         "kind": np.where(rng.random(n) < 0.6, "search", "api"), "ts": np.cumsum(rng.exponential(pause, n) + (rng.random(n) < 0.02) * 700)})


def admit_loop(pdf, max_clients=10_000, idle=600.0):
    """One process, one request at a time."""
    seen, shared, out = {}, {}, []
    for r in pdf.sort_values(["ts", "id"]).itertuples():
        seen = {c: s for c, s in seen.items() if s[0] >= r.ts - idle}
        if r.client not in seen and len(seen) >= max_clients:
            out.append((r.id, 60))
            continue
        own = seen.get(r.client, (r.ts, {}))[1]
        wait = 0
        for store, limits in ((own, Adm.CLIENT_LIMITS), (shared, Adm.GLOBAL_LIMITS)):
            lim = limits[r.kind]
            tokens, at = store.get(r.kind, (float(lim.capacity), r.ts))
            rate = lim.per_minute / 60
            tokens = min(lim.capacity, tokens + max(0.0, r.ts - at) * rate)
            wait = max(1, math.ceil((1 - tokens) / rate)) if tokens < 1 else 0
            store[r.kind] = (tokens if wait else tokens - 1, r.ts)
            if wait:
                break
        seen[r.client] = (r.ts, own)
        out.append((r.id, wait))
    return dict(out)


@pytest.mark.parametrize("seed,clients,max_clients", [(0, 4, 10_000), (1, 40, 10_000), (2, 30, 8)])
def test_admission_equals_the_loop(spark, seed, clients, max_clients):
    pdf = traffic(seed, clients=clients)
    got = Adm.admit(spark.createDataFrame(pdf), max_clients=max_clients).toPandas()
    want = admit_loop(pdf, max_clients)
    assert dict(zip(got.id, got.wait.astype(int))) == want and (got.wait > 0).any()
    assert ("full" in set(got.reason)) == (max_clients == 8)


def test_burst_then_refill(spark):
    rows = [(i, "c", "search", t) for i, t in enumerate((0.0, 0.0, 0.0, 0.0, 6.0))]
    waits = Adm.admit(spark.createDataFrame(rows, "id long, client string, kind string, ts double")).toPandas().sort_values("id").wait.tolist()
    assert waits == [0, 0, 0, 6, 0]


def test_client_identity(spark):
    rows = [("127.0.0.1", "2001:db8::1"), ("10.1.2.3", "1.1.1.1"), ("2001:db8:1:2:3::9", ""), ("x", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "peer string, asserted string").select(Adm.client_identity("peer", "asserted")).collect()]
    assert got == ["2001:db8::/64", "10.1.2.3", "2001:db8:1:2::/64", "unknown"]


def test_stream_equals_batch(spark, tmp_path):
    pdf = traffic(7, 120, 3)
    for i, part in enumerate(np.array_split(pdf, 3)):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    src = spark.readStream.schema("id long, client string, kind string, ts double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = Adm.admit_stream(src, Adm.CLIENT_LIMITS, F.concat_ws("/", "client", "kind"))
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    free = {k: Adm.Limit(1e9, 1e12) for k in Adm.CLIENT_LIMITS}
    want = Adm.admit(spark.createDataFrame(pdf), global_limits=free).toPandas()
    assert dict(zip(got.id, got.wait)) == dict(zip(want.id, want.wait.astype(int)))


def test_dense_traffic_is_cut_without_pauses(spark):
    """Requests never pause for a whole refill, yet the shared timeline falls into many pieces; a flood is one."""
    rng = np.random.default_rng(5)
    us = np.cumsum(rng.exponential(2.5e6, 3000)).astype(int)
    flood = us[-1] + np.arange(1, 500) * 1000
    rows = pd.DataFrame({"id": range(3499), "client": "c", "kind": "search", "us": np.concatenate([us, flood])})
    limits = {"search": Adm.Limit(6, 30)}
    got = Adm.with_pieces(spark.createDataFrame(rows), ["kind"], limits).toPandas().sort_values("id")
    assert got.piece.nunique() > 300 and np.diff(us).max() < 1e6 * 60 and got.piece.tail(499).nunique() == 1
    waits = Adm.bucket_waits(spark.createDataFrame(rows), ["kind"], limits).toPandas().sort_values("id").wait.to_numpy()
    alone, _, _ = Adm.take(rows.us.to_numpy(), 0, int(rows.us[0]), limits["search"])
    assert (waits == alone).all() and (waits > 0).sum() > 480


def test_taking_in_steps_equals_one_by_one():
    rng = np.random.default_rng(2)
    for k in range(60):
        limit = Adm.Limit(int(rng.integers(1, 9)), int(rng.integers(1, 90)))
        us = np.cumsum(rng.integers(0, 4_000_000 if k % 2 else 60_000, 300))
        token, refill = limit.units
        backlog, at, want = 0, int(us[0]), []
        for t in us.tolist():
            backlog, at = max(0, backlog - refill * (t - at)), t
            lack = backlog - limit.room
            want.append(max(1, -(-lack // (refill * Adm.MICROS))) if lack > 0 else 0)
            backlog += 0 if want[-1] else token
        half = Adm.take(us[:170], 0, int(us[0]), limit)
        rest = Adm.take(us[170:], *half[1:], limit)
        assert [*half[0], *rest[0]] == want


def test_buckets_keep_times_that_microseconds_round(spark):
    """6.0000004 seconds less one are six to wait, and five once times are rounded."""
    rows = [(i, "c", "search", t) for i, t in enumerate((0.0, 0.0, 0.0, 0.9999996))]
    for limits in ({"client_limits": {"search": Adm.Limit(3, 10)}}, {"global_limits": {"search": Adm.Limit(3, 10)}}):
        free = {"client_limits": {"search": Adm.Limit(9, 60)}, "global_limits": {"search": Adm.Limit(9, 60)}} | limits
        got = Adm.admit(spark.createDataFrame(rows, "id long, client string, kind string, ts double"), **free).toPandas()
        assert got.sort_values("id").wait.tolist() == [0, 0, 0, 6]
    half = Adm.spend(np.array([0.0, 0.0]), None, 0.0, Adm.Limit(3, 10))
    assert Adm.spend(np.array([0.0, 0.9999996]), *half[1:], Adm.Limit(3, 10))[0].tolist() == [0, 6]


def _events(path, play_seconds, users):
    hour = pd.Timestamp("2024-01-01")
    ts = [hour + pd.Timedelta(microseconds=round(s * 3600e6)) for s in play_seconds]
    rows = pd.DataFrame({"event_id": range(len(ts)), "ts": ts, "user_id": users, "event_type": "view", "value": 1.0, "props": "{}"})
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    rows.to_parquet(str(path / "events.parquet"), index=False)


class Kept:
    """A state of values by key, or one value, as a processor sees it."""

    def __init__(self):
        self.rows, self.one, self.most = {}, None, 0

    def exists(self):
        return bool(self.rows) or self.one is not None

    def keys(self):
        return iter(list(self.rows))

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value
        self.most = max(self.most, len(self.rows))

    def removeKey(self, key):
        del self.rows[key]

    def get(self):
        return self.one

    def update(self, value):
        self.one = value

    def clear(self):
        self.rows, self.one = {}, None


def test_stream_holds_blocks_and_merges_them_in_order(monkeypatch):
    """Requests lie in the state as blocks, not one by one, and several clients share a key; runs are merged block by block."""
    monkeypatch.setattr(Adm, "BLOCK_ROWS", 16)
    monkeypatch.setattr(Adm, "RUN_ROWS", 40)
    pdf = traffic(5, 400, 9, 0.4)
    pdf["ts"] = pdf.ts.round(0)  # many at the same time
    pdf["us"] = (pdf.ts * 1e6).astype("int64")
    states, timers = {}, []
    handle = type("Handle", (), {"getMapState": lambda self, name, *_: states.setdefault(name, Kept()),
                                 "getValueState": lambda self, name, *_: states.setdefault(name, Kept()),
                                 "registerTimer": lambda self, ms: timers.append(ms)})()
    work = Adm.Buckets(Adm.CLIENT_LIMITS, 600_000_000, "client", "client", False)
    work.init(handle)
    mixed = pdf.sample(frac=1, random_state=2)
    assert not list(work.handleInputRows(("0",), iter([mixed.iloc[i : i + 30] for i in range(0, 400, 30)]), None))
    assert 400 / 16 <= states["held"].most < 60 and timers == [int(pdf.us.min()) // 1000]
    got, at = [], [int(pdf.us.iloc[150]) // 1000, int(pdf.us.iloc[150]) // 1000 + 7000, 10**10]
    for ms in at:
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self, ms=ms: ms})()
        step = list(work.handleExpiredTimer(("0",), clock, None))
        assert all((x.us < ms * 1000).all() if "us" in x else (x.ts * 1e6 < ms * 1000).all() for x in step)
        got += step
    got = pd.concat(got)
    assert got[["ts", "id"]].apply(tuple, axis=1).is_monotonic_increasing and len(got) == 400
    want = {}
    for (_, kind), own in pdf.sort_values(["ts", "id"]).groupby(["client", "kind"]):
        want |= dict(zip(own.id, Adm.spend(own.ts.to_numpy(), None, own.ts.iloc[0], Adm.CLIENT_LIMITS[kind])[0], strict=True))
    assert dict(zip(got.id, got.wait, strict=True)) == want and (got.reason == "client").sum() == sum(w > 0 for w in want.values()) > 0
    assert not states["held"].exists() and not states["buckets"].exists()  # all were idle at the last watermark


def test_admission_has_as_many_clients_as_its_sql(spark, tmp_path):
    _events(tmp_path, np.arange(10_050) * 0.01, range(10_050))
    assert {r.outcome for r in entry.queries()["admission"](spark, str(tmp_path)).collect()} == {"admitted", "global"}


def test_admission_stream_ends_where_its_sql_does(spark, tmp_path):
    """The cut lies between two milliseconds."""
    from tools.check_oracle import compare

    _events(tmp_path, [3.0, 5.0004, 5.0006, 5.0008, 10.0007], range(5))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = entry.queries()["admission_stream"](spark, str(tmp_path)).toPandas()
    assert sorted(got.id) == [0, 1, 2] and compare(got, con.execute(entry.oracle_sql()["admission_stream"]).df()) == "ok"


def test_admission_stream_equals_batch(spark, tmp_path):
    """Shuffled micro-batches, three stages; state goes once its clients were idle."""
    pdf = traffic(3, 240, 12, 0.6).assign(ts=lambda d: d.ts.round(3))
    late = pd.DataFrame({"id": [900, 901, 902], "client": "z", "kind": "api", "ts": pdf.ts.max() + np.array([700.0, 1400.0, 2200.0])})
    micros = F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("bigint"))
    parts = [x.sample(frac=1, random_state=1) for x in np.array_split(pdf, 3)] + [late.iloc[[k]] for k in range(3)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part).select("id", "client", "kind", micros.alias("time")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    src = spark.readStream.schema("id long, client string, kind string, time timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = Adm.admission_stream(src, max_clients=8, delay="90 seconds")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().set_index("id")
    want = Adm.admit(spark.createDataFrame(pd.concat([pdf, late])), max_clients=8).toPandas().set_index("id").drop(index=902)
    assert got.wait.sort_index().tolist() == want.wait.sort_index().astype(int).tolist()
    assert got.reason.fillna("").sort_index().tolist() == want.reason.fillna("").sort_index().tolist()
    assert {"full", "client", "global"} & set(got.reason) >= {"full", "client"}
    left = sum(o["numRowsTotal"] for o in q.recentProgress[-1]["stateOperators"])
    assert left <= 16  # of thirteen clients only the last one's states are there


def test_catalogue_shape():
    queries, sql = catalogue.QUERIES, catalogue.ORACLES
    assert set(sql) <= set(queries) and len(queries) > 100
    assert set(queries) <= set(entry.queries()) and set(sql) <= set(entry.oracle_sql())
    no_twin = set(queries) - set(sql)
    assert len(no_twin) < 15, sorted(no_twin)


@pytest.mark.parametrize("name", ["retrieval_top5", "set_cover", "greedy_pack", "tfidf", "subset_metrics", "admission"])
def test_catalogue_against_sql(spark, sf, name):
    from tools.check_oracle import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_edges_of_dealt_lines_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, 0, "a_1 A_2 b"), (1, 1, "a"), (1, 0, "b"), (2, 0, "a"), (2, 1, " ")], "doc long, line_no long, line string")
    got = T.parse_clusters(rows.repartition("doc"), within="doc")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a"), (1, 0, "b"), (1, 1, "a"), (2, 0, "a")]


def test_checksums_of_files_above_the_limit_of_a_value(spark, tmp_path):
    import hashlib

    for name, n in (("a b.bin", 5000), ("c.bin", 10), ("d.bin", 1001)):
        (tmp_path / name).write_bytes(bytes(range(256)) * (n // 256) + b"x" * (n % 256))
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 1000)  # stands for the 2 GB of one value
    try:
        got = {r.path.rpartition("/")[2]: (r.bytes, r.sha256) for r in T.checksums(spark, str(tmp_path), whole=1000).collect()}
    finally:
        spark.conf.unset(limit)
    assert got == {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir()}
