"""Strings, n-grams, images, styles, samples, crops."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismatch.functions import geometry as Geo
from prismatch.functions import text as X
from prismatch.functions import vectors as V
from prismatch.operators import crops as Crops
from prismatch.operators import features as Feat
from prismatch.operators import pixels as Pix
from prismatch.operators import sampling as Samp
from prismatch.operators import styles as Style


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_runs_and_summary(spark):
    row = one(spark, X.segments(F.lit("HHHEE-")).alias("s"), X.element_string(F.lit("HHHHEEHHH-EEE")).alias("e"))
    assert [(s["symbol"], s["length"]) for s in row["s"]] == [("H", 3), ("E", 2), ("-", 1)]
    assert row["e"] == "HEE"
    s = one(spark, *[c.alias(n) for n, c in X.ss_summary(F.lit("HHHHHEE--E")).items()])
    assert (s["n_res"], s["n_helix"], s["n_strand"], s["max_helix_len"], s["mean_strand_len"], s["frac_C"]) == (10, 1, 1, 5, 2.0, 0.2)
    empty = one(spark, *[c.alias(n) for n, c in X.ss_summary(F.lit("")).items()])
    assert np.isnan(empty["frac_H"]) and np.isnan(empty["mean_helix_len"]) and empty["max_helix_len"] == 0 and not empty["ok"]


def test_tfidf_by_hand(spark):
    texts = {1: "HEH", 2: "HE", 3: "EE", 4: "", 5: "HHHEEE"}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    train = {1, 2, 3}
    grams = {k: Counter(t[i:i + n] for n in range(1, 6) for i in range(len(t) - n + 1)) for k, t in texts.items()}
    df_count = Counter(g for k in train for g in grams[k])
    vocab = sorted(g for g, c in df_count.items() if c >= 2)
    idf = {g: np.log((1 + len(train)) / (1 + df_count[g])) + 1 for g in vocab}
    v = Feat.fit_tfidf(df.where(F.col("id").isin(*train)), "id", "t")
    assert [r["term"] for r in v.orderBy("index").collect()] == vocab
    got = Feat.dense(Feat.transform_tfidf(df, v, "id", "t"), "id", len(vocab)).collect()
    for r in got:
        w = np.array([grams[r["id"]][g] * idf[g] for g in vocab])
        np.testing.assert_allclose(r["ngram"], w / np.linalg.norm(w))
    assert {r["id"] for r in got} == {1, 2, 3, 5}
    with pytest.raises(ValueError):
        Feat.build_features(df, F.lit(True), "nope")


def test_feature_assembly(spark):
    s = spark.createDataFrame([(1, "HHHHEE-"), (2, "EEHHHHH"), (3, "-")], "domain_id int, ss string")
    s = s.select("domain_id", *[c.alias(n) for n, c in X.ss_summary("ss").items()])
    widths = {k: {len(r["features"]) for r in Feat.build_features(s, F.col("domain_id") < 3, k).collect()} for k in Feat.KINDS}
    assert widths["length"] == {2} and widths["numeric"] == {14}
    assert widths["both"] == {14 + next(iter(widths["ngram"]))}


def test_text_helpers(spark):
    words = "the quick brown fox jumps over the lazy dog again and again"
    line1, rest = [], []
    for w in words.split():
        (line1 if len(" ".join([*line1, w])) <= 16 else rest).append(w)
    two = " ".join(rest)
    want = (" ".join(line1), two if len(two) <= 16 else two[:15] + "…")
    row = one(spark, X.wrap_two_lines(F.lit(words), 16).alias("w"), X.residue_code(F.lit("mse")).alias("m"), X.residue_code(F.lit("ZZZ")).alias("z"),
              X.split_ids(F.lit(" 1abc; 2DEF,3x ")).alias("ids"), X.holding_path(F.lit("1abc")).alias("p"), X.entry_of(F.lit("1ABC_2")).alias("e"),
              X.csv_safe(F.lit("=1+1")).alias("c"), X.view_seed(F.lit("1abc_au"), F.lit(3), 7).alias("crc"))
    assert tuple(row["w"]) == want
    assert (row["m"], row["z"], row["ids"], row["p"], row["e"], row["c"]) == ("M", "X", ["1ABC", "2DEF", "3X"], "ab/1abc.cif.gz", "1abc", "'=1+1")
    assert row["crc"] == zlib.crc32(b"1abc_au:3:7")


def test_geometry(spark):
    row = one(spark, Geo.fit_canvas(F.lit(928), F.lit(3)).alias("f"), Geo.box_inside(F.array(*map(F.lit, (0, 0, 5, 9))), F.lit(5), F.lit(8)).alias("b"),
              Geo.rotation_matrix(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("r"), Geo.hsv_to_rgb(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("c"))
    assert tuple(row["f"]) == (464, 2, 24, 255, False)  # 1.5 rounds to the even 2
    assert row["b"] is False and row["r"] == [1, 0, 0, 0, 1, 0, 0, 0, 1] and row["c"] == [1.0, 0.0, 0.0]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r["u"] for r in df.select(V.l2_normalise("v").alias("u")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_images(spark):
    a = np.full((12, 12, 3), 255, np.uint8)
    a[3:9, 4:8] = (200, 10, 10)
    mask = Pix.modal_mask(a[None])
    assert mask.sum() == 24 and Pix.ink_fraction(a[None])[0, 0] == pytest.approx(24 / 144)
    s = Pix.shape_features(mask)[0]
    assert s[0] == pytest.approx(24 / 144) and s[1] == pytest.approx(4 / 6) and s[2] == 1.0
    assert s[3] == pytest.approx(16 / 24)  # outline of a 6 x 4 block
    sil = Pix.silhouette(a[None])[0]
    assert len(sil) == 20 and sil[1] == 0.5 and sil[2] == pytest.approx(4 / 12)
    # the invariants do not change when the image is turned or moved
    turned = Pix.silhouette(np.rot90(a)[None])[0]
    np.testing.assert_allclose(sil[13:], turned[13:], atol=1e-9)
    flat = Pix.silhouette(np.zeros((1, 8, 8, 3), np.uint8))[0]
    assert flat[0] == 0 and (flat[13:] == 0).all()
    assert Pix.colour_histogram(a[None]).sum() == pytest.approx(1) and Pix.hog(np.zeros((1, 128, 128))).shape[1] == 7 * 7 * 4 * 9
    edge = np.zeros((32, 32))
    edge[:, 16:] = 1.0
    cells = Pix.hog(edge[None], cell=16).reshape(4, 9)
    assert cells[:, 0].min() > 0 and cells[:, 1:].max() == 0  # a vertical edge has one direction
    df = spark.createDataFrame([(1, 12, 12, bytearray(a.tobytes())), (2, 9, 9, bytearray(b"short"))], "id int, height int, width int, rgb binary")
    got = {r["id"]: r["f"] for r in df.select("id", Pix.per_stack(Pix.nuisance(cell=4))("rgb", "height", "width").alias("f")).collect()}
    assert got[2] is None and len(got[1]) == 12 + 7 + 36 * 4 + 10 - 0


def moments_one_by_one(mask):
    ys, xs = np.nonzero(mask)
    return np.array([[((ys - ys.mean()) ** p * (xs - xs.mean()) ** q).sum() for q in range(4)] for p in range(4)])


def hog_one_by_one(grey, cell):
    gy, gx = np.zeros_like(grey), np.zeros_like(grey)
    gy[1:-1], gx[:, 1:-1] = grey[2:] - grey[:-2], grey[:, 2:] - grey[:, :-2]
    rows, cols = grey.shape[0] // cell, grey.shape[1] // cell
    cells = np.zeros((rows, cols, 9))
    for y in range(rows * cell):
        for x in range(cols * cell):
            angle = math.degrees(math.atan2(gy[y, x], gx[y, x])) % 180
            cells[y // cell, x // cell, min(int(angle / 20), 8)] += math.hypot(gy[y, x], gx[y, x]) / cell**2
    out = []
    for y in range(rows - 1):
        for x in range(cols - 1):
            v = cells[y : y + 2, x : x + 2].ravel()
            v = np.minimum(v / math.sqrt((v**2).sum() + 1e-10), 0.2)
            out.append(v / math.sqrt((v**2).sum() + 1e-10))
    return np.concatenate(out)


def test_stacks_equal_single_images(spark, monkeypatch):
    rng = np.random.default_rng(8)
    stack = rng.integers(0, 256, (6, 24, 32, 3)).astype(np.uint8)
    stack[:, 4:20, 6:25] //= 3
    mask = rng.random((6, 24, 32)) < 0.3
    mask[5] = False
    central, _ = Pix.central_moments(Pix.raw_moments(mask))
    for k in range(5):
        np.testing.assert_allclose(central[k], moments_one_by_one(mask[k]), rtol=1e-9, atol=1e-6)
        ys, xs = np.nonzero(mask[k])
        values = np.linalg.eigvalsh(np.cov(np.stack([ys, xs])))
        np.testing.assert_allclose(Pix.shape_features(mask)[k, 5:8], [math.sqrt(values[1] / values[0]), math.sqrt(values[1]) / 24, math.sqrt(values[0]) / 24], rtol=1e-9)
    assert (Pix.shape_features(mask)[5] == 0).all()
    grey = (stack / 255.0).mean(-1)
    np.testing.assert_allclose(Pix.hog(grey, 8), [hog_one_by_one(g, 8) for g in grey], atol=1e-9)
    colours, counts = Pix.modal_colour(np.repeat(stack[:1, :2, :2], 3, 1))
    assert counts[0] == 3 and tuple(colours[0]) == min(map(tuple, stack[0, :2, :2].reshape(-1, 3)))
    # sizes mixed in a batch, stacks of one or two images
    rows = [(k, 24, 32, bytearray(s.tobytes())) for k, s in enumerate(stack)] + [(6, 12, 12, bytearray(stack[0, :12, :12].tobytes())), (7, None, 3, bytearray(b"x")), (8, 1, 1, None)]
    df = spark.createDataFrame(rows, "id int, height int, width int, rgb binary").coalesce(1)
    got = {r["id"]: r["f"] for r in df.select("id", Pix.per_stack(Pix.silhouette)("rgb", "height", "width").alias("f")).collect()}
    want = Pix.silhouette(stack)
    for k in range(6):
        np.testing.assert_allclose(got[k], want[k])
    assert len(got[6]) == 20 and got[7] is None and got[8] is None


def style_loop(object_id, view, seed=0):
    """The sampler as a plain sequence of draws."""
    rng = np.random.default_rng(zlib.crc32(f"{object_id}:{view}:{seed}".encode()))
    q = rng.normal(size=4)
    out = dict(zip(("quat_w", "quat_x", "quat_y", "quat_z"), q / np.linalg.norm(q)))
    for name, kind, p in Style.AXES:
        if kind in ("categorical", "integer"):
            out[name] = list(p)[int(rng.choice(len(p), p=list(p.values())))]
        elif kind == "bernoulli":
            out[name] = int(rng.random() < p[0])
        elif kind == "uniform":
            out[name] = float(rng.uniform(*p))
        else:
            out[name] = 0.0 if rng.random() < p[0] else float(rng.uniform(*p[1:]))
    return out


def test_streams_equal_a_generator_of_their_own():
    seeds = np.r_[0, 1, 2**32 - 1, np.random.default_rng(4).integers(0, 2**32, 3000)]
    q, u = Style._streams(seeds, 27)
    for i, s in enumerate(seeds.tolist()):
        rng = np.random.default_rng(s)
        assert (q[i] == rng.normal(size=4)).all() and (u[i] == rng.random(27)).all()


def test_styles_follow_one_stream(spark):
    jobs = spark.createDataFrame([(f"o{i}", v) for i in range(40) for v in (0, 1, 5)], "object_id string, view int")
    got = {(r["object_id"], r["view"]): r.asDict() for r in Style.sample_styles(jobs, held_out_ok=True).collect()}
    for (o, v), row in got.items():
        want = style_loop(o, v)
        if v == 0:
            want |= {k: (x if isinstance(row[k], str) else float(x)) for k, x in Style.CANONICAL.items()}
            assert row["role"] == "eval_single"
        elif want["cartoon_style"] == "loop" and want["ray_trace_mode"] == 1:
            want["ray_trace_mode"] = 0
        for k, x in want.items():
            assert row[k] == (pytest.approx(x) if isinstance(x, float) else x), (o, v, k)
    kept = Style.sample_styles(jobs).where("view > 0 and cylindrical_helices = 1 and flat_sheets = 0").count()
    assert kept == 0


def panel_rows():
    return [(f"{p}_{v}", p, v, s) for p, s in (("a", "val"), ("b", "val"), ("c", "train"), ("d", "test")) for v in range(4)]


def test_panel_is_order_independent(spark):
    cols = "render_id string, entry string, view int, split string"
    rows = panel_rows()
    panels = [Samp.validation_panel(spark.createDataFrame(r, cols), 1, 9) for r in (rows, rows[::-1])]
    digests = [Samp.panel_digest(p) for p in panels]
    got = panels[0].toPandas()
    chosen = sorted(np.random.default_rng(9).choice(["a", "b"], 1, replace=False).tolist())
    assert digests[0] == digests[1] == hashlib.sha256("\n".join(sorted(got.render_id)).encode()).hexdigest()
    assert sorted(set(got.entry)) == chosen and set(got.split) == {"val"} and len(got) == 4
    with pytest.raises(ValueError):
        Samp.validation_panel(spark.createDataFrame(rows[8:], cols), 1, 9)


def test_batches_resume(spark):
    rows = spark.createDataFrame([(f"{e}{v}", str(e)) for e in range(8) for v in range(4)], "render_id string, entry string")
    whole = Samp.pk_batches(rows, p=4, k=2, steps=10, seed=12).toPandas()
    rest = Samp.pk_batches(rows, p=4, k=2, steps=10, seed=12, first_step=6).toPandas()
    order = ["step", "label", "render_id"]
    a = whole[whole.step >= 6].sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, rest.sort_values(order).reset_index(drop=True))
    assert whole.groupby("step").entry.nunique().eq(4).all() and len(whole) == 80
    assert whole.groupby(["step", "entry"]).render_id.nunique().eq(2).all()


def test_crops(spark):
    rows = spark.createDataFrame(
        [(1, ["rna_only"], "1abc;2def", "verified", "experimental", False, False), (2, [], "1abc", "listed", "predicted", True, True)],
        "id int, given_flags array<string>, pdb_text string, pdb_status string, structure_type string, duplicate boolean, missing boolean")
    got = {r["id"]: r for r in Crops.crop_records(rows).collect()}
    assert got[1]["review_flags"] == ["panel_pdb_assignment_needed", "rna_only"] and got[1]["review_status"] == "excluded"
    assert got[2]["review_flags"] == ["coordinates_unavailable", "duplicate_source_image", "source_mapping_listed", "structure_predicted"]
    assert Crops.invalid_reviews(Crops.crop_records(rows)).count() == 0
    assert Crops.invalid_reviews(Crops.crop_records(rows).withColumn("mapping_status", F.lit("x"))).count() == 2


def test_stacks_stay_small():
    """What is formed for a stack is many times its pixels, so a full Arrow batch of small images is more than one."""
    sizes = []
    rgb = pd.Series([bytes(192)] * 3000)
    Pix.per_stack(lambda stack: sizes.append(len(stack)) or np.zeros((len(stack), 1))).func(rgb, pd.Series([8] * 3000), pd.Series([8] * 3000))
    assert sizes == [1024, 1024, 952]


def test_terms_meet_by_row(spark):
    """Texts are dealt by key once; their n-grams are not shuffled one by one."""
    rows = spark.createDataFrame([(1, "HHE"), (1, "H"), (2, "E")], "id long, s string")
    out = Feat.term_counts(rows, "id", "s", 1, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(id" in plan and "hashpartitioning(id, term" not in plan.replace("#", "").replace("L", "")
    assert {(r.id, r.term): r.tf for r in out.collect()} == {(1, "H"): 3, (1, "E"): 1, (1, "HH"): 1, (1, "HE"): 1, (2, "E"): 1}
