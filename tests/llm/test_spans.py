"""Fill-in-middle, repeated byte strings and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismatch.llm import fill_middle, periodic_runs, suffix_levels
from prismatch.llm import words as W

from . import brute
from .test_operators import CORPUS, prose, rows_of

RNG = random.Random(11)


def lines(n):
    return "\n".join(prose(RNG.randrange(0, 9)) for _ in range(n))


def odd_texts():
    """Texts that are awkward for one of the three."""
    base = lines(30)
    texts = [lines(RNG.randrange(1, 30)) for _ in range(40)] + [base, base + "\n", "\n\n", "a\n", "\na", "x<P>y", "<S>", "m<M", "ü\né\n漢", base.replace("w1", "ü")]
    texts += ["z" * 400, "ab" * 300, "na " * 200, f"{'q' * 99}", "r" * 100, "r" * 101, "é" * 150, prose(60) * 3, " ".join(["a b c d e f g"] * 9 + ["x"] + ["a b c d e f g"] * 9)]
    return texts


MORE = CORPUS + [(100_000 + 7 * i, t) for i, t in enumerate(odd_texts())]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", 1, "k", [1], 2) for d, t in MORE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, block int, twin string, runs array<int>, n int").repartition(3).cache()


# fill-in-middle


def middles(doc_id, text, unit=r"[^\n]*\n|[^\n]+", seed=7):
    t = text or ""
    u = re.findall(unit, t)
    d = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in fill_middle.MARKS):
        return len(u), "plain", None, None, t
    if h[3] % 100 < 50:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_digest_equals_brute_force(docs):
    got = rows_of(fill_middle.middle_digest(docs), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    want = []
    for d, t in sorted(MORE, key=lambda r: r[0]):
        n, form, p, m, out = middles(d, t)
        want.append((d, n, form, p, m, brute.sha(out), brute.sha(t or "")))
    assert got == want and {x[2] for x in got} == set(fill_middle.FORMS)


def test_pieces_spell_output_and_units_of_characters(docs):
    found = fill_middle.fill_in_middle(docs.select("doc_id", "text"), unit="char", marks=("[pre]", "[suf]", "[mid]"), rate=70)
    found = found.withColumn("again", fill_middle.restored("fim.output", "fim.form", marks=("[pre]", "[suf]", "[mid]")))
    plain = 0
    for r in found.collect():
        text, marks = (r.text or "").encode(), b"[pre][suf][mid]"
        assert b"".join((text if p.source == "text" else marks)[p.begin : p.end] for p in r.fim.pieces).decode() == r.fim.output
        assert r.again == (r.text or "") and r.fim.n == len(r.text or "")
        plain += r.fim.form == "plain"
    assert 10 < plain < len(MORE) - 10


def test_marks_that_may_overlap_are_refused(docs):
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("a", "xax", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.check_marks(marks)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, out="lang")


# repeated byte strings


def strings(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            key = raw[p : p + length]
            if key in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(key)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[d] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 3, 0])
def test_string_digest_equals_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_levels, "HOT", hot)
    monkeypatch.setattr(suffix_levels, "SLICE_TEXT", 30_000)
    want = strings(MORE)
    got = rows_of(suffix_levels.string_digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((d, *x) for d, x in want.items())
    assert sum(x[1] for x in want.values()) > 20_000 and max(x[2] for x in want.values()) > 1


def test_spans_and_kept_bytes_make_up_the_text(docs):
    for r in suffix_levels.cut_strings(docs).collect():
        raw = (r.text or "").encode()
        edges = [0, *(x for s in r.cut.spans for x in (s.s, s.e)), len(raw)]
        assert b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) == bytes(r.cut.kept)
        assert r.lang == "en" and r.twin == "k" and list(r.runs) == [1]


def test_repeated_rows_and_missing_ids_of_strings(spark):
    a, b = prose(60), prose(60)
    rows = spark.createDataFrame([(1, a), (1, a), (2, a), (None, a), (None, b), (None, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text, r.cut.n_removed) for r in suffix_levels.cut_strings(rows).collect()), key=str)
    assert got == sorted([(1, a, 0), (1, a, 0), (2, a, len(a)), (None, a, len(a)), (None, b, 0), (None, None, 0)], key=str)


def test_long_texts_are_taken_in_pieces(spark):
    long = "".join(RNG.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, long), (2, long[300_000:560_000]), (3, "x" + long[:99]), (4, "y" + long[:100]), (5, "na" * 300_000)]
    got = rows_of(suffix_levels.string_digest(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "n_removed", "n_spans")
    assert got == [(1, 0, 0), (2, 260_000, 1), (3, 0, 0), (4, 100, 1), (5, 600_000 - 2, 1)]


def test_levels_grow_geometrically_and_know_first_places():
    family, first, n = suffix_levels.Levels(4), {}, 0
    rng = np.random.default_rng(3)
    for batch in range(40):
        raw = rng.integers(0, 3, (60, 4)).astype(np.uint8) if batch % 2 else rng.integers(0, 200, (60, 4)).astype(np.uint8)
        got = family.add(np.ascontiguousarray(raw).view("S4").ravel(), np.full(60, batch), np.arange(60))
        for k, row in enumerate(raw):
            assert got[k] == (bytes(row) in first)
            first.setdefault(bytes(row), n + k)
        n += 60
        sizes = [len(x[0]) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(first)
    assert len(family.levels) > 1


# periodic runs


def runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def altered(doc_id, text):
    w = brute.spaced(text, lower=False)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_run_digest_equals_brute_force(docs):
    want = []
    for d, t in sorted(MORE, key=lambda r: r[0]):
        w = altered(d, t)
        found = runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((d, len(found), *best, 1000 * best[1] // best[2] if found else None, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = rows_of(periodic_runs.run_digest(docs), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got == want and sum(x[1] > 0 for x in got) > 8


def random_words(rng):
    n = rng.choice([0, 1, 5, 11, 12, 13, 40, 150, 400])
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 60]))}" for _ in range(n)]
    if n > 3 and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randrange(1, n)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    if n > 3 and rng.random() < 0.3:
        w[rng.randrange(n)] = "z"
    return w


@pytest.mark.parametrize("longest", [1 << 16, 4])
def test_word_runs_equal_brute_force(monkeypatch, longest):
    monkeypatch.setattr(periodic_runs, "LONGEST", longest)
    rng = random.Random(5)
    for least in (12, 5, 2):
        every = [random_words(rng) for _ in range(250)]
        w = W.words_of(pa.array([" ".join(x) for x in every]), lower=False)
        found = periodic_runs.word_runs(w.first, W.hash_words(w), least)
        row = np.searchsorted(w.first, found[:, 0], "right") - 1
        for k, x in enumerate(every):
            got = [(int(s - w.first[k]), int(e - s), int(q)) for s, e, q in found[row == k]]
            assert got == runs(x, least)


def test_transform_gives_exact_mismatches():
    rng = np.random.default_rng(1)
    for b, shifts in ((2, 7), (16, 32), (64, 128), (512, 1024)):
        block, window = rng.integers(0, 20_000, (3, b)).astype(float), rng.integers(0, 20_000, (3, shifts + b - 1)).astype(float)
        window[1, 5 : 5 + b] = block[1]
        got = periodic_runs.mismatch(block, window, shifts)
        want = np.stack([[int(((block[r] - window[r, s : s + b]) ** 2).sum()) % periodic_runs.PRIME for s in range(shifts)] for r in range(3)])
        assert (got == want).all() and got[1, 5] == 0


def test_dense_repetition_stays_cheap():
    for x in (np.zeros(200_000, np.uint64), np.arange(200_000, dtype=np.uint64) % np.uint64(7), np.tile(np.arange(100_000, dtype=np.uint64), 2)):
        found = periodic_runs.word_runs(np.array([0, len(x)]), x)
        assert found.tolist() == [[0, 200_000, len(np.unique(x))]]


# all three


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    for f in (fill_middle.middle_digest, suffix_levels.string_digest, periodic_runs.run_digest):
        assert f(none).count() == 0


def test_null_columns(spark):
    rows = spark.createDataFrame([(None, None), (None, ""), (5, None)], "doc_id bigint, text string")
    assert [r.form for r in fill_middle.middle_digest(rows).collect()] == ["plain"] * 3
    assert [r.n_removed for r in suffix_levels.string_digest(rows).collect()] == [0] * 3
    assert [(r.n_runs, r.start, r.runs_sha256) for r in periodic_runs.run_digest(rows).collect()] == [(0, None, brute.sha(""))] * 3


def test_columns_stay(docs):
    for out in (fill_middle.fill_in_middle(docs), suffix_levels.cut_strings(docs), periodic_runs.periodic_runs(docs)):
        assert out.columns[:-1] == docs.columns and out.count() == len(MORE)
    with pytest.raises(ValueError):
        suffix_levels.cut_strings(docs, out="lang")
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs.withColumn("periodic", F.lit(1)))
