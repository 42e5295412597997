"""The operators against brute force, on texts with every awkward case."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismatch.llm import code_index, context_mixing, decontaminate, language_mix, license_scan, ngram_join, pieces, preferences, substring_dedup, url_filter
from prismatch.llm import words as W
from prismatch.llm.queries import piece_model

from . import brute

RNG = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(400)] + ["Café", "naïve", "漢字", "x" * 30, "A.B", "it's"]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(text, every):
    w = text.split(" ")
    for i in range(RNG.randrange(every), len(w), every):
        w[i] = RNG.choice(VOCABULARY)
    return " ".join(w)


def corpus():
    """(doc_id, text): copies, near copies of a large family, shared passages, short, empty, null and very long texts."""
    base, passage, line = prose(150), prose(60), prose(24)
    texts = [None, "", " \n\t", "one", "one", "two words", "three short words", "Three Short  words", prose(19), prose(20), prose(21)]
    texts += [base] * 5 + [edited(base, k) for k in (150, 120, 100, 80, 60, 50, 40, 30, 25, 20, 15, 10)]
    texts += [f"{prose(RNG.randrange(5, 120))} {passage} {prose(40)}" for _ in range(8)]
    texts += [f"{line}\n{prose(RNG.randrange(30, 90))}" for _ in range(30)]
    texts += [prose(RNG.randrange(4, 200)) for _ in range(25)]
    texts += [f"{line} {line} {line}", "spam " * 200, prose(4000), "y" * 5000, "a b c d " * 40]
    RNG.shuffle(texts)
    return [(i * 37, t) for i, t in enumerate(texts)]


CORPUS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns bear names that the operators might use themselves."""
    rows = [(d, t, "en", "s", len(t or ""), 1, "k", [1]) for d, t in CORPUS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, root string, runs array<int>").repartition(3).cache()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_words_and_gram_hashes():
    texts = ["Hello wörld  a\tb\n", None, "", " x", "abcdefgh ijklmnopqrstuvwxyzABC", "y z"]
    for sep, split in (("space", brute.spaced), ("alnum", brute.plain)):
        w = W.words_of(pa.array(texts), sep)
        got = [bytes(w.buf[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
        assert got == [x for t in texts for x in split(t)]
        assert w.counts().tolist() == [len(split(t)) for t in texts]
    h = W.hash_words(w)
    for k in range(1, len(h) + 2):
        ahead = W.gram_hashes(np.concatenate([np.array([5, 6], np.uint64), h]), k)
        assert (ahead[2:] == W.gram_hashes(h, k)).all() or len(h) < k
    assert sum(hi - lo for lo, hi in W.slices(pa.array(texts), 8)) == len(texts)


def test_substring_digest_equals_brute_force(docs):
    want = brute.repeats(CORPUS)
    got = rows_of(substring_dedup.substring_digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted((d, *x) for d, x in want.items())
    assert sum(x[1] for x in want.values()) > 1000


def test_substring_with_hot_phrases(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    got = rows_of(substring_dedup.substring_digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted((d, *x) for d, x in brute.repeats(CORPUS).items())


def test_cut_documents_keeps_columns_and_clean_texts(docs):
    out = substring_dedup.cut_documents(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    gone = {d for d, x in brute.repeats(CORPUS).items() if x[1]}
    text = dict(CORPUS)
    for r in out.collect():
        assert (r.text == text[r.doc_id]) == (r.doc_id not in gone)
        assert r.n_chars == len(r.text or "")


def test_repeated_rows_and_missing_ids_share_places(spark):
    t = prose(40)
    rows = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, prose(30))], "doc_id bigint, text string")
    got = rows_of(substring_dedup.substring_digest(rows), "doc_id", "n_removed")
    assert sorted(got[:3]) == [(1, 0), (1, 0), (2, 40)] and {x[1] for x in got[3:]} == {40, 0}


def test_components_equal_brute_force(docs):
    want = brute.groups(CORPUS)
    got = rows_of(ngram_join.ngram_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted((d, *x) for d, x in want.items())
    assert sum(d != x[1] for d, x in want.items()) >= 10


def test_components_over_many_cells(docs, monkeypatch):
    """Small cells split leads and shingles over many tasks; larger texts use several shared shingles."""
    monkeypatch.setattr(ngram_join, "CELL", 2)
    monkeypatch.setattr(ngram_join, "LEADS", 2)
    got = rows_of(ngram_join.ngram_components(docs), "doc_id", "component_id")
    assert got == sorted((d, x[1]) for d, x in brute.groups(CORPUS).items())


def test_families_of_chained_copies_stay_whole(spark):
    """Each copy alters the one before it, so leads leave groups of similar size that only pairs across them join."""
    rng, texts = random.Random(2), []
    for f in range(40):
        w = [f"f{f}w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(12):
            texts.append(" ".join(w))
            for _ in range(2):
                w[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
    rng.shuffle(texts)
    want = brute.groups(list(enumerate(texts)))
    got = rows_of(ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")), "doc_id", "component_id")
    assert got == sorted((d, x[1]) for d, x in want.items())


def test_rows_across_groups_do_not_grow_with_the_square_of_a_family(spark, monkeypatch):
    """Half of a family links with its origin, half is a little too different; the counts come from the tasks."""
    plain, made = ngram_join._across, {}
    for copies in (100, 400):
        rng, rows = random.Random(3), spark.sparkContext.accumulator(0)

        def across(batches, rows=rows):
            for b in plain(batches):
                rows.add(b.num_rows)
                yield b

        monkeypatch.setattr(ngram_join, "_across", across)
        w = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        texts = [" ".join(w)]
        for k in range(copies):
            own = list(w)
            for at in rng.sample(range(5, 145), 1 + k % 6):
                own[at] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own))
        got = rows_of(ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")), "doc_id", "component_id")
        assert got == sorted((d, x[1]) for d, x in brute.groups(list(enumerate(texts))).items())
        assert len({c for _, c in got}) > copies // 4
        made[copies] = rows.value
    assert made[400] <= 8 * max(made[100], 100)


def test_one_document_of_each_group_stays(docs):
    out = ngram_join.one_of_each_group(docs)
    assert out.schema == docs.schema
    assert {r.doc_id for r in out.collect()} == {d for d, x in brute.groups(CORPUS).items() if d == x[1]}


def test_similar_texts_without_or_with_shared_ids(spark):
    """Rows without an id are documents of their own for deduplication, and so are texts that share an id."""
    a, b, c, d = (prose(100) for _ in range(4))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (None, prose(100)), (None, ""), (5, c), (5, d), (3, near(d)), (5, prose(90)), (6, prose(90))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {(r.doc_id, r.text) for r in ngram_join.one_of_each_group(df).collect()}
    assert {r for r in rows if r not in kept} - {(None, b), (None, near(b))} == {(None, near(a)), (5, d)}
    assert len(kept & {(None, b), (None, near(b))}) == 1
    got = ngram_join.ngram_components(df).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, 1), (5, 3), (3, 3), (6, 6)} and len(got) == len(rows)


def test_trie_links_equal_set_arithmetic():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 50, 1 << ngram_join.SKETCH_BITS)

    def ordered(values):
        g = np.array(values, np.int64)
        return g[np.lexsort((g.view(np.uint64), sketch[ngram_join._slot(g.view(np.uint64))]))]

    base = rng.integers(-(2**62), 2**62, 300)
    sets = []
    for _ in range(60):
        own = base[: rng.integers(1, 300)].copy()
        change = rng.random(len(own)) < rng.choice([0, 0.02, 0.05, 0.1, 0.3])
        own[change] = rng.integers(-(2**62), 2**62, change.sum())
        sets.append(ordered(np.unique(own)))
    trie = ngram_join.Trie(sketch)
    for i, s in enumerate(sets):
        trie.add(i, s)
    for s in sets:
        both = [len(np.intersect1d(s, x)) for x in sets]
        want = [i for i, (b, x) in enumerate(zip(both, sets, strict=True)) if 100 * b >= 85 * (len(s) + len(x) - b)]
        assert sorted(trie.links(s)) == want


ITEMS = [("b1", prose(30)), ("b2", "Only Three words"), ("b3", None), ("b4", "?!"), (None, "one two three"), ("b5", "solo"), ("b1", prose(12)), ("b6", prose(10))]


@pytest.mark.parametrize("shard", [decontaminate.SHARD_BYTES, 120])
def test_contamination_equals_brute_force(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "search_shards", lambda b, i, t, n=shard, f=decontaminate.search_shards: f(b, i, t, n))
    texts = CORPUS + [(100_000 + i, f"{prose(i)} {t.upper()}, {prose(3)}") for i, (_, t) in enumerate(ITEMS) if t] + [(200_000, ITEMS[0][1] * 3), (200_001, "solo, Solo solo")]
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = rows_of(decontaminate.contamination_digest(rows, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(texts, ITEMS))
    assert sum(x[2] > 0 for x in got) > 5
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {x[0] for x in brute.contamination(CORPUS, ITEMS) if not x[5]}


LICENSED = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "cc by cc by CC-BY 4.0", "This work is licensed under the GNU General Public License, version 3.",
    "the gnu general public licenses", "mit  LICENSE mit license", "All rights reserved.", "unlimited license", "GNU Lesser General Public License v2.1 or later", "xMIT License", None, "", "Apache Licensé",
]


def test_license_base_equals_brute_force(spark):
    texts = [(i, t) for i, t in enumerate(LICENSED)] + [(500 + d, t) for d, t in CORPUS]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("__norm", F.lit("clash"))
    got = license_scan.license_digest(rows).toPandas().set_index("doc_id")
    for d, n_words, n, first, last, labels in brute.licenses(texts):
        r = got.loc[d]
        assert (r.n_words, r.n_base, r.base_labels) == (n_words, n, labels)
        assert (None if pd.isna(r.first_word) else r.first_word, None if pd.isna(r.last_word) else r.last_word) == (first, last)
        assert set(labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got.loc[1, "labels"] == "apache,apache-2.0" and got.loc[2, "labels"] == "cc-by,cc-by-4.0"
    assert got.loc[6, "labels"] == "all-rights-reserved" and got.loc[8, "labels"] == "lgpl-2.1-or-later"
    assert len(license_scan.rules()) > 200 and got.loc[9, "labels"] == ""


def sentence(tree, rng):
    """A random text that a parsed pattern matches; looks around are left out."""
    out = ""
    for op, x in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(x)
        elif name == "IN":
            kind, value = rng.choice(x)
            out += chr(value) if str(kind) == "LITERAL" else {"CATEGORY_DIGIT": "4", "CATEGORY_NOT_SPACE": "z"}[str(value)]
        elif name == "BRANCH":
            out += sentence(rng.choice(x[1]), rng)
        elif name == "SUBPATTERN":
            out += sentence(x[3], rng)
        elif name == "MAX_REPEAT":
            out += "".join(sentence(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], x[0] + 2))))
        else:
            assert name == "ASSERT_NOT", name
    return out


def test_every_license_rule_runs_on_its_own_words(spark):
    """A text that holds nothing but a rule's words gets the labels that all rules without keywords give it."""
    from re import _parser

    rng, rules = random.Random(5), license_scan.rules()
    texts = [sentence(_parser.parse(r.pattern), rng) for r in rules for _ in range(4)]
    texts += ["released under the MPL 2.0", "BSD 3-Clause", "two-clause BSD", "CC Zero", "MS-PL", "confidential and proprietary", "Confidential and confidential", "a simple reply"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score > 0) for r in license_scan.license_digest(rows).collect()}
    want = [brute.license_labels(t, rules) for t in texts]
    assert [t for i, t in enumerate(texts) if got[i] != (want[i], want[i] != "")] == []
    assert all(want[: 4 * len(rules)]) and want[-1] == "" and want[-8:-6] == ["mpl-2.0", "bsd-3-clause"]
    assert all(any(g in f" {t} " for g in license_scan.gate_words(rules)) for t in texts[:-8])


def test_language_is_learned_and_mixtures_are_seen(spark):
    tongues = {n: [f"{n[0]}{a}{b}{n[1]}" for a in "aeiou" for b in "bdklmnrst"] for n in ("xy", "qz", "fj")}
    rng = random.Random(1)
    say = lambda n, k: " ".join(rng.choice(tongues[n]) for _ in range(k))
    rows = [(i, say(n, 40), n) for i, n in enumerate(["xy", "qz", "fj"] * 40)]
    rows += [(1000, None, "xy"), (1001, "", "xy"), (1002, "12 34 !!", "xy"), (1003, say("xy", 300), None), (1004, say("xy", 120) + " " + say("qz", 80), None), (None, say("fj", 30), "fj")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("p", F.lit(0))
    out = language_mix.language_report(df).toPandas()
    out["doc_id"] = out.doc_id.fillna(-1)
    out = out.set_index("doc_id")
    assert all(out.loc[i, "lang_pred"] == n for i, _, n in rows[:120]) and all(out.loc[i, "held_out"] == brute.held(i, 4) for i, _, _ in rows[:120])
    assert (out.loc[[1000, 1001, 1002], "lang_pred"] == "und").all() and (out.loc[[1000, 1001, 1002], "score"] == 0).all()
    assert out.loc[1003, "lang_pred"] == "xy" and out.loc[1004, "lang_pred"] == "xy" and 0.5 < out.loc[1004, "score"] < 0.7
    assert '"qz"' in out.loc[1004, "languages"] and out.loc[-1, "lang_pred"] == "fj"
    kept = language_mix.with_language(df)
    assert kept.schema == df.schema and kept.count() == len(rows) - 3
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert language_mix.with_language(bare).count() == len(rows) - 3
    assert set(language_mix.language_report(bare).toPandas().lang_pred) == {"und"}


def test_language_that_is_found_goes_on(spark):
    """The stage hands on what it found, whatever label came with the text, and learns from all labelled documents."""
    tongues = {n: [f"{n[0]}{a}{b}{n[1]}" for a in "aeiou" for b in "bdklmnrst"] for n in ("xy", "qz", "fj")}
    rng = random.Random(2)
    say = lambda n, k: " ".join(rng.choice(tongues[n]) for _ in range(k))
    held = [i for i in range(2000) if brute.held(i, 4)][:20]
    rows = [(i, say(n, 40), n) for i, n in enumerate(["xy", "qz"] * 30, 5000)] + [(i, say("fj", 40), "fj") for i in held]
    rows += [(9000, say("xy", 60), None), (9001, say("qz", 60), "xy"), (9002, say("fj", 60), None), (None, say("fj", 60), "qz"), (9003, "12 34", "xy"), (9004, None, "qz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("p", F.lit(0))
    kept = language_mix.with_language(df)
    assert kept.schema == df.schema and kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    found = {r.doc_id: r.lang for r in kept.collect()}
    assert {i: n for i, _, n in rows[:80]} == {i: found[i] for i, _, _ in rows[:80]}
    assert {i: found[i] for i in found if i not in {r[0] for r in rows[:80]}} == {9000: "xy", 9001: "qz", 9002: "fj", None: "fj"}


def test_language_sets_of_any_size_equal_plain_expectation_maximisation():
    """Every nested set in doubles, over many rounds, against the pruned search."""
    rng = np.random.default_rng(3)
    wide = 6
    sizes = [1, 2, 5, 40, 300, 300, 300, 900]
    held = [1, 2, 3, 1, 4, 5, 6, 2]
    like = np.exp(-rng.exponential(4.0, (sum(sizes), wide)))
    first = np.concatenate([[0], np.cumsum(sizes)])
    for d, (n, k) in enumerate(zip(sizes, held, strict=True)):
        like[np.arange(first[d], first[d + 1]), np.arange(n) % k] = 1.0
    got = language_mix._select(like.astype(np.float32), first)
    assert np.allclose(got.sum(1), 1, atol=1e-3)

    def climb(x, share):
        for _ in range(3000):
            share = share * (x / (x @ share)[:, None]).mean(0)
        return share, np.log(x @ share).sum()

    most = []
    for d, n in enumerate(sizes):
        x = like[first[d] : first[d + 1]]
        order = np.argsort(-climb(x, np.full(wide, 1 / wide))[0], kind="stable")
        scores = []
        for k in range(1, wide + 1):
            start = np.zeros(wide)
            start[order[:k]] = 1 / k
            scores.append(climb(x, start)[1] - language_mix.PENALTY * (k - 1) * 0.5 * np.log(max(n, 2)))
        chosen = np.log(x @ got[d].astype(float)).sum() - language_mix.PENALTY * ((got[d] > 0).sum() - 1) * 0.5 * np.log(max(n, 2))
        assert chosen >= max(scores) - max(0.5, language_mix.NEAR * n) - 1e-2
        most.append(1 + int(np.argmax(scores)))
    assert [(row > 0).sum() for row in got] == most and max(most) > 3


def test_texts_are_not_shuffled_to_meet_few_ids(docs):
    """The ids that go are a staged table of known size, not a join whose size Spark guesses from the tables in it."""
    kept = ngram_join.one_of_each_group(docs.withColumn("text", F.upper("text")))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and kept.inputFiles() and all("prismatch-later" in f for f in kept.inputFiles())


def test_base_scores_and_a_proper_model(docs):
    got = context_mixing.score_documents(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    for r, want in zip(got.itertuples(), sorted(brute.unigrams(CORPUS)), strict=True):
        assert tuple(r[1:6]) == want[:5] and math.isclose(r.base_score, want[5], rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_symbol_probabilities_sum_to_one(docs):
    """After any beginning the next symbols' probabilities, and an escaped byte's, add up to 1."""
    m = context_mixing.train(docs.where("text is not null").select("text"))
    assert np.exp(m.escape[m.alphabet == context_mixing.ESCAPE]).sum() == pytest.approx(1)
    top = [int(b) for b in np.flatnonzero(m.alphabet < context_mixing.ESCAPE)]
    for head in (b"", b"w1", b"w12 w3"):
        texts = [head + bytes([b]) for b in top] + [head, head + bytes([np.flatnonzero(m.alphabet == context_mixing.ESCAPE)[0]])]
        buf, at = W.text_bytes(pa.array(texts, pa.binary()), False)
        each, symbol, begin = context_mixing.log_probabilities(m, buf, at)
        p = np.exp(each[begin[:-1] + len(head)])
        p[-1] /= np.exp(m.escape[buf[at[-1] - 1]])
        assert p.sum() == pytest.approx(1, abs=2e-3)


def test_weights_follow_every_decision(docs):
    """A plain loop over the decisions of a text, and the same text among others or alone."""
    m = context_mixing.train(docs.where("text is not null").select("text"))
    texts = [t or "" for _, t in CORPUS] + ["w1 w2 q 漢字 " * 700]
    buf, at = W.text_bytes(pa.array(texts), True)
    scores = context_mixing.text_scores(m, buf, at)
    each, _, begin = context_mixing.log_probabilities(m, buf, at)
    for r in (1, 3, 11, 25, len(texts) - 1):
        one, ends = W.text_bytes(pa.array([texts[r]]), True)
        assert context_mixing.text_scores(m, one, ends)[0] == scores[r]
        symbol, first = context_mixing._symbols(one, ends, m.alphabet)
        two, four, word = context_mixing._contexts(symbol, first, m.blank)
        gates, want = [list(g) for g in context_mixing.GATES], []
        for s, a, b, c in zip(symbol.tolist(), two, four, word, strict=True):
            begins, total = int(m.trees.first[a * context_mixing.SYMBOLS + s]), 0.0
            for step in range(begins, begins + int(m.trees.length[a * context_mixing.SYMBOLS + s])):
                node, turn = m.trees.node[step : step + 1], int(m.trees.turn[step])
                known = [float(x) for x in (m.two[a * context_mixing.SYMBOLS + node[0]], m.four[context_mixing._cells(np.array([b]), node)[0]], m.word[context_mixing._cells(np.array([c]), node)[0]])]
                w = gates[(known[1] != 0) + 2 * (known[2] != 0)]
                p = 1 / (1 + math.exp(-turn * sum(x * y for x, y in zip(w, known, strict=True))))
                total += math.log(p)
                w[:] = [x + context_mixing.RATE * (1 - p) * turn * y for x, y in zip(w, known, strict=True)]
            want.append(total)
        got = each[begin[r] : begin[r + 1]].copy()
        rare = np.flatnonzero(symbol == context_mixing.ESCAPE)
        got[rare] -= m.escape[one[rare]]
        assert got == pytest.approx(want, rel=2e-3, abs=2e-3)


def test_lots_hold_texts_of_one_length(docs, monkeypatch):
    """Long texts do not wait in every lot: the steps are those of each lot's longest text, and no score changes."""
    m = context_mixing.train(docs.where("text is not null").select("text"))
    long = max((t or "" for _, t in CORPUS if " " in (t or "")), key=len)
    column = pa.array([long[20 * k :][: 100 if k % 8 else 800] for k in range(160)])
    want, plain, longest = context_mixing.text_scores(m, *W.text_bytes(column, True)), context_mixing.text_scores, []

    def scores(m, buf, at):
        longest.append(int(np.diff(at).max()))
        return plain(m, buf, at)

    monkeypatch.setattr(context_mixing, "text_scores", scores)
    monkeypatch.setattr(context_mixing, "LOT", 4000)
    assert context_mixing.column_scores(m, column).tolist() == want.tolist() and len(longest) > 5
    as_read = sum(max(len((t or "").encode()) for t in column[lo:hi].to_pylist()) for lo, hi in W.slices(column, 4000))
    assert sum(longest) < 0.7 * as_read


def test_coding_gathers_little(docs, monkeypatch):
    """A context's nodes near the root share a line of 16 cells, and the longest text is not left alone in its lot."""
    context = np.random.default_rng(4).integers(0, 1 << 32, 1000).astype(np.uint32)
    cells = context_mixing._cells(context[:, None], np.arange(context_mixing.SYMBOLS, dtype=np.uint8)[None, :])
    assert all(len(set(c)) == context_mixing.SYMBOLS for c in cells.tolist())
    assert (np.ptp(cells[:, 48:] >> 4, axis=1) == 0).all() and len(np.unique(cells[:, 0])) > 990
    m = context_mixing.train(docs.where("text is not null").select("text"))
    column, plain, lots = pa.array([f"w1 w2 w{k:02} " * 10 for k in range(64)] + [f"w4 q w5 {k} " * 90 for k in range(3)]), context_mixing.text_scores, []
    want = plain(m, *W.text_bytes(column, True))

    def scores(m, buf, at):
        lots.append(np.diff(at).tolist())
        return plain(m, buf, at)

    monkeypatch.setattr(context_mixing, "text_scores", scores)
    monkeypatch.setattr(context_mixing, "LOT", 3000)
    assert context_mixing.column_scores(m, column).tolist() == want.tolist()
    assert len(lots) > 2 and all(900 not in lot or len(lot) > 3 for lot in lots)
    lots.clear()
    monkeypatch.setattr(context_mixing, "LOT", 1 << 20)
    assert context_mixing.column_scores(m, pa.concat_arrays([column[60:]] * 3)).tolist() == want.tolist()[60:] * 3
    assert sum(map(len, lots)) == 7  # equal texts are coded once


def test_words_of_a_block_that_differ_in_their_last_bits(monkeypatch):
    """Words are sorted by most of their bits only; their counts stay apart."""
    monkeypatch.setattr(context_mixing.W, "hash_words", lambda w: (w.buf[w.starts] % 2).astype(np.uint64) + np.uint64(5 << 40))
    texts = pa.array(["a b a b b", "b a", None, "a"])
    rows = next(context_mixing._tokens(iter([pa.record_batch([pa.array([7, 7, 7, 9]), pa.array([False, True, False, False]), texts], ["block", "held_out", "text"])])))
    got = {}
    for word, block, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        got[word - (5 << 40), block] = got.get((word - (5 << 40), block), 0) + n
    assert got == {(1, 7): 2, (0, 7): 3, (1, 9): 1}


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rng = random.Random(2)
    parts = [" ", " ", "a", "b", "e", "the", "in", " the", "\n", "\t", "é", "漢", "🙂", "1", "==", "__", "//", "A", "ы", "▁", "\u0301", "http", "<0x0A>", "</s>", "\x00"]
    texts = [None, "", " ", "  Hello  wörld ", " " * 100 + "x" + " " * 31, "a" * 3000, "the" * 900, "▁x▁▁y"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(1500)] + [t for _, t in CORPUS]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("d", F.lit(1))
    back = pieces.decode(pieces.encode(rows, piece_model()), piece_model()).toPandas().sort_values("doc_id")
    digest = pieces.token_digest(rows, piece_model()).toPandas().sort_values("doc_id")
    for t, ids, decoded, n, sha, sha_back in zip(texts, back.ids, back.decoded, digest.n_tokens, digest.ids_sha256, digest.decoded_sha256, strict=True):
        want = library.encode(t or "")
        assert list(ids) == want and decoded == library.decode(want)
        assert (n, sha, sha_back) == (len(want), brute.sha(",".join(map(str, want))), brute.sha(decoded))


def test_decode_of_lone_bytes(spark):
    rows = spark.createDataFrame([([3 + 0xE6, 3 + 0x41],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(rows, piece_model()).collect()] == ["\ufffdA", "", ""]


def test_urls(spark):
    urls = ["https://A.Example.NET/en/1?x", "http://net/x", "http://sub.net/", "http://sub.net", "https://planet/", "http://example.com/de/#a", "http://m.example.com/en/", "https://x.org/fr/2", "x.org/fr/", None, "", "a://b://c/d", "http://H?/net/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 3)], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = url_filter.url_verdicts(rows).toPandas().drop_duplicates("page_id").set_index("page_id")
    want = [("a.example.net", "/en/1", "example.net/en/", "allow"), ("net", "/x", "net/", "block"), ("sub.net", "/", "net/", "block"), ("sub.net", "", None, None), ("planet", "/", None, None), ("example.com", "/de/", "example.com/de/", "block"), ("m.example.com", "/en/", None, None), ("x.org", "/fr/2", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, None), ("h", "", None, None)]
    for i, (host, path, rule, verdict) in enumerate(want):
        r = got.loc[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    no_rule = rows.where("page_id % 13 = 4")
    assert set(url_filter.url_verdicts(no_rule).toPandas().verdict) == {"allow"}


def test_url_models_separate_hosts(spark):
    rng = random.Random(3)
    rows = [(i, f"https://{'good' if i % 2 else 'spam'}{rng.randrange(99)}.{'example.net/en' if i % 2 else 'bad.net'}/{i}") for i in range(400)]
    rows += [(1000, "https://good7.elsewhere.io/en/1"), (1001, "https://spam8.bad.info/5")]
    got = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id bigint, url string")).toPandas().set_index("page_id")
    assert got.loc[1000, "score"] > got.loc[1001, "score"] and got.loc[1001, "verdict"] == "block" and got.loc[1000, "verdict"] == "allow"


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 24))
    x = (centres[rng.integers(0, 6, 1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    x[7], x[9] = x[8], x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [1.0, None] * 12), (2400, [1.0] * 5), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumn("vector", F.lit(1)).withColumn("score", F.lit(2))
    got = code_index.search(df, F.col("vec_id") % 100 == 0, k=10).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 100)) and (got.groupby("query_id").size() == 10).all()
    d = x.astype(float)
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        np.testing.assert_allclose(part.score, dist[part.vec_id], rtol=1e-12)
        assert list(part["rank"]) == list(range(1, 11)) and q not in set(part.vec_id)
        assert list(zip(part.score, part.vec_id, strict=True)) == sorted(zip(part.score, part.vec_id, strict=True))
        order = np.lexsort((np.arange(1500), np.where(np.arange(1500) == q, np.inf, dist)))[:10]
        hits += len(set(order) & set(part.vec_id))
    assert hits >= 0.9 * len(got)
    few = code_index.search(df.where("vec_id in (0, 1, 2, 2000)"), F.col("vec_id") == 0).toPandas()
    assert list(few["rank"]) == [1, 2]


def test_pigeonhole_retrieval_is_exact():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    codes = code_index.fit(x[:500], 10)
    t = code_index.Tables(codes, np.arange(3000), x)
    for r in (0, 5, 12, 20, 64):
        far = code_index._POP[t.sub ^ t.sub[17]].sum(1)
        assert t._retrieve(t.sub[17], r).tolist() == np.flatnonzero(far <= r).tolist()


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "why"), (2, 3, "assistant", "so"),
             (3, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, None, None), (6, None, "user", "z"), (None, 0, "user", "lost"), (7, 0, "user", "zz")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("side", F.lit("clash"))
    pairs = {(r.conv_id, r.pair_id, r.side) for r in preferences.pair_by_opening(df).collect()}
    assert pairs == {(5, 1, 0), (1, 1, 1), (2, 2, 0), (3, 2, 1), (4, 4, 0), (6, 4, 1)}
    chosen = spark.createDataFrame([(1, 9, 0), (2, 9, 1), (3, 8, 0), (4, 8, 1)], "conv_id bigint, pair_id bigint, side int")
    out = {r.pair_id: r for r in preferences.assemble(preferences.preference_rows(df, chosen)).collect()}
    assert out[9].prompt == "<|user|>\nhi<|end|>\n" and out[9].chosen == "<|assistant|>\nyes<|end|>\n"
    assert [out[9].rejected[s.begin : s.end] for s in out[9].rejected_train] == ["<|assistant|>\nno<|end|>\n", "<|assistant|>\nso<|end|>\n"]
    assert (out[8].prompt, out[8].chosen, out[8].rejected) == ("<|user|>\nsame<|end|>\n", "", "") and out[8].chosen_train == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    for out in (
        substring_dedup.substring_digest(docs), ngram_join.ngram_components(docs), decontaminate.contamination_digest(docs, items), license_scan.license_digest(docs),
        language_mix.language_report(docs), language_mix.with_language(docs), context_mixing.score_documents(docs), pieces.token_digest(docs, piece_model()),
        url_filter.url_verdicts(pages), code_index.neighbour_query(vectors), preferences.preference_query(turns), ngram_join.one_of_each_group(docs), substring_dedup.cut_documents(docs),
    ):
        assert out.count() == 0
    full = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    assert decontaminate.contamination_digest(full, items).first().n_words == 3
