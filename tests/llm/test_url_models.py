"""URL models against a plain dictionary version, and their accuracy on URLs that were not counted."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from prismatch.llm import url_filter as U


def _brute(counted, text):
    """Witten-Bell with contexts of 0 to ORDER bytes; ``counted`` holds (accepted, bytes)."""
    tables = {True: defaultdict(Counter), False: defaultdict(Counter)}
    for side, raw in counted:
        padded = [None] * U.ORDER + list(raw)
        for i, x in enumerate(raw):
            for k in range(U.ORDER + 1):
                tables[side][tuple(padded[i + U.ORDER - k : i + U.ORDER])][x] += 1
    padded, score = [None] * U.ORDER + list(text), 0.0
    for i, x in enumerate(text):
        for side, sign in ((True, 1), (False, -1)):
            p = 1 / 256
            for k in range(U.ORDER + 1):
                seen = tables[side].get(tuple(padded[i + U.ORDER - k : i + U.ORDER]))
                if seen:
                    n = sum(seen.values())
                    p = (seen[x] + len(seen) * p) / (n + len(seen))
            score += sign * math.log(p)
    return score / len(text) if text else 0.0


def _urls(rng, n):
    hosts = ["good.example.net/en", "www.org/fr", "spam.net", "example.com/de", "neither.io", "grüße.example.de", "blog.info"]
    return [f"https://{rng.choice(hosts)}/{rng.choice(['a', 'cheap', 'news'])}{rng.randrange(60)}?q={rng.randrange(9)}" for _ in range(n)]


def _split(spark, rows):
    """Labelled bodies with their side, whether they calibrate, and how often they occur."""
    host, path = U.host_of(F.col("url")), U.path_of(F.col("url"))
    body = F.concat(host, F.lit(U.NOTHING), path)
    back = F.pmod(F.xxhash64(F.lit("calibrate"), body), F.lit(U.HELD_BACK)) == 0
    return rows.select("page_id", body.alias("body"), (U.rule_of(host, path)["verdict"] == "allow").alias("accepted"), back.alias("back")).collect()


def test_scores_and_threshold_equal_brute_force(spark):
    rng = random.Random(5)
    urls = [*_urls(rng, 260), "https://neither.io/" + "long/" * 3000, None, "no-scheme.net/x", "", "https://neither.io/same", "https://neither.io/same"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(5)
    parts = _split(spark, rows)
    counted = [(r.accepted, r.body.encode()) for r in parts if r.accepted is not None and not r.back]
    brute = {b: 0.0 if b == U.NOTHING else _brute(counted, b.encode()) for b in {r.body for r in parts}}
    got = {r.page_id: r for r in U.judge(rows).select("page_id", "__url.*").collect()}
    assert len(got) == len(urls)
    for r in parts:
        assert abs(got[r.page_id].score - brute[r.body]) < 1e-9, r.body
    held = [(r.accepted, brute[r.body]) for r in parts if r.accepted is not None and r.back]
    threshold = got[0].threshold

    def balanced(t):
        share = lambda side, ok: sum(ok(s) for a, s in held if a is side) / sum(a is side for a, _ in held)
        return share(True, lambda s: s >= t) + share(False, lambda s: s < t)

    best = max(balanced(s) for _, s in held)
    assert balanced(threshold) >= best - 1e-9
    free = [r for r in parts if r.accepted is None and r.body != U.NOTHING]
    assert free and all(got[r.page_id].verdict == ("allow" if got[r.page_id].score >= threshold else "block") for r in free)


def test_other_columns_clash_and_stay(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(i, u, i % 7) for i, u in enumerate(_urls(rng, 80))], "page_id bigint, url string, n int")
    rows = rows.select("*", F.lit("b").alias("body"), F.lit(1).alias("score"), F.lit(None).cast("string").alias("found"), F.lit(2).alias("row"), F.lit(0).alias("accepted"))
    out = U.judge(rows)
    assert out.columns == [*rows.columns, "__url"]
    assert sorted(map(tuple, out.drop("__url").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_one_url_that_most_rows_share_is_scored_once(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(_urls(rng, 120) + ["https://neither.io/hot"] * 3000)], "page_id bigint, url string")
    got = U.judge(rows).select("__url.score", "url").where("url like '%/hot'")
    assert got.count() == 3000 and got.select("score").distinct().count() == 1


def test_held_back_accuracy(spark, sf):
    """Rules' URLs that calibrate only are told apart, on the given pages."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    got = {r.page_id: r for r in U.judge(pages).select("page_id", "__url.*").collect()}
    held = [(r.accepted, got[r.page_id].score >= got[r.page_id].threshold) for r in _split(spark, pages) if r.accepted is not None and r.back]
    assert held and sum(a == g for a, g in held) / len(held) > 0.9
