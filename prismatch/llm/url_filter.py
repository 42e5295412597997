"""URL filtering by the ratio of two character language models.

URLs that an explicit rule accepts or rejects are the labelled data; a quarter of
them, by the hash of host and path, is held back for calibration. In the others
each byte is counted under its exact contexts of 0 to ``ORDER`` bytes, for both
classes, as Spark rows by context, so that the models grow with the data. Distinct
URLs then meet, by block, the contexts that their block holds. A URL's score is
the difference of its log-likelihoods under the two variable-order models
(Witten-Bell: a context leans on the next shorter one by the number of its
distinct successors), divided by its length. The threshold is the one with the
best balanced accuracy on the held-back URLs, from a histogram of fixed width.

Defined cases: a null URL or one without ``://`` has an empty host and path, no
rule, score 0 and is allowed; without counted URLs of both classes every score and
the threshold are 0, so the verdict is ``allow``; without held-back URLs of both
classes the threshold is 0; repeated rows each get their row and count as often
as they occur; other columns stay, but for one named like ``out``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.llm import words as W
from prismatch.llm.blocks import BLOCK_ROWS
from prismatch.operators.graph import skew_safe_lookup
from prismatch.session import settled, stage

#: (verdict, host, path): fixed values
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 5
HELD_BACK = 4  # one labelled URL of so many calibrates
SLICE = 256 << 10
NOTHING = "#"  # stands between host and path, neither of which can hold it
BINS = 4001  # scores from -10 to 10 nats per byte
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host or a subdomain, and path prefix) as a struct; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact numbers [order, place] of every byte with its context; ``>> 8`` is the context's.

    A context of k bytes is k digits of 9 bits behind its order; a digit is 0 before
    the start of the row and the byte plus one within it.
    """
    n = int(at[-1])
    x = buf[:n].astype(np.int64)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    digits, out = np.zeros(n, np.int64), np.empty((ORDER + 1, n), np.int64)
    for k in range(ORDER + 1):
        if k:
            back = np.zeros(n, np.int64)
            back[k:] = x[: n - k] + 1
            back[place < k] = 0
            digits |= back << (9 * (k - 1))
        out[k] = (((np.int64(k) << 45) | digits) << 8) | x
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, a, r): how often (accepted, n, body) hold a byte with its context, by class."""
    for b in batches:
        accepted, n = b.column(0).to_numpy(zero_copy_only=False).astype(bool), b.column(1).to_numpy()
        for lo, hi in W.slices(b.column(2), SLICE):
            buf, at = W.text_bytes(b.column(2)[lo:hi], False)
            gram, back = np.unique(_grams(buf, at).ravel(), return_inverse=True)
            times = np.tile(np.repeat(n[lo:hi], np.diff(at)), ORDER + 1)
            good = np.tile(np.repeat(accepted[lo:hi], np.diff(at)), ORDER + 1)
            counts = [np.bincount(back, times * side, len(gram)).astype(np.int64) for side in (good, ~good)]
            yield pa.record_batch([pa.array(gram), *map(pa.array, counts)], ["gram", "a", "r"])


def count_contexts(labelled: DataFrame) -> DataFrame:
    """``ctx, next`` over all rows of (accepted, n, body): each context with its successors, 256 at most, and their counts."""
    grams = labelled.mapInArrow(_tally, "gram bigint, a bigint, r bigint").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    return grams.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.collect_list(F.struct("gram", "a", "r")).alias("next"))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ctx) of (block, body), distinct within a slice."""
    for b in batches:
        blocks = b.column(0).to_numpy()
        for lo, hi in W.slices(b.column(1), SLICE):
            buf, at = W.text_bytes(b.column(1)[lo:hi], False)
            ctx = (_grams(buf, at) >> 8).ravel()
            block = np.tile(np.repeat(blocks[lo:hi], np.diff(at)), ORDER + 1)
            order = np.lexsort((ctx, block))
            ctx, block = ctx[order], block[order]
            head = np.flatnonzero(np.r_[True, (ctx[1:] != ctx[:-1]) | (block[1:] != block[:-1])]) if len(ctx) else order
            yield pa.record_batch([pa.array(block[head]), pa.array(ctx[head])], ["block", "ctx"])


def _score_block(urls: pa.Table, model: pa.Table) -> pa.Table:
    """(body, score): log-likelihood under the accepted model minus the rejected, per byte."""
    if not urls.num_rows:
        return pa.table({"body": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
    following = model["next"].combine_chunks().flatten() if model.num_rows else pa.array([], pa.struct([("gram", pa.int64()), ("a", pa.int64()), ("r", pa.int64())]))
    if isinstance(following, pa.ChunkedArray):
        following = following.combine_chunks()
    gram, *sides = (following.field(c).to_numpy() for c in ("gram", "a", "r"))
    order = np.argsort(gram)
    gram, sides = gram[order], [c[order] for c in sides]
    ctx, of = np.unique(gram >> 8, return_inverse=True)
    total = [np.bincount(of, c, len(ctx)) for c in sides]
    kinds = [np.bincount(of, c > 0, len(ctx)) for c in sides]
    text, scores = urls["body"].combine_chunks(), []
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    for lo, hi in W.slices(text, SLICE):
        buf, at = W.text_bytes(text[lo:hi], False)
        p = [np.full(int(at[-1]), 1 / 256), np.full(int(at[-1]), 1 / 256)]
        for own in _grams(buf, at):  # each order leans on the next shorter context
            if not len(gram):
                break
            i, j = np.minimum(np.searchsorted(gram, own), len(gram) - 1), np.minimum(np.searchsorted(ctx, own >> 8), len(ctx) - 1)
            here, met = gram[i] == own, ctx[j] == own >> 8
            for k in (0, 1):
                n, t = total[k][j] * met, kinds[k][j] * met
                p[k] = np.where(n > 0, (sides[k][i] * here + t * p[k]) / np.maximum(n + t, 1), p[k])
        run = np.concatenate([[0.0], np.cumsum(np.log(p[0]) - np.log(p[1]))])
        scores.append((run[at[1:]] - run[at[:-1]]) / np.maximum(np.diff(at), 1))
    return pa.table({"body": text.cast(pa.string()), "score": pa.array(np.concatenate(scores))})


def score_bodies(bodies: DataFrame, model: DataFrame) -> DataFrame:
    """``body, score`` of distinct bodies, which meet by block the contexts that the block holds."""
    blocks = max(1, bodies.count() // BLOCK_ROWS)
    urls = bodies.select(F.pmod(F.xxhash64("body"), F.lit(blocks)).cast("bigint").alias("block"), "body")
    shards = urls.mapInArrow(_contexts, "block bigint, ctx bigint").distinct().join(model, "ctx").select("block", "next")
    return urls.groupBy("block").cogroup(shards.groupBy("block")).applyInArrow(_score_block, "body string, score double")


def _judged_bodies(rows: DataFrame) -> DataFrame:
    """``body, score, threshold`` for each distinct body of (body, accepted)."""
    bodies = stage(rows.groupBy("body").agg(F.first("accepted").alias("accepted"), F.count(F.lit(1)).alias("n")), "urls")
    back = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("body")), F.lit(HELD_BACK)) == 0
    labelled = bodies.where("accepted is not null")
    seen = {(r.accepted, r.back) for r in labelled.select("accepted", back.alias("back")).distinct().collect()}  # at most four rows
    if not {(True, False), (False, False)} <= seen:
        return bodies.select("body", F.lit(0.0).alias("score"), F.lit(0.0).alias("threshold"))
    model = stage(count_contexts(labelled.where(~back).select("accepted", "n", "body")), "contexts")
    scored = stage(score_bodies(bodies.where(F.col("body") != NOTHING), model), "scores")
    held = skew_safe_lookup(labelled.where(back), scored, "body").select("accepted", "n", "score")
    threshold = _threshold(held) if {(True, True), (False, True)} <= seen else 0.0
    return bodies.select("body").join(scored, "body", "left").select("body", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(threshold).alias("threshold"))


def judge(pages: DataFrame, *, url: str = "url", rules=RULES, out: str = "__url") -> DataFrame:
    """Add struct ``out``: host, path, rule, verdict, score (nats per byte) and the threshold used."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    found = rule_of(host, path, rules)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != out]).alias("row"), host.alias("host"), path.alias("path"), found.alias("found"))
    rows = rows.withColumn("body", F.concat("host", F.lit(NOTHING), "path"))
    labels = rows.select("body", (F.col("found.verdict") == "allow").alias("accepted"))
    bodies = settled(pages.sparkSession, lambda: _judged_bodies(labels), "bodies")
    judged = skew_safe_lookup(rows, bodies, "body")
    allow = F.when((F.col("body") == NOTHING) | (F.col("score") >= F.col("threshold")), "allow").otherwise("block")
    verdict = F.coalesce("found.verdict", allow).alias("verdict")
    return judged.select("row.*", F.struct("host", "path", F.col("found.rule").alias("rule"), verdict, "score", "threshold").alias(out))


def _threshold(scored: DataFrame) -> float:
    """Score with the best balanced accuracy over (accepted, n, score), from a histogram of ``BINS`` cells per class."""
    cell = F.floor((F.least(F.greatest("score", F.lit(-10.0)), F.lit(10.0)) + 10.0) / 20.0 * (BINS - 1)).cast("int")
    rows = scored.groupBy("accepted", cell.alias("cell")).agg(F.sum("n").alias("n")).collect()  # at most 2 * BINS rows
    hist = np.zeros((2, BINS + 1))
    for r in rows:
        hist[int(r.accepted), r.cell + 1] += r.n
    below = hist.cumsum(1) / np.maximum(hist.sum(1, keepdims=True), 1)  # share of the class below cell k
    gain = below[0] - below[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2] / (BINS - 1) * 20.0 - 10.0)


def url_verdicts(pages: DataFrame) -> DataFrame:
    """Per page: host, path, rule and verdict, with the model's score."""
    return judge(pages.select("page_id", "url")).select(F.col("page_id").cast("bigint").alias("page_id"), "__url.host", "__url.path", "__url.rule", "__url.verdict", "__url.score")
