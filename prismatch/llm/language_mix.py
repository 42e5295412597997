"""Language identification by mixture inference.

Byte trigrams of the labelled texts are counted by language in a hashed table of
fixed width. A document is a mixture: every word is drawn from one language, and
expectation-maximisation over its words, run until it has converged, estimates
the languages' proportions. Of all nested sets of its likeliest languages, from
one to every learned language, the one with the best penalised likelihood is
kept; the prediction is that set's largest language.

Defined cases: null, empty and letterless texts are ``und`` with score 0, as are
all texts when nothing is labelled; repeated rows get equal results; other
columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.llm import words as W
from prismatch.llm.splits import held_out

SLOT_BITS = 16
NEAR = 1e-3  # nats a word that further rounds could gain
FLOOR = -46.0  # least log-likelihood of a word against its best language
PENALTY = 4.0  # times log(words) / 2 for each further language
UNKNOWN = "und"
_RESULT = "struct<lang:string,score:double,langs:array<struct<lang:string,share:double>>>"


def _trigram_slots(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams of all words (a word is padded by one space on both sides), and each word's first."""
    size = w.ends - w.starts
    begin = np.cumsum(size) - size
    flat = np.arange(int(size.sum()))
    at = flat + np.repeat(w.starts - begin, size)
    mid = w.buf[at].astype(np.uint32)
    before, after = np.empty_like(mid), np.empty_like(mid)
    before[1:], after[:-1] = mid[:-1], mid[1:]
    before[begin] = after[begin + size - 1] = 0x20
    key = (before << np.uint32(16)) | (mid << np.uint32(8)) | after
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64), begin


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) of a partition's labelled texts."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        names = b.column(1).dictionary_encode()
        for lo, hi in W.slices(b.column(0)):
            w = W.words_of(b.column(0)[lo:hi])
            if not len(w.starts):
                continue
            slot, begin = _trigram_slots(w)
            lang = np.repeat(names.indices.to_numpy()[lo:hi][w.rows()], w.ends - w.starts)
            for k in np.unique(lang):
                have = total.setdefault(names.dictionary[int(k)].as_py(), np.zeros(1 << SLOT_BITS, np.int64))
                have += np.bincount(slot[lang == k], minlength=1 << SLOT_BITS)
    for name, n in total.items():
        on = np.flatnonzero(n)
        yield pa.record_batch([pa.array([name] * len(on), pa.string()), pa.array(on), pa.array(n[on])], ["lang", "slot", "n"])


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probabilities [slot, language] of their trigrams, from all rows of (text, lang)."""
    rows = labelled.mapInArrow(_count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # at most languages * 65,536 rows
    names = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((1 << SLOT_BITS, len(names)))
    column = {n: i for i, n in enumerate(names)}
    counts[table["slot"].to_numpy(), [column[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    return names, np.log((counts + 0.1) / (counts.sum(0) + 0.1 * (1 << SLOT_BITS))).astype(np.float32) if names else counts


def _sum_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive blocks of rows (blocks may be empty)."""
    out = np.zeros((len(first) - 1, values.shape[1]), values.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, first[some], 0)
    return out


def _mix(like: np.ndarray, first: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions, log-likelihood (up to a part of its own for each word) and how much more any shares could reach.

    Every document has a word. Expectation-maximisation goes on for each document until no other shares of its languages
    could raise its log-likelihood by more than ``NEAR`` a word (half a nat for a short text); the largest factor of a
    round bounds that. The likelihood's shortfall after t rounds is at most log(languages) / t a word, so the rounds are
    bounded too.
    """
    best, score, lack = share.astype(np.float32), np.zeros(len(share)), np.zeros(len(share))
    live = np.arange(len(share))
    while len(live):
        n = np.diff(first)
        row = np.repeat(np.arange(len(live)), n)
        own = best[live]
        total = (like * own[row]).sum(1, keepdims=True)
        factor = _sum_rows(like / total, first) / n[:, None]
        score[live] = _sum_rows(np.log(total.astype(float)), first)[:, 0]
        gain = np.maximum(np.where(own > 0, factor, 0).max(1) - 1.0, 0.0)
        lack[live] = gain * n
        more = gain > np.maximum(NEAR, 0.5 / n)
        grown = own[more] * factor[more]
        best[live[more]] = grown / grown.sum(1, keepdims=True)
        like, first, live = like[more[row]], np.concatenate([[0], np.cumsum(n[more])]), live[more]
    return best, score, lack


def _select(like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of the set of languages with the best penalised likelihood, out of all nested sets of the likeliest ones.

    A set is tried as long as the likelihood of all languages together, less its penalty, could still be the best.
    """
    n, wide = np.diff(first), like.shape[1]
    share, full, lack = _mix(like, first, np.full((len(n), wide), 1 / wide))
    order = np.argsort(-share, 1, kind="stable")
    best, best_score = share, np.full(len(n), -np.inf)
    for k in range(1, wide + 1):
        cost = PENALTY * (k - 1) * 0.5 * np.log(np.maximum(n, 2))
        on = np.flatnonzero(full + lack - cost > best_score)
        if not len(on):
            break  # larger sets cost more still
        start = np.zeros((len(on), wide))
        np.put_along_axis(start, order[on, :k], np.take_along_axis(share[on], order[on, :k], 1) + 1e-3, 1)
        keep = np.zeros(len(n), bool)
        keep[on] = True
        inside = like[np.repeat(keep, n)]
        own, score, _ = _mix(inside, np.concatenate([[0], np.cumsum(n[on])]), start / start.sum(1, keepdims=True))
        better = score - cost[on] > best_score[on]
        best[on[better]], best_score[on[better]] = own[better], (score - cost[on])[better]
    return best


def infer(column: pa.Array, names: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [row, language] within the selected set (others 0), and each row's words."""
    shares, words = [np.zeros((0, len(names)), np.float32)], [np.zeros(0, np.int64)]
    for lo, hi in W.slices(column, max(1 << 16, (W.SLICE_BYTES * 4) // max(len(names), 4))):
        w = W.words_of(column[lo:hi])
        n = w.counts()
        words.append(n)
        shares.append(np.zeros((hi - lo, len(names)), np.float32))
        if not len(w.starts):
            continue
        slot, begin = _trigram_slots(w)
        log_like = np.add.reduceat(table[slot], begin, 0)
        like = np.exp(np.maximum(log_like - log_like.max(1, keepdims=True), FLOOR))
        some = np.flatnonzero(n > 0)
        shares[-1][some] = _select(like, np.concatenate([[0], np.cumsum(n[some])]))
    return np.concatenate(shares), np.concatenate(words)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predictor(labelled: DataFrame):
    """A function of a text column: struct of ``lang``, ``score`` (its share) and ``langs`` (the selected set)."""
    names, table = fit(labelled)
    model = labelled.sparkSession.sparkContext.broadcast(table)

    def run(column: pa.Array) -> pa.Array:
        share, _ = infer(column, names, model.value)
        best = share.argmax(1) if len(share) else np.zeros(0, int)
        some = share.sum(1) > 0
        langs = [[{"lang": names[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if s[k] > 0] for s in share]
        lang = pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)], pa.string())
        score = pa.array(np.minimum(share.max(1).astype(float), 1.0) if len(share) else np.zeros(0))
        return pa.StructArray.from_arrays([lang, score, pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["lang", "score", "langs"])

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    call = F.arrow_udf(run, _RESULT).asNondeterministic()  # else a condition on what is found would infer it once more
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.array().cast("array<struct<lang:string,share:double>>").alias("langs"))

    def predict(text: Column) -> Column:
        return F.when(has_letter(text), call(text.cast("string"))).otherwise(none) if names else none

    predict.languages = names
    return predict


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())


def _training(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: predicted language and its share; learned from the documents that are not held out."""
    predict = predictor(_training(_labelled(docs).where(~held_out(F.col("doc_id"), 4))))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id"), 4).alias("held_out"), predict(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", F.to_json("p.langs").alias("languages"))


def with_language(docs: DataFrame) -> DataFrame:
    """The documents in which a language was found, with it in ``lang``; the other columns stay as they are.

    Learned from every labelled document, as nothing is measured here. Without any
    there are no languages to tell apart, and those with a letter stay as they are.
    """
    predict = predictor(_training(_labelled(docs)))
    if not predict.languages:
        return docs.where(has_letter(F.col("text")))
    found = docs.withColumn("__language", predict(F.col("text"))["lang"])
    kind = docs.schema["lang"].dataType
    return found.where(F.col("__language") != UNKNOWN).withColumn("lang", F.col("__language").cast(kind)).drop("__language")
