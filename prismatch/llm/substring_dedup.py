"""Removal of passages that occur earlier in the corpus, by automata of recurring phrases.

Every window of ``WINDOW`` words elects one of its phrases of ``PHRASE`` words:
the one with the smallest hash, the leftmost of equals. Equal windows elect equal
phrases, so a window can recur only where its phrase does.

1. Elected phrases are counted over the corpus; a scan adds them up per block of
   documents first. Those counted twice or more recur.
2. Each block of documents gets the recurring phrases that it holds (its shard),
   compiles them into an Aho-Corasick automaton, and all its texts are streamed
   through it. Around every occurrence the windows that elect it are candidates;
   a block keeps each candidate's first place and removes the later ones.
3. First places meet by phrase - by window for a phrase that occurs more than
   ``HOT`` times - and all but the earliest are removed.

No task holds more than a block, or the places of one phrase that is not hot, or
one place per block of one window.

Windows are told apart by 64 bits of their own and 64 of their phrase.
Defined cases: null has no words; texts under ``WINDOW`` words lose nothing;
repeated rows of one document share its places, so none removes the other's
words; rows without an id count as one document behind all others, in which only
an earlier start removes; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.llm import words as W
from prismatch.llm.blocks import block_of, order_of

WINDOW = 20
PHRASE = 6
HOT = 256
SPREAD = WINDOW - PHRASE + 1  # phrases of a window
_PLACES = "key bigint, block bigint, doc bigint, twin bigint, at int, mask bigint, found binary"


def _elect(grams: np.ndarray, n_words: int) -> np.ndarray:
    """For each place, the place of the leftmost smallest phrase among the next ``SPREAD``."""
    best = np.arange(max(n_words - WINDOW + 1 + SPREAD - 1, 0))
    width = 1
    while width < SPREAD:
        step = min(width, SPREAD - width)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        width += step
    return best


def _windows(w: W.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window places, their rows, their phrases' places, and all phrase hashes."""
    grams = W.gram_hashes(h, PHRASE)
    place, row = W.gram_rows(w.first, WINDOW)
    return place, row, _elect(grams, len(h))[place], grams


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, block, n): elected phrases of a batch of (block, doc, text)."""
    for b in batches:
        phrase, block = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        blocks = b.column(0).to_numpy()
        for lo, hi in W.slices(b.column(2)):
            w = W.words_of(b.column(2)[lo:hi], lower=False)
            place, row, elected, grams = _windows(w, W.hash_words(w))
            new = np.flatnonzero(np.r_[True, elected[1:] != elected[:-1]]) if len(place) else place
            phrase.append(W.signed(grams[elected[new]]))
            block.append(blocks[lo:hi][row[new]])
        phrase, block = np.concatenate(phrase), np.concatenate(block)
        order = np.lexsort((block, phrase))
        phrase, block = phrase[order], block[order]
        head = np.flatnonzero(np.r_[True, (phrase[1:] != phrase[:-1]) | (block[1:] != block[:-1])]) if len(order) else order
        n = np.diff(np.r_[head, len(order)])
        yield pa.record_batch([pa.array(phrase[head]), pa.array(block[head]), pa.array(n, pa.int64())], ["phrase", "block", "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, phrase, hot) of phrases that occur more than once; a partition holds all rows of its phrases."""
    t = _gather(batches)
    if t is None:
        return
    phrase, block, n = (t[c].to_numpy() for c in ("phrase", "block", "n"))
    order = np.lexsort((block, phrase))
    phrase, block, n = phrase[order], block[order], n[order]
    head = np.flatnonzero(np.r_[True, phrase[1:] != phrase[:-1]])
    total = np.repeat(np.add.reduceat(n, head), np.diff(np.r_[head, len(n)]))
    keep = (total > 1) & np.r_[True, (phrase[1:] != phrase[:-1]) | (block[1:] != block[:-1])]
    yield pa.record_batch([pa.array(block[keep]), pa.array(phrase[keep]), pa.array(total[keep] > HOT)], ["block", "phrase", "hot"])


def _joined(w: W.Words) -> tuple[str, np.ndarray]:
    """All words with single spaces between, before and behind, one character a byte; and where each word begins."""
    size = w.ends - w.starts
    before = np.cumsum(size) - size
    begin = before + np.arange(len(size)) + 1
    out = np.full(int(size.sum()) + len(size) + 1, 0x20, np.uint8)
    flat = np.arange(int(size.sum()))
    out[flat + np.repeat(begin - before, size)] = w.buf[flat + np.repeat(w.starts - before, size)]
    return out.tobytes().decode("latin-1"), begin


def _locate(w: W.Words, grams: np.ndarray, elected: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """Whether one of the shard's phrases begins at each word, by streaming the texts through their automaton."""
    at = np.zeros(len(w.starts), bool)
    own = np.unique(elected)
    own = own[np.isin(W.signed(grams[own]), phrases)]
    if not len(own):
        return at
    _, one = np.unique(grams[own], return_index=True)
    own = own[one]
    text, begin = _joined(w)
    last = own + PHRASE - 1
    stop = begin[last] + w.ends[last] - w.starts[last] + 1
    automaton = ahocorasick.Automaton()
    for a, b in zip((begin[own] - 1).tolist(), stop.tolist(), strict=True):
        automaton.add_word(text[a:b], b - a - 2)
    automaton.make_automaton()
    begins = np.fromiter((end - size for end, size in automaton.iter(text)), np.int64)
    at[np.searchsorted(begin, begins)] = True
    return at


def _runs(places: np.ndarray) -> np.ndarray:
    """[begin, end) pairs of sorted places."""
    head = np.flatnonzero(np.r_[True, places[1:] > places[:-1] + 1])
    tail = np.r_[head[1:], len(places)] - 1
    return np.stack([places[head], places[tail] + 1], 1).astype("<i4")


def _by_document(block: np.ndarray, doc: np.ndarray, twin: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    if not len(doc):
        return []
    order = np.lexsort((place, twin, doc))
    block, doc, twin, place = block[order], doc[order], twin[order], place[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (place[1:] != place[:-1])]  # repeated rows have the same places
    block, doc, twin, place = block[new], doc[new], twin[new], place[new]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])])
    return [(int(block[s]), int(doc[s]), int(twin[s]), _runs(place[s:e]).tobytes()) for s, e in zip(head, np.r_[head[1:], len(doc)], strict=True)]


def _later(doc: np.ndarray, place: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of each key's first place, and of the places behind it."""
    order = np.lexsort((place, doc, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    head = np.flatnonzero(new)
    first = np.repeat(order[head], np.diff(np.r_[head, len(order)]))
    behind = (doc[order] > doc[first]) | (place[order] > place[first])
    return order[head], order[behind]


def _confirm(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    """One block: candidate windows' first places, and the runs removed because the block has them earlier."""
    schema = pa.schema([(n, t) for n, t in zip(("key", "block", "doc", "twin", "at", "mask", "found"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)])
    if not docs.num_rows or not phrases.num_rows:
        return schema.empty_table()
    docs, shard = docs.combine_chunks(), phrases["phrase"].to_numpy()
    order = np.argsort(shard)
    shard, hot = shard[order], phrases["hot"].to_numpy()[order]
    text, ids, twins = docs["text"].chunk(0), docs["doc"].to_numpy(), docs["twin"].to_numpy()
    parts = []
    for lo, hi in W.slices(text):
        w = W.words_of(text[lo:hi], lower=False)
        h = W.hash_words(w)
        place, row, elected, grams = _windows(w, h)
        if not len(place):
            continue
        on = _locate(w, grams, elected, shard)[elected]
        place, row, elected = place[on], row[on], elected[on]
        parts.append((W.signed(grams[elected]), W.signed(W.gram_hashes(h, WINDOW)[place]), ids[lo:hi][row], twins[lo:hi][row], place - w.first[row], elected - w.first[row]))
    if not parts:
        return schema.empty_table()
    phrase, window, doc, twin, place, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    first, behind = _later(doc, place, phrase, window)
    number = int(docs["block"][0].as_py())
    removed = _by_document(np.full(len(behind), number), doc[behind], twin[behind], place[behind])
    first = first[np.lexsort((place[first], twin[first], doc[first]))]
    phrase, window, doc, twin, place, at = (x[first] for x in (phrase, window, doc, twin, place, at))
    own = hot[np.minimum(np.searchsorted(shard, phrase), len(shard) - 1)]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (at[1:] != at[:-1]) | own[1:] | own[:-1]]) if len(first) else first
    key = np.where(own, window, phrase)[head]
    mask = np.bitwise_or.reduceat(np.int64(1) << (at - place), head) if len(head) else head
    ends = np.r_[head, len(first)] * 8
    found = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(window.tobytes())])
    places = pa.table([pa.array(key), pa.array(np.full(len(head), number)), pa.array(doc[head]), pa.array(twin[head]), pa.array(at[head].astype(np.int32)), pa.array(mask), found], schema=schema)
    gone = pa.table(
        [pa.array([d for _, d, _, _ in removed], pa.int64()), *[pa.array([r[k] for r in removed], pa.int64()) for k in range(3)],
         pa.nulls(len(removed), pa.int32()), pa.nulls(len(removed), pa.int64()), pa.array([r[3] for r in removed], pa.binary())], schema=schema)
    return pa.concat_tables([places, gone])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, docs, runs) to remove, a row for each block: its own runs, and of the places of one window all but the earliest."""
    t = _gather(batches)
    if t is None:
        return
    place = t.filter(t["at"].is_valid())
    gone = t.filter(t["at"].is_null())
    out = list(zip(*(gone[c].to_pylist() for c in ("block", "doc", "twin", "found")), strict=True))
    if place.num_rows:
        place = place.combine_chunks()
        found = place["found"].chunk(0)
        window = np.frombuffer(b"".join(x.as_py() for x in found), np.int64)
        mask, at = place["mask"].to_numpy(), place["at"].to_numpy()
        back = np.arange(SPREAD - 1, -1, -1)
        row, col = np.nonzero((mask[:, None] >> back) & 1)
        key, doc, twin, block = (place[c].to_numpy()[row] for c in ("key", "doc", "twin", "block"))
        start = at[row].astype(np.int64) - back[col]
        _, behind = _later(doc, start, key, window)
        out += _by_document(block[behind], doc[behind], twin[behind], start[behind])
    out.sort(key=lambda x: x[0])
    block = np.array([r[0] for r in out], np.int64)
    head = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(out) else block
    at = pa.array(np.r_[head, len(out)], pa.int32())
    lists = [pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())]
    yield pa.record_batch([pa.array(block[head]), *[pa.ListArray.from_arrays(at, x) for x in lists]], ["block", "docs", "twins", "runs"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, twin, runs), a row for each document; a partition holds all rows of its blocks."""
    runs: dict[tuple[int, int], list[bytes]] = {}
    for b in batches:
        for d, t, r in zip(*(c.flatten().to_pylist() for c in b.columns), strict=True):
            runs.setdefault((d, t), []).append(r)
    keys = [pa.array([k[i] for k in runs], pa.int64()) for i in range(2)]
    yield pa.record_batch([*keys, pa.array(list(runs.values()), pa.list_(pa.binary()))], ["doc", "twin", "runs"])


def twin_of(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def repeated_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, twin, runs``: for each document with windows that start earlier, lists of int32 pairs [begin, end) of their places.

    ``twin`` is the text's hash: rows that share an id, or have none, may differ in their texts.
    """
    rows = docs.select(block_of(docs, doc_id, text).alias("block"), order_of(doc_id).alias("doc"), F.col(text).cast("string").alias("text"), twin_of(text).alias("twin"))
    counted = rows.drop("twin").mapInArrow(_phrases, "phrase bigint, block bigint, n bigint")
    shards = counted.repartition("phrase").mapInArrow(_recurring, "block bigint, phrase bigint, hot boolean")
    places = rows.groupBy("block").cogroup(shards.groupBy("block")).applyInArrow(_confirm, _PLACES)
    runs = places.repartition("key").mapInArrow(_settle, "block bigint, docs array<bigint>, twins array<bigint>, runs array<binary>")
    return runs.repartition("block").select("docs", "twins", "runs").mapInArrow(_documents, "doc bigint, twin bigint, runs array<binary>")


def _covered(text: pa.Array, runs: pa.Array) -> Iterator[tuple[W.Words, np.ndarray, int, int]]:
    """Words of slices of the texts, and which of them are covered by a run."""
    for lo, hi in W.slices(text):
        w = W.words_of(text[lo:hi], lower=False)
        edge = np.zeros(len(w.starts) + 1, np.int64)
        for r, x in enumerate(runs[lo:hi].to_pylist()):
            for part in x or ():
                pair = np.frombuffer(part, "<i4").reshape(-1, 2).astype(np.int64) + w.first[r]
                np.add.at(edge, pair[:, 0], 1)
                np.add.at(edge, np.minimum(pair[:, 1] - 1 + WINDOW, w.first[r + 1]), -1)
        yield w, np.cumsum(edge)[:-1] > 0, lo, hi


def _kept_texts(w: W.Words, gone: np.ndarray) -> list[str]:
    kept = ~gone
    first = np.concatenate([[0], np.cumsum(kept)])[w.first]
    joined, begin = _joined(W.Words(w.buf, w.starts[kept], w.ends[kept], first))
    at = np.r_[begin, len(joined)]
    return [joined[at[a] : at[b] - 1].encode("latin-1") if b > a else b"" for a, b in zip(first[:-1], first[1:], strict=True)]


def _cut(text: pa.Array, runs: pa.Array) -> pa.Array:
    n, gone, kept = [], [], []
    for w, covered, _, _ in _covered(text, runs):
        total = np.concatenate([[0], np.cumsum(covered)])[w.first]
        n.append(w.counts())
        gone.append(np.diff(total))
        kept += _kept_texts(w, covered)
    none = [np.zeros(0, np.int64)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(n or none)), pa.array(np.concatenate(gone or none)), pa.array(kept, pa.binary())], ["n_words", "n_removed", "kept"])


def cut_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", out: str = "__cut") -> DataFrame:
    """Add struct ``out``: ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space (UTF-8)."""
    found = repeated_runs(docs, doc_id=doc_id, text=text)
    runs = found.select(F.col("doc").alias("__doc"), F.col("twin").alias("__twin"), F.col("runs").alias("__runs"))
    joined = docs.withColumn("__doc", order_of(doc_id)).withColumn("__twin", twin_of(text)).join(runs, ["__doc", "__twin"], "left")
    cut = F.arrow_udf(_cut, "struct<n_words:bigint,n_removed:bigint,kept:binary>")
    return joined.withColumn(out, cut(F.col(text).cast("string"), F.col("__runs"))).drop("__doc", "__twin", "__runs")


def substring_digest(docs: DataFrame) -> DataFrame:
    """Per document: its words, those removed, and the digest of the rest."""
    found = cut_repeats(docs.select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "__cut.n_words", "__cut.n_removed", F.sha2("__cut.kept", 256).alias("kept_sha256")
    )


def cut_documents(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with repeated passages cut out; a text without any stays as it is."""
    found = cut_repeats(docs)
    changed = F.col("__cut.n_removed") > 0
    new: dict[str, Column] = {text: F.when(changed, F.col("__cut.kept").cast("string")).otherwise(F.col(text))}
    if n_chars in docs.columns:
        new[n_chars] = F.when(changed, F.length(F.col("__cut.kept").cast("string"))).otherwise(F.col(n_chars))
    return found.withColumns(new).select(*[F.col(f"`{c}`").cast(docs.schema[c].dataType) for c in docs.columns])
