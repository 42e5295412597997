"""Similarity join of n-gram sets in prefix trees.

A text's set holds the hashes of its distinct shingles in one global order: rare
ones first (by a counting sketch of fixed size over all documents), equals by
hash. For a Jaccard similarity of at least ``PERCENT`` two sets of which the
smaller needs ``q`` shared ones (``_shared``) must have ``q`` of their first
shingles in common, where a set of ``n`` has ``n - ceil(PERCENT * n / 100) + q``
first ones: otherwise too few are left behind them.

1. First shingles are counted by block of documents; those of one document are
   dropped. Each block gets its recurring ones and keeps the documents that hold
   enough of them, equal sets once.
2. A kept document is compared with one *lead*: of the smallest documents that
   share its first shingles the most frequent one. Leads are stored in tries,
   documents traverse them. The links found give provisional groups, however
   large. Documents left outside are compared once more, with the least altered
   document that shares their shingles. That is two comparisons per document.
3. Where a first shingle is shared by different groups, pairs across groups are
   formed if it can be the very first that a link of theirs shares: all before it
   is lost to both, so length and position bounds are at their tightest. These
   pairs are compared, in tries again.

A comparison is exact: 100 * intersection >= PERCENT * union of the sets, whose
members are 64-bit hashes. No pairs are made inside a group, frequent shingles
and leads are split over tasks by their counts, and nothing is capped.

Defined cases: null and texts without words have an empty set and no links; a
text of fewer than four words is one shingle; rows that share an id, or have none,
but differ in their texts are documents of their own, told apart by 64 bits; equal rows
are one. Components are those of ids, where rows without one count as one id. Of the
documents of a group the one with the smallest id stays; other columns stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.llm import words as W
from prismatch.llm.blocks import NO_ID, block_of, order_of
from prismatch.operators.graph import component_labels, skew_safe_lookup
from prismatch.session import settled, stage

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 19
PACK = 1 << 16
CELL = 512  # comparisons with one lead in one group
LEADS = 64  # comparisons with different leads in one group
SEGMENT = 64  # shingles of a trie node


def _shingles(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), distinct, sorted by both."""
    h = W.hash_words(w)
    place, row = W.gram_rows(w.first, SHINGLE)
    rows, grams = [row], [W.gram_hashes(h, SHINGLE)[place]]
    n = w.counts()
    for k in range(1, SHINGLE):  # short texts are one shingle
        short = np.flatnonzero(n == k)
        rows.append(short)
        grams.append(W.gram_hashes(h, k)[w.first[short]])
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, n): a scan task's counts in packs of 32-bit numbers."""
    total = np.zeros(1 << SKETCH_BITS, np.int32)
    for b in batches:
        for lo, hi in W.slices(b.column(0)):
            total += np.bincount(_slot(_shingles(W.words_of(b.column(0)[lo:hi]))[1]), minlength=len(total)).astype(np.int32)
    for k in range(0, len(total), PACK):
        yield pa.record_batch([pa.array([k // PACK], pa.int64()), pa.array([total[k : k + PACK].tobytes()], pa.binary())], ["pack", "n"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = np.frombuffer(raw.as_buffer(), np.int32).astype(np.int64)
            total[k] = total[k] + part if k in total else part
    for k, v in total.items():
        yield pa.record_batch([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["pack", "n"])


def _sketch_of(texts: DataFrame) -> np.ndarray:
    """Occurrences by the leading bits of a shingle's hash: half a million numbers whatever the input."""
    out, shape = np.zeros(1 << SKETCH_BITS, np.int64), "pack bigint, n binary"
    for r in texts.mapInArrow(_sketch, shape).repartition("pack").mapInArrow(_added, shape).collect():
        out[r.pack * PACK : (r.pack + 1) * PACK] = np.frombuffer(r.n, np.int64)
    return out


def _shared(n: np.ndarray) -> np.ndarray:
    """First shingles that two sets, the smaller with ``n``, must share."""
    return 1 + n // 20


def _first(n: np.ndarray) -> np.ndarray:
    """First shingles of a set of ``n``."""
    return np.where(n > 0, np.minimum(n - (PERCENT * n + 99) // 100 + _shared(n), n), 0)


def _ordered(w: W.Words, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles in global order by row, each row's begin, and each row's number of first ones."""
    row, gram = _shingles(w)
    order = np.lexsort((gram, sketch[_slot(gram)], row))
    begin = np.searchsorted(row, np.arange(len(w.first)))
    n = np.diff(begin)
    return gram[order], begin, _first(n)


def _first_shingles(sketch) -> object:
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shingle, block, n, doc): for each block of (block, doc, text) its first shingles and their smallest document."""
        for b in batches:
            parts = []
            for lo, hi in W.slices(b.column(2)):
                gram, begin, first = _ordered(W.words_of(b.column(2)[lo:hi]), sketch.value)
                row = np.repeat(np.arange(hi - lo), first)
                at = np.arange(len(row)) - np.repeat(np.cumsum(first) - first, first) + begin[row]
                parts.append((W.signed(gram[at]), b.column(0).to_numpy()[lo:hi][row], b.column(1).to_numpy()[lo:hi][row]))
            gram, block, doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((doc, block, gram))
            gram, block, doc = gram[order], block[order], doc[order]
            head = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])]) if len(gram) else order
            n = np.diff(np.r_[head, len(gram)])
            yield pa.record_batch([pa.array(gram[head]), pa.array(block[head]), pa.array(n, pa.int64()), pa.array(doc[head])], ["shingle", "block", "n", "doc"])

    return firsts


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, shingle, lead) of shingles with two documents or more; a partition holds all rows of its shingles."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    gram, block, n, doc = (t[c].to_numpy() for c in ("shingle", "block", "n", "doc"))
    order = np.lexsort((doc, gram))
    gram, block, n, doc = gram[order], block[order], n[order], doc[order]
    head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    size = np.diff(np.r_[head, len(n)])
    keep = np.repeat(np.add.reduceat(n, head), size) > 1
    lead = np.repeat(doc[head], size)
    yield pa.record_batch([pa.array(block[keep]), pa.array(gram[keep]), pa.array(lead[keep])], ["block", "shingle", "lead"])


def _needed(n, m):
    """First shingles that a pair of sizes must share: all behind the first ones of one of them may match."""
    least = (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)
    return np.maximum(_shared(np.minimum(n, m)), least - np.maximum(n - _first(n), m - _first(m)))


_KEPT = pa.schema([("doc", pa.int64()), ("id", pa.int64()), ("same", pa.int64()), ("lead", pa.int64()), ("grams", pa.binary()), ("marks", pa.binary())])


def _keep(sketch) -> object:
    def keep(docs: pa.Table, shard: pa.Table) -> pa.Table:
        """Documents of one block that share a first shingle: the smallest with each set, and the others' link to it."""
        if not docs.num_rows or not shard.num_rows:
            return _KEPT.empty_table()
        docs = docs.combine_chunks()
        known = shard["shingle"].to_numpy()
        order = np.lexsort((shard["lead"].to_numpy(), known))
        known, leads = known[order], shard["lead"].to_numpy()[order]
        text, keys, ids = docs["text"].chunk(0), docs["doc"].to_numpy(), docs["id"].to_numpy()
        seen: dict[bytes, int] = {}
        sets: dict[int, tuple[int, None, int, bytes, bytes]] = {}
        same: dict[int, tuple[int, int]] = {}
        order = np.lexsort((keys, ids))  # smallest ids first; texts are read in slices below
        ranked, keys, ids = text.take(pa.array(order)), keys[order], ids[order]
        for lo, hi in W.slices(ranked):
            gram, begin, first = _ordered(W.words_of(ranked[lo:hi]), sketch.value)
            gram = W.signed(gram)
            for r in range(hi - lo):
                own = gram[begin[r] : begin[r + 1]]
                front = own[: first[r]]
                place = np.searchsorted(known, front)
                hit = known[np.minimum(place, len(known) - 1)] == front
                if hit.sum() < _shared((PERCENT * len(own) + 99) // 100):  # no partner is smaller
                    continue
                doc, raw = int(keys[lo + r]), own.tobytes()
                kept = seen.setdefault(raw, doc)
                if kept != doc:
                    same[doc] = (int(ids[lo + r]), kept)
                elif doc not in sets:
                    marks = np.flatnonzero(hit).astype("<i4")
                    lead, times = np.unique(leads[place[hit]], return_counts=True)
                    best = int(lead[times.argmax()]) if times.max() >= _needed(len(own), len(own)) else doc
                    sets[doc] = (int(ids[lo + r]), None, best, raw, marks.tobytes())
        rows = [(d, *x) for d, x in sets.items()] + [(d, i, k, None, None, None) for d, (i, k) in same.items()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _KEPT.types, strict=True)], schema=_KEPT) if rows else _KEPT.empty_table()

    return keep


class _Node:
    __slots__ = ("children", "doc", "least", "most", "opens", "part", "shuts", "size")

    def __init__(self, part: np.ndarray, frequency: list[int], size: int):
        self.part, self.children, self.doc, self.size, self.least, self.most = part, {}, [], 0, size, size
        self.opens, self.shuts = frequency[0], frequency[-1]  # sketch counts of its first and last shingle


class Trie:
    """Sets in global order; a node holds a run of shingles and the sizes of the smallest and largest set below it."""

    def __init__(self, sketch: np.ndarray):
        self.sketch, self.root = sketch, _Node(np.zeros(0, np.int64), [0], 0)

    def frequency(self, grams: np.ndarray) -> list[int]:
        return self.sketch[_slot(grams.view(np.uint64))].tolist()

    def add(self, doc: int, grams: np.ndarray) -> None:
        node, at, n = self.root, 0, len(grams)
        while at < n:
            child = node.children.get(int(grams[at]))
            rest = grams[at : at + SEGMENT]
            if child is None:
                child = node.children[int(grams[at])] = _Node(rest, self.frequency(rest), n)
                at += len(rest)
            else:
                m = min(len(rest), len(child.part))
                differ = child.part[:m] != rest[:m]
                shared = int(differ.argmax()) if differ.any() else m
                if shared < len(child.part):  # split the node where the sets part
                    upper = _Node(child.part[:shared], self.frequency(child.part[:shared]), child.most)
                    upper.least = child.least
                    child.part = child.part[shared:]
                    child.opens = self.frequency(child.part[:1])[0]
                    upper.children[int(child.part[0])] = child
                    node.children[int(grams[at])] = child = upper
                child.least, child.most = min(child.least, n), max(child.most, n)
                at += shared
            node = child
        node.doc.append(doc)
        node.size = n

    def links(self, grams: np.ndarray) -> list[int]:
        """Documents whose sets are similar enough to ``grams``."""
        out, n, counts = [], len(grams), self.frequency(grams)
        by_value = np.argsort(grams)
        values = grams[by_value]
        todo = [(self.root, 0, 0, 0)]  # node, depth, overlap, shingles of grams that are behind
        while todo:
            node, depth, overlap, behind = todo.pop()
            if node.doc and 100 * overlap >= PERCENT * (n + node.size - overlap):
                out += node.doc
            for c in node.children.values():
                if 100 * c.most < PERCENT * n or PERCENT * c.least > 100 * n:
                    continue
                # at best all that is left of the shorter side matches; rarer shingles than the child's cannot
                best = overlap + min(c.most - depth, n - max(behind, bisect_left(counts, c.opens)))
                if 100 * best < PERCENT * max(n, c.least):
                    continue
                place = np.minimum(np.searchsorted(values, c.part), n - 1)
                found = by_value[place[values[place] == c.part]]
                have, deep = overlap + len(found), depth + len(c.part)
                now = max(behind, bisect_left(counts, c.shuts), int(found[-1]) + 1 if len(found) else 0)
                if 100 * (have + min(c.most - deep, n - now)) >= PERCENT * max(n, c.least):
                    todo.append((c, deep, have, now))
        return out


def _traverse(sketch) -> object:
    def traverse(key: tuple, rows: pa.Table) -> pa.Table:
        """(doc, lead): links of one cell, its leads in a trie and the other documents traversing it."""
        trie, out = Trie(sketch.value), []
        ids, lead, sets = rows["doc"].to_pylist(), rows["is_lead"].to_pylist(), rows["grams"]
        for d, is_lead, g in zip(ids, lead, sets, strict=True):
            if is_lead:
                trie.add(d, np.frombuffer(g.as_buffer(), np.int64))
        for d, is_lead, g in zip(ids, lead, sets, strict=True):
            if not is_lead:
                out += [(d, k) for k in trie.links(np.frombuffer(g.as_buffer(), np.int64)) if k != d]
        return pa.table([pa.array([d for d, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], ["doc", "lead"])

    return traverse


def _compare(pairs: DataFrame, sets: DataFrame, sketch) -> DataFrame:
    """Links among candidate pairs (doc, lead), found by tries of leads; staged."""
    pairs = stage(pairs, "pairs")
    sizes = stage(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("c")), "leads")
    cells = max(1, pairs.count() // LEADS)
    parts = F.greatest(F.ceil(F.col("c") / CELL), F.lit(1)).cast("int")
    cell = F.pmod(F.xxhash64("lead"), F.lit(cells)).alias("cell")
    follow = skew_safe_lookup(pairs, sizes, "lead").select(cell, F.pmod(F.xxhash64("doc"), parts).cast("int").alias("part"), "doc", F.lit(False).alias("is_lead"))
    ahead = sizes.select(cell, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("lead").alias("doc"), F.lit(True).alias("is_lead"))
    routes = follow.distinct().unionByName(ahead)
    return stage(routes.join(sets, "doc").groupBy("cell", "part").applyInArrow(_traverse(sketch), "doc bigint, lead bigint"), "links")


def _labels(links: DataFrame) -> DataFrame:
    """``doc, root`` of every linked document."""
    both = links.select(F.col("doc").alias("entry"), F.col("lead").alias("cluster")).unionByName(links.select(F.col("lead").alias("entry"), F.col("lead").alias("cluster")))
    return component_labels(both).select(F.col("entry").alias("doc"), "root")


def _fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, doc, n, at, h, r, opens): the ``h`` recurring first shingles of (doc, grams, marks), ranked.

    Where ``opens`` is false, too little lies behind a shingle for it to be the first that any link shares.
    """
    for b in batches:
        grams = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
        marks = [np.frombuffer(x.as_buffer(), "<i4") for x in b.column(2)]
        n = np.array([len(m) for m in marks], int)
        row = np.repeat(np.arange(b.num_rows), n)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own = np.concatenate([g[m] for g, m in zip(grams, marks, strict=True)]) if len(grams) else np.zeros(0, np.int64)
        size = np.array([len(g) for g in grams], np.int64)
        at = np.concatenate(marks).astype(np.int64) if marks else row
        least = (PERCENT * size + 99) // 100  # no partner is smaller, nor is what they share
        opens = (at <= (size - least)[row]) & (n[row] - rank >= _shared(least)[row])
        columns = [own, b.column(0).to_numpy()[row], size[row], at, n[row], rank]
        yield pa.record_batch([*[pa.array(c, pa.int64()) for c in columns], pa.array(opens)], ["shingle", "doc", "n", "at", "h", "r", "opens"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, lead): pairs across groups that share a shingle which can be the first one of a link; a partition holds all rows of its cells.

    From the first shared shingle on both sets must still hold the intersection that
    a link needs, and as many recurring ones as it shares there. A link's own first
    one passes, later ones need not.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    order = np.lexsort((t["doc"].to_numpy(), t["part"].to_numpy(), t["shingle"].to_numpy()))
    names = ("shingle", "part", "doc", "n", "at", "h", "r", "root", "other")
    gram, part, doc, n, at, h, r, root, other = (t[c].to_numpy()[order] for c in names)
    head = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.r_[head, len(gram)])
    head, size = np.repeat(head, size), np.repeat(size, size)

    def rows(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        fits = (root[i] != root[j]) & (~other[j] | ((j < i) & (part[i] == 0)))  # two others meet once
        fits &= PERCENT * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])
        i, j = i[fits], j[fits]
        least = (PERCENT * (n[i] + n[j]) + 99 + PERCENT) // (100 + PERCENT)
        fits = (np.minimum(n[i] - at[i], n[j] - at[j]) >= least) & (np.minimum(h[i] - r[i], h[j] - r[j]) >= _needed(n[i], n[j]))
        i, j = i[fits], j[fits]
        return pa.record_batch([pa.array(np.maximum(doc[i], doc[j])), pa.array(np.minimum(doc[i], doc[j]))], ["doc", "lead"])

    here = np.flatnonzero(other)
    total = np.cumsum(size[here])
    while len(here):  # every other one with its whole cell, about a million pairs at a time
        k = max(1, int(np.searchsorted(total, total[0] - size[here[0]] + (1 << 20))))
        now, here, total = here[:k], here[k:], total[k:]
        n_now = size[now]
        i = np.repeat(now, n_now)
        yield rows(i, head[i] + np.arange(len(i)) - np.repeat(np.cumsum(n_now) - n_now, n_now))


def _grouped(fronts: DataFrame, links: DataFrame) -> DataFrame:
    """The first shingles with ``root``, the group that the links make of their document; staged."""
    groups = _labels(links)
    return stage(fronts.join(groups, "doc", "left").withColumn("root", F.coalesce("root", "doc")), "fronts")


def _clean_leads(fronts: DataFrame) -> DataFrame:
    """(doc, lead): for documents outside the group of the document with the most recurring shingles, that one.

    It is the least altered copy, so what links with any of its group links most likely with it.
    """
    best = fronts.groupBy("shingle").agg(F.max(F.struct("h", "doc", "root")).alias("b"), F.min("root").alias("least"), F.max("root").alias("most"))
    best = best.where("least <> most").select("shingle", F.col("b.doc").alias("lead"), F.col("b.root").alias("lead_root"))
    met = fronts.join(best, "shingle").where("root <> lead_root").groupBy("doc", "lead").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    chosen = met.groupBy("doc").agg(F.max(F.struct("c", "lead"))["lead"].alias("lead"), F.max("c").alias("c"), F.max("n").alias("n"))
    return chosen.where(F.col("c") > F.col("n") / 20).select("doc", "lead")


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells documents apart: rows that share an id, or have none, may differ in their texts."""
    return F.xxhash64(order_of(doc_id), F.col(text).cast("string"))


def similar_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, id, root``: every document (by ``key_of``) that links with another one, its id, and its group."""
    spark = docs.sparkSession
    rows = docs.select(block_of(docs, doc_id, text).alias("block"), key_of(doc_id, text).alias("doc"), order_of(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(_sketch_of(rows.select("text")))
    firsts = rows.select("block", "doc", "text").mapInArrow(_first_shingles(sketch), "shingle bigint, block bigint, n bigint, doc bigint")
    shards = firsts.repartition("shingle").mapInArrow(_recurring, "block bigint, shingle bigint, lead bigint")
    kept = rows.groupBy("block").cogroup(shards.groupBy("block")).applyInArrow(_keep(sketch), "doc bigint, id bigint, same bigint, lead bigint, grams binary, marks binary")
    kept = stage(kept, "sets")
    sets = kept.where("same is null").select("doc", "grams")
    links = _compare(kept.where("same is null and lead <> doc").select("doc", "lead"), sets, sketch)
    shape = "shingle bigint, doc bigint, n bigint, at bigint, h bigint, r bigint, opens boolean"
    all_fronts = stage(kept.where("same is null").select("doc", "grams", "marks").mapInArrow(_fronts, shape), "fronts")
    clean = _clean_leads(_grouped(all_fronts, links))
    links = stage(links.unionByName(_compare(clean, sets, sketch)), "leads")
    fronts = _grouped(all_fronts.where("opens"), links)
    by_group = fronts.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_group.groupBy("shingle").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    parts = F.greatest(F.ceil(F.col("c") / (4 * CELL)), F.lit(1)).cast("int")
    joined = fronts.join(mixed.select("shingle", "main", parts.alias("parts")), "shingle")  # large partitions are split as the join runs
    other = F.col("root") != F.col("main")
    own_part = F.when(other, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")))
    dealt = joined.select("shingle", "doc", "n", "at", "h", "r", "root", other.alias("other"), F.explode(own_part).alias("part"))
    met = dealt.repartition("shingle", "part").mapInArrow(_across, "doc bigint, lead bigint")
    more = _compare(met.distinct(), sets, sketch)
    same = kept.where("same is not null").select("doc", F.col("same").alias("lead"))
    return _labels(links.unionByName(more).unionByName(same)).join(kept.select("doc", "id"), "doc")


def _sizes(column: pa.Array) -> pa.Array:
    out = [np.zeros(0, np.int64)]
    for lo, hi in W.slices(column):
        out.append(np.bincount(_shingles(W.words_of(column[lo:hi]))[0], minlength=hi - lo))
    return pa.array(np.concatenate(out), pa.int64())


def ngram_components(docs: DataFrame) -> DataFrame:
    """Per document: the size of its set and the smallest document reachable by links."""
    size = F.arrow_udf(_sizes, "bigint")
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), order_of().alias("doc"), size(F.col("text").cast("string")).alias("n_shingles"))
    groups = settled(docs.sparkSession, lambda: similar_groups(docs.select("doc_id", "text")), "groups")
    ids = settled(docs.sparkSession, lambda: component_labels(groups.select(F.col("id").alias("entry"), F.col("root").alias("cluster"))), "ids").select(F.col("entry").alias("doc"), "root")
    found = sized.join(ids, "doc", "left")
    component = F.coalesce("root", "doc")
    return found.select("doc_id", "n_shingles", F.when(component != NO_ID, component).alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents without those that a smaller one is reachable from; all columns stay as they are."""
    groups = settled(docs.sparkSession, lambda: similar_groups(docs.select("doc_id", "text")), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct("id", "doc"))["doc"].alias("first"))
    later = skew_safe_lookup(groups, first, "root").where("doc <> first").select(F.col("doc").alias("__doc"))
    later = stage(later, "later")  # of a known size, so that texts are not shuffled to meet few ids
    return docs.withColumn("__doc", key_of()).join(later, "__doc", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
