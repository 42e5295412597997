"""Language-model scores by online logistic context mixing.

A text is its lower-cased bytes and an end. Frequent bytes are symbols, others an
escape followed by the byte. After two symbols the next one is coded by binary
decisions along a tree for the two, so frequent successors take few. Three
predictors give the probability of each decision from counts: after the last two
symbols, and in hashed contexts after the last four and the word so far. Their logits
are added with weights that a gate chooses (which contexts are known). Every text
starts from the same weights and learns its own online: after each decision the
chosen set moves along the error that it has just made, before the next decision is
coded. The sum over all decisions is the text's log-probability, hence its bits per byte.

A decision needs the one before it, so the texts of a batch are coded side by side:
their first decisions in one numpy step, then their second ones. Where only a few long
texts are left they are coded one after the other, with the same double-precision
operations, so a score does not depend on the texts beside it. A batch is dealt into
lots by length, the longest texts first, as the steps of a lot are those of its longest
text. Nearly all decisions know all contexts, so their weights lie side by side and need
no gathering; the cells of a context lie in one line of memory.

All counts cover all training texts: Spark adds tables of fixed size over the
scan tasks. Token counts for the base score meet the texts by blocks of
documents, so the vocabulary is never gathered anywhere.

Defined cases: null is the empty text, which has its end only; a document without
an id is never held out; without training texts every count is 0; repeated rows
get equal results; other columns take no part. Tokens are told apart by 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatch.llm import words as W
from prismatch.llm.blocks import block_of
from prismatch.llm.splits import held_out
from prismatch.session import stage

SYMBOLS = 64  # frequent bytes, escape, end
ESCAPE, END = SYMBOLS - 2, SYMBOLS - 1
PAIRS = SYMBOLS * SYMBOLS
CELL_BITS = 21  # cells of decisions of each hashed predictor
PREDICTORS = 3
PACK = 1 << 16
RATE = 0.01  # of learning, after every decision
SQUASH, CLIP = 256.0, 16.0  # weights are in units of 1 / SQUASH; errors are read from a table of the logits up to CLIP in these units
FEW = 32  # texts that are quicker coded one after the other
SIDE, SHORT = 1 << 16, 8  # symbols of all texts whose decisions are held at once, and of each text at least
GATES = ((0.9, 0.1, 0.1), (0.2, 0.8, 0.2), (0.2, 0.2, 0.8), (0.05, 0.6, 0.5))  # weights by known contexts: none, four, word, both
LITTLE = 0.2  # added to both counts of a decision
SLICE = 128 << 10  # of text at a time: the arrays of its contexts stay small
LOT = 12 << 20  # of text coded side by side
_MOVE = RATE * SQUASH / (1 + np.exp(np.arange(-CLIP, CLIP + 1 / SQUASH, 1 / SQUASH)))  # by logit: the rate times the probability of the other turn
_MIDDLE = CLIP * SQUASH
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Trees:
    length: np.ndarray  # by the two preceding symbols and the symbol: decisions
    first: np.ndarray  # and where they begin among the steps
    node: np.ndarray  # by step: its node
    turn: np.ndarray  # and the decision itself, 1 or -1

    @cached_property
    def path(self) -> np.ndarray:
        """By step: twice its node, and 1 more for the turn 1."""
        return self.node * np.uint8(2) + (self.turn > 0)


def _alphabet(histogram: np.ndarray) -> np.ndarray:
    """Symbol of each byte: the most frequent ones in order, else ``ESCAPE``."""
    out = np.full(256, ESCAPE, np.int64)
    out[np.argsort(-histogram, kind="stable")[:ESCAPE]] = np.arange(ESCAPE)
    return out


def _symbols(buf: np.ndarray, at: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each followed by its end, and where each text begins."""
    n = int(at[-1])
    rows = len(at) - 1
    begin = at + np.arange(rows + 1)
    out, inner = np.full(n + rows, END, np.int64), np.ones(n + rows, bool)
    inner[begin[1:] - 1] = False
    out[inner] = alphabet.take(buf[:n])
    return out, begin


def _two(symbol: np.ndarray, begin: np.ndarray, most: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
    """The last two symbols as one number, and the last ``most`` one by one; before a text there are ends."""
    n = len(symbol)
    back = []
    for k in range(1, most + 1):
        b = np.empty(n, np.int64)
        b[k:] = symbol[: max(n - k, 0)]
        early = (begin[:-1, None] + np.arange(k)).ravel()
        b[early[early < n]] = END
        back.append(b)
    return back[0] * SYMBOLS + back[1], back


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers of ``base`` from 0 to ``n``."""
    known = _POWERS.get(base)
    if known is None or len(known) <= n:
        known = _POWERS[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, SLICE), base)])
    return known[: n + 1]


_POWERS: dict[np.uint64, np.ndarray] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another 32-bit number for each, in place: all bits bear on the upper ones."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h


def _contexts(symbol: np.ndarray, begin: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last two symbols as one number, 32-bit hashes of the last four and of the word so far."""
    n = len(symbol)
    two, back = _two(symbol, begin, 4)
    four = _mixed(((two * SYMBOLS + back[2]) * SYMBOLS + back[3]).astype(np.uint32))
    # the word so far: a difference of running sums, scaled to the word's begin
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((symbol.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, n)[:-1])])
    since = np.maximum.accumulate(np.where(blank[back[0]], np.arange(n), 0))
    word = W.mix((sums[:-1] - sums[since]) * _powers(_INVERSE, n)[since] + two.astype(np.uint64))
    return two, four, (word >> np.uint64(32)).astype(np.uint32)


def _places(context: np.ndarray) -> np.ndarray:
    """Cell of each hashed context; its nodes are around it, those near the root side by side in memory."""
    return (context >> np.uint32(32 - CELL_BITS)).astype(np.int64)


def _cells(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Cell of each decision: hashed contexts at tree nodes."""
    return _places(context) ^ node


def _decisions(m: Trees, two: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol its number of decisions and the end of them, and for every decision its symbol and its place in the path tables."""
    cell = two * SYMBOLS + symbol
    n = m.length[cell].astype(np.int64)
    until = np.cumsum(n)
    head = np.zeros(until[-1], np.int8)  # every symbol has a decision
    head[until[:-1]] = 1
    row = np.cumsum(head, dtype=np.int64)
    step = (m.first[cell] - until + n).take(row)
    step += np.arange(len(step))
    return n, until, row, step


def _packed(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(total), PACK):
        if total[k : k + PACK].any():
            yield pa.record_batch([pa.array([k // PACK], pa.int64()), pa.array([total[k : k + PACK].tobytes()], pa.binary())], ["pack", "n"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of packs, in single precision: they only become logits."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = np.frombuffer(raw.as_buffer(), np.int32)
            if k in total:
                total[k] += part
            else:
                total[k] = part.astype(np.int64)
    for k, v in total.items():
        yield pa.record_batch([pa.array([k], pa.int64()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["pack", "n"])


def _tally(total: np.ndarray, at: np.ndarray) -> None:
    np.add.at(total, at, np.ones(len(at), total.dtype))


def _sum_tables(texts: DataFrame, count, size: int) -> np.ndarray:
    """Sum over all partitions of the table of ``size`` numbers that a counter adds to."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)  # a scan task reads far fewer than 2^31 bytes
        for b in batches:
            for lo, hi in W.slices(b.column(0), SLICE):
                count(*W.text_bytes(b.column(0)[lo:hi], True), total)
        yield from _packed(total)

    shape = "pack bigint, n binary"
    out = np.zeros(size, np.float32)
    for r in texts.mapInArrow(scan, shape).repartition("pack").mapInArrow(_added, shape).toLocalIterator():
        part = np.frombuffer(r.n, np.float32)
        out[r.pack * PACK : r.pack * PACK + len(part)] = part
    return out


@dataclass
class Model:
    alphabet: np.ndarray
    escape: np.ndarray  # log probability of a byte after an escape
    blank: np.ndarray  # by symbol: whether a word ends with it
    trees: Trees
    two: np.ndarray  # logits by the two preceding symbols and node
    four: np.ndarray  # logits of the cells after four symbols
    word: np.ndarray  # and after the word so far

    @cached_property
    def toward(self) -> np.ndarray:
        """By step of the trees: the logit of ``two`` for the turn that is taken."""
        at = np.repeat(np.arange(0, PAIRS * SYMBOLS, SYMBOLS, np.int32), self.trees.length.reshape(PAIRS, SYMBOLS).sum(1, dtype=np.int64))
        at += self.trees.node
        out = self.two[at]
        out *= self.trees.turn
        return out


def _tree(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Huffman paths: for every symbol its (node, turn) decisions from the root."""
    heap = [(w, i, i) for i, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    child: dict[int, tuple[int, int]] = {}
    new = SYMBOLS
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        child[new] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], new, new))
        new += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
    todo = [(heap[0][2], [])]
    while todo:
        node, path = todo.pop()
        if node < SYMBOLS:
            paths[node] = path
        else:
            todo += [(c, [*path, (node - SYMBOLS, k)]) for k, c in enumerate(child[node])]
    return paths


def _trees(follow: np.ndarray) -> Trees:
    """Trees from the counts [two preceding, symbol]; rare pairs lean on the symbols' own counts."""
    lean = follow.sum(0) / max(follow.sum(), 1) + 1e-3
    length, node, turn = np.zeros(PAIRS * SYMBOLS, np.uint8), [], []
    plain = _tree(lean)
    for two, row in enumerate(follow):
        for s, p in enumerate(_tree(row * SYMBOLS + lean) if row.any() else plain):
            length[two * SYMBOLS + s] = len(p)
            node += [n for n, _ in p]
            turn += [2 * t - 1 for _, t in p]
    first = np.cumsum(length, dtype=np.int64) - length
    return Trees(length, first.astype(np.int32), np.array(node, np.uint8), np.array(turn, np.int8))


def train(texts: DataFrame) -> Model:
    """A model of all rows of the one text column: bytes first, then their successors, then decisions."""
    histogram = _sum_tables(texts, lambda buf, at, total: _tally(total, buf[: at[-1]].astype(np.int64)), 256)
    alphabet = _alphabet(histogram)
    rare = np.where(alphabet == ESCAPE, histogram + 1.0, 0.0)
    escape = np.log(np.maximum(rare / rare.sum(), 1e-30))
    blank = np.zeros(SYMBOLS, bool)
    blank[[*alphabet[[0x20, *range(0x09, 0x0E)]], END]] = True
    blank[ESCAPE] = False

    def follow(buf: np.ndarray, at: np.ndarray, total: np.ndarray) -> None:
        symbol, begin = _symbols(buf, at, alphabet)
        _tally(total, _two(symbol, begin)[0] * SYMBOLS + symbol)

    after = _sum_tables(texts, follow, PAIRS * SYMBOLS).reshape(PAIRS, SYMBOLS).astype(float)
    trees = _trees(after)
    two = np.zeros((PAIRS, SYMBOLS), np.float32)
    for pair in np.flatnonzero(after.any(1)):
        weight = np.repeat(after[pair], trees.length[pair * SYMBOLS : (pair + 1) * SYMBOLS])
        at = trees.first[pair * SYMBOLS] + np.arange(len(weight))
        yes = np.bincount(trees.node[at], np.where(trees.turn[at] > 0, weight, 0), SYMBOLS)
        no = np.bincount(trees.node[at], np.where(trees.turn[at] < 0, weight, 0), SYMBOLS)
        two[pair] = np.log((yes + LITTLE) / (no + LITTLE))

    def decide(buf: np.ndarray, at: np.ndarray, total: np.ndarray) -> None:
        symbol, begin = _symbols(buf, at, alphabet)
        pair, four, word = _contexts(symbol, begin, blank)
        _, _, row, step = _decisions(trees, pair, symbol)
        path = trees.path.take(step)
        for k, context in enumerate((four, word)):
            at = (_places(context) * 2).take(row)
            at ^= path
            _tally(total[k * 2 << CELL_BITS :], at)

    counts = _sum_tables(texts, decide, 4 << CELL_BITS).reshape(2, -1, 2)
    four, word = np.log((counts[:, :, 1] + np.float32(LITTLE)) / (counts[:, :, 0] + np.float32(LITTLE)))
    return Model(alphabet, escape, blank, trees, two.ravel(), four, word)


def _side_by_side(weights: np.ndarray, doc: np.ndarray, inputs: np.ndarray, start: np.ndarray, order: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Logits of decisions of many texts: those of rank 0, then of rank 1, each with the weights that the ranks before have left.

    Texts take their places by ``order``, the ones with most decisions first, so that ``many`` texts from the first on
    have a decision of a rank. Nearly all decisions know both contexts: their weights lie side by side. The others
    change places with the ones that they need, for their rank.
    """
    rows, at, doc = weights.shape[2], start[order], doc[order]
    odd = np.flatnonzero((inputs[1] == 0) | (inputs[2] == 0))
    text = np.searchsorted(start, odd, "right") - 1
    rank = odd - start[text]
    by_rank = np.argsort(rank.astype(np.uint16) if len(many) < 1 << 16 else rank, kind="stable")
    place = np.argsort(order)[text[by_rank]]
    odd, place = odd[by_rank], np.argsort(order)[text[by_rank]]
    gate = (inputs[1, odd] != 0) + 2 * (inputs[2, odd] != 0)
    own = (gate * (PREDICTORS * rows) + doc[place])[:, None] + np.arange(PREDICTORS) * rows
    inside = place[:, None] + np.arange(PREDICTORS) * len(doc)
    odd_until = np.cumsum(np.bincount(rank, minlength=len(many))).tolist()
    both = weights[-1].take(doc, axis=1)
    x, flat, flat_both, lo, odd_lo = np.empty(inputs.shape[1]), weights.reshape(-1), both.reshape(-1), 0, 0
    for n, odd_hi in zip(many.tolist(), odd_until, strict=True):
        here, w, out = at[:n], both[:, :n], x[lo : lo + n]
        if odd_hi > odd_lo:
            from_, to = own[odd_lo:odd_hi], inside[odd_lo:odd_hi]
            aside = flat_both.take(to)
            flat_both[to] = flat.take(from_)
        add = inputs.take(here, axis=1, mode="clip")
        here += 1
        part = w * add
        np.add(part[0], part[1], out=out)
        out += part[2]
        np.multiply(add, _MOVE.take((out + _MIDDLE).astype(np.int64), mode="clip"), out=part)
        w += part
        if odd_hi > odd_lo:
            flat[from_] = flat_both.take(to)
            flat_both[to] = aside
            odd_lo = odd_hi
        lo += n
    weights[-1][:, doc] = both
    return x


def _one_by_one(weights: np.ndarray, doc: np.ndarray, inputs: np.ndarray, start: np.ndarray, order: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The same logits, text by text."""
    move, last, x = _MOVE.tolist(), len(_MOVE) - 1, np.empty(inputs.shape[1])
    gate = (inputs[1] != 0) + 2 * (inputs[2] != 0)
    until, before = np.append(start[1:], len(x)), np.cumsum(many) - many
    for place, text in enumerate(order.tolist()):
        here, out = slice(start[text], until[text]), []
        sets, now = weights[:, :, doc[text]].tolist(), len(GATES) - 1
        u, v, z = sets[now]
        for k, a, b, c in zip(gate[here].tolist(), *inputs[:, here].tolist(), strict=True):
            if k != now:
                sets[now] = u, v, z
                u, v, z = sets[k]
                now = k
            each = u * a + v * b + z * c
            out.append(each)
            at = int(each + _MIDDLE)
            e = move[0 if at < 0 else at if at < last else last]
            u += a * e
            v += b * e
            z += c * e
        sets[now] = u, v, z
        weights[:, :, doc[text]] = sets
        x[before[: len(out)] + place] = out
    return x


@dataclass
class Part:
    """Some symbols of some texts, coded."""

    doc: np.ndarray  # texts
    n: np.ndarray  # symbols of each
    place: np.ndarray  # of the symbols among those of all texts
    until: np.ndarray  # by symbol: the end of its decisions
    order: np.ndarray  # of the texts, those with most decisions first
    many: np.ndarray  # by rank: texts that have a decision of that rank
    each: np.ndarray  # log-probability of each decision, by rank and text
    rare: np.ndarray  # symbols that are escaped bytes
    byte: np.ndarray  # and the log-probability of the byte

    def by_text(self) -> tuple[np.ndarray, np.ndarray]:
        """The log-probabilities text by text, and how many each text has."""
        n = np.diff(self.until[np.cumsum(self.n) - 1], prepend=0)
        rank = np.arange(len(self.each)) - np.repeat(np.cumsum(n) - n, n)
        return self.each[(np.cumsum(self.many) - self.many)[rank] + np.repeat(np.argsort(self.order), n)], n


def _coded(m: Model, buf: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> Iterator[Part]:
    """Parts of all texts, those of a text in order; fills ``symbol``."""
    rows = len(at) - 1
    begin = at + np.arange(rows + 1)
    two, four, word = (np.empty(begin[-1], t) for t in (np.uint16, np.uint32, np.uint32))
    lo = 0
    while lo < rows:  # contexts of a few texts at a time
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
        some, first = _symbols(buf[at[lo] :], at[lo : hi + 1] - at[lo], m.alphabet)
        here = slice(begin[lo], begin[hi])
        symbol[here] = some
        two[here], four[here], word[here] = _contexts(some, first, m.blank)
        lo = hi
    weights = np.repeat(np.array(GATES) * SQUASH, rows).reshape(len(GATES), PREDICTORS, rows)  # of each gate and text
    size = np.diff(begin)
    longest = np.argsort(-size, kind="stable")
    done, left = 0, rows
    while left := int(np.searchsorted(-size[longest[:left]], -done, "left")):  # the longest ones have more than ``done`` symbols
        doc = longest[:left]
        most = max(SHORT, SIDE // left)
        if left > FEW:  # not beyond the place where few are left
            most = min(most, size[longest[FEW]] - done)
        n = np.minimum(size[doc] - done, most)
        place = np.arange(n.sum()) + np.repeat(begin[doc] + done - np.cumsum(n) + n, n)
        done += int(n[0])
        own = symbol[place]
        _, until, row, step = _decisions(m.trees, two[place].astype(np.int64), own)
        node, sign = m.trees.node.take(step), m.trees.turn.take(step)
        inputs = np.empty((PREDICTORS, len(step)), np.float32)  # for the turn that is taken
        m.toward.take(step, out=inputs[0], mode="clip")
        for given, table, context in zip(inputs[1:], (m.four, m.word), (four, word), strict=True):
            cell = _places(context[place]).take(row)
            cell ^= node
            table.take(cell, out=given, mode="clip")
            given *= sign
        ends = until[np.cumsum(n) - 1]
        each = np.diff(ends, prepend=0)
        order = np.argsort(-each, kind="stable")
        many = left - np.cumsum(np.bincount(each))[:-1]
        x = (_side_by_side if left > FEW else _one_by_one)(weights, doc, inputs, ends - each, order, many)
        x = (x / SQUASH).astype(np.float32)
        cost = -np.abs(x)
        np.exp(cost, out=cost)
        cost += 1
        np.subtract(np.minimum(x, 0), np.log(cost, out=cost), out=cost)
        rare = np.flatnonzero(own == ESCAPE)
        byte = m.escape[buf[place[rare] - doc[np.searchsorted(np.cumsum(n), rare, "right")]]]
        yield Part(doc, n, place, until, order, many, cost.astype(float), rare, byte)


def log_probabilities(m: Model, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log-probability of every symbol of all texts, the symbols, and where each text begins."""
    begin = at + np.arange(len(at))
    symbol, total = np.empty(begin[-1], np.uint8), np.empty(begin[-1])
    for p in _coded(m, buf, at, symbol):
        total[p.place] = np.add.reduceat(p.by_text()[0], np.append(0, p.until[:-1]))
        total[p.place[p.rare]] += p.byte
    return total, symbol, begin


def text_scores(m: Model, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    out, bytes_ = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for p in _coded(m, buf, at, np.empty(at[-1] + len(out), np.uint8)):
        if len(p.doc) > FEW:  # decision by decision, whatever the parts
            doc, each, lo = p.doc[p.order], p.each, 0
            total = out[doc]
            for n in p.many.tolist():
                some = total[:n]
                some += each[lo : lo + n]
                lo += n
            out[doc] = total
        else:
            each, n = p.by_text()
            np.add.at(out, np.repeat(p.doc, n), each)
        np.add.at(bytes_, p.doc[np.searchsorted(np.cumsum(p.n), p.rare, "right")], p.byte)
    return (out + bytes_) / np.log(10)


def column_scores(m: Model, column: pa.Array) -> np.ndarray:
    """log10 probability of each text of a column; texts of about one length share a lot, so that many lie side by side until its end."""
    out, size = np.zeros(len(column)), pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    order = np.argsort(-size, kind="stable")  # so that the longest ones are many in their lot
    lot = np.cumsum(size[order], dtype=np.int64) // LOT
    for here in np.split(order, np.flatnonzero(lot[1:] != lot[:-1]) + 1):
        texts, known = column.take(pa.array(here)).cast(pa.binary()), {}
        again = [known.setdefault(t, len(known)) for t in texts.to_pylist()]  # equal texts, of one length, are coded once
        del known
        first = np.unique(again, return_index=True)[1]
        out[here] = text_scores(m, *W.text_bytes(texts.take(pa.array(first)), True))[again]
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, block, n) of (block, held_out, text): training occurrences of each word of a block."""
    for b in batches:
        word, block, train = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        (blocks, of_row), held = np.unique(b.column(0).to_numpy(), return_inverse=True), b.column(1).to_numpy(zero_copy_only=False)
        for lo, hi in W.slices(b.column(2)):
            w = W.words_of(b.column(2)[lo:hi])
            row = w.rows()
            word.append(W.signed(W.hash_words(w)))
            block.append(of_row[lo:hi][row])
            train.append(1 - held[lo:hi][row].astype(np.int64))
        word, block, train = (np.concatenate(x) for x in (word, block, train))
        # by block and most bits of the word: words that differ in the others only make rows twice, which add up the same
        order = np.argsort((block.astype(np.uint64) << np.uint64(48)) | (word.view(np.uint64) >> np.uint64(16)))
        word, block, train = word[order], block[order], train[order]
        head = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])]) if len(word) else order
        n = np.add.reduceat(train, head) if len(head) else head
        yield pa.record_batch([pa.array(word[head]), pa.array(blocks[block[head]]), pa.array(n)], ["word", "block", "n"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, c) for every block that holds the word; block -1 gets the number of words and their occurrences."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    word, block, n = (t[c].to_numpy() for c in ("word", "block", "n"))
    order = np.argsort(word, kind="stable")
    word, block, n = word[order], block[order], n[order]
    head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    c = np.add.reduceat(n, head)
    yield pa.record_batch([pa.array([-1]), pa.array([int((c > 0).sum())]), pa.array([int(c.sum())])], ["block", "word", "c"])
    c = np.repeat(c, np.diff(np.r_[head, len(n)]))
    for k in range(0, len(c), 1 << 17):
        on = np.flatnonzero(c[k : k + (1 << 17)] > 0) + k
        yield pa.record_batch([pa.array(block[on]), pa.array(word[on]), pa.array(c[on])], ["block", "word", "c"])


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64()), ("n_known", pa.int64()), ("log_c", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("total", pa.bool_())])


def _score_block(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """One row per document of the block; for block -1 one row with the numbers of words and occurrences."""
    if not docs.num_rows:
        total = {"doc_id": None, "held_out": None, "n_words": pa.compute.sum(counts["word"]).as_py(), "n_known": pa.compute.sum(counts["c"]).as_py(), "log_c": None, "score": None, "n_bytes": None, "total": True}
        return pa.Table.from_pylist([total], _SCORED)
    docs = docs.combine_chunks()
    text = docs["text"].chunk(0)
    known, c = counts["word"].to_numpy(), counts["c"].to_numpy()
    order = np.argsort(known)
    known, c = known[order], c[order]
    parts = [[] for _ in range(4)]
    for lo, hi in W.slices(text, SLICE):
        buf, at = W.text_bytes(text[lo:hi], True)
        w = W.split(buf, at, "space")
        word, row = W.signed(W.hash_words(w)), w.rows()
        have = np.zeros(len(word), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, word), len(known) - 1)
            have = np.where(known[place] == word, c[place], 0)
        values = (w.counts(), np.bincount(row[have > 0], minlength=hi - lo), np.bincount(row, np.log10(have + 1.0), hi - lo), np.diff(at))
        for p, v in zip(parts, values, strict=True):
            p.append(v)
    columns = [np.concatenate(p) for p in parts]
    columns.insert(3, docs["score"].to_numpy())
    return pa.table([docs["doc_id"], docs["held_out"], *[pa.array(x) for x in columns], pa.array(np.zeros(len(columns[0]), bool))], schema=_SCORED)


def score_documents(docs: DataFrame) -> DataFrame:
    """Per document: token counts, the unigram base score and the model's score (log10), with bits per byte."""
    rows = docs.select(
        block_of(docs).alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id"), 7).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    learned = rows.where(~F.col("held_out")).select("text")
    model = docs.sparkSession.sparkContext.broadcast(train(learned))
    counted = rows.select("block", "held_out", "text").mapInArrow(_tokens, "word bigint, block bigint, n bigint")
    counts = counted.repartition("word").mapInArrow(_totals, "block bigint, word bigint, c bigint")
    shape = "doc_id bigint, held_out boolean, n_words bigint, n_known bigint, log_c double, score double, n_bytes bigint, total boolean"

    def scores(column: pa.Array) -> pa.Array:
        return pa.array(column_scores(model.value, column))

    coded = rows.withColumn("score", F.arrow_udf(scores, "double")("text"))  # where texts are read, as more of them lie side by side than in a block
    scored = stage(coded.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_score_block, shape), "scored")
    sums = scored.agg(
        F.coalesce(F.sum(F.when(F.col("total"), F.col("n_words"))), F.lit(0)).alias("v"), F.coalesce(F.sum(F.when(F.col("total"), F.col("n_known"))), F.lit(0)).alias("n"),
        F.count_if(~F.col("total") & ~F.col("held_out")).alias("ends"),
    ).first()
    ends = int(sums.ends)
    n, v = int(sums.n) + ends, int(sums.v) + (ends > 0)
    tokens = F.col("n_words") + 1
    return scored.where(~F.col("total")).select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("log_c") + float(np.log10(ends + 1.0)) - tokens * float(np.log10(n + v + 1.0))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
