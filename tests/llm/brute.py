"""Plain-Python versions of what the queries return."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(_LOW) if lower else text)


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held(doc_id, divisor):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % divisor == 2


def repeats(docs):
    """{doc_id: (words, removed, digest)} for distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        w = spaced(t, lower=False)
        gone = [False] * len(w)
        own = []
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen or key in own:
                gone[p : p + 20] = [True] * 20
            own.append(key)
        seen.update(own)
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def groups(docs):
    """{doc_id: (size, smallest reachable id)}."""
    sets = {}
    for d, t in docs:
        w = spaced(t)
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def contamination(docs, items):
    strings = {}
    for i, t in items:
        w = plain(t)
        m = min(10, len(w))
        if i is None or not m:
            continue
        for k in range(len(w) - m + 1):
            strings.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = plain(t)
        hit, found = set(), set()
        for m in {len(s) for s in strings}:
            for k in range(len(w) - m + 1):
                if names := strings.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= names
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


LICENSES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(docs):
    out = []
    for d, t in docs:
        w, starts, labels = plain(t), [], set()
        for phrase, label in LICENSES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        out.append((d, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    return out


def license_labels(text, rules):
    """Labels of base phrases and of all detections that no stronger one contains, without any keyword."""
    norm = f" {' '.join(plain(text))} "
    found = []
    for i, r in enumerate(rules):
        for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", norm):
            found.append((m.start(), m.end(), r.priority, m.start() - m.end(), i, r.label))
    kept = {d[5] for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and e[2:5] < d[2:5] for e in found)}
    return ",".join(sorted(kept | {label for phrase, label in LICENSES.items() if f" {phrase} " in norm}))


def unigrams(docs):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base)]."""
    end, counts = object(), Counter()
    for d, t in docs:
        if not held(d, 7):
            counts.update([*spaced(t), end])
    n, v = sum(counts.values()), len(counts)
    rows = []
    for d, t in docs:
        w = [*spaced(t), end]
        rows.append((d, held(d, 7), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return rows
