"""Plain loops over rows that say what the operators must return."""

import hashlib
import re
from collections import Counter

PLAIN = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UP = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(UP)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def last(doc_id):
    return (doc_id is None, doc_id or 0)


def suffix(rows, length=100):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha)}; rows of (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: last(r[0])):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id, text] = (len(data), sum(gone), spans, sha(kept))
    return out


def windows(rows, k=13):
    first = {}
    for doc_id, text in rows:
        w = PLAIN.findall(text or "")
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, last(doc_id)), last(doc_id))
    out = {}
    for doc_id, text in rows:
        w = PLAIN.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < last(doc_id):
                gone[i : i + k] = [True] * k
        out[doc_id, text] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def jaccard(rows, k=5):
    sets = []
    for doc_id, text in rows:
        w = PLAIN.findall(low(text))
        sets.append((doc_id, frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()))
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    places = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            places.setdefault(g, []).append(i)
    shared = Counter()
    for who in places.values():
        for x in range(len(who)):
            for y in range(x):
                shared[who[y], who[x]] += 1
    for (i, j), n in shared.items():
        if 100 * n >= 75 * (len(sets[i][1]) + len(sets[j][1]) - n):
            a, b = root(i), root(j)
            group[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(sets)):
        members.setdefault(root(i), []).append(sets[i][0])
    least = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    return sorted(((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)), key=str)


def contamination(rows, items, k=10):
    wins = set()
    for item_id, text in items:
        w = ALNUM.findall(low(text))
        for i in range(max(len(w) - k + 1, 1) if w else 0):
            wins.add((tuple(w[i : i + k]), item_id))
    by_win = {}
    for g, item in wins:
        by_win.setdefault(g, set()).add(item)
    sizes = {len(g) for g in by_win}
    out = {}
    for doc_id, text in rows:
        w = ALNUM.findall(low(text))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in by_win:
                    hit[i : i + n] = [True] * n
                    found |= by_win[g]
        ids = sorted(str(i) for i in found if i is not None)
        out[doc_id, text] = (len(w), sum(hit), len(ids), sha(",".join(ids).encode()), any(hit))
    return out
