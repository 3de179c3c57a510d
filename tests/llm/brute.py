"""Plain versions of the operators, for small tables."""

import hashlib
import re
import string
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall(text or "")


def substring(docs, window=20):
    first = {}
    for i, t in sorted(docs.items()):
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    out = {}
    for i, t in docs.items():
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffix(docs, length=200):
    raw = {i: (t or "").encode() for i, t in docs.items()}
    seen = Counter(b[p : p + length] for b in raw.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    held = defaultdict(list)
    for i in sorted(sets):
        both = Counter(j for g in sets[i] for j in held[g])
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            held[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in docs}


def leaks(docs, items, least=0.8, k=5):
    token = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    out = set()
    for i, t in docs.items():
        w = token(t)
        g = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        for item, text in items.items():
            v = token(text)
            c = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            n = sum(c.values())
            m = min(n, len(g))
            if not m or not set(g) & set(c):
                continue
            for s in range(len(g) - m + 1):
                both = sum((Counter(g[s : s + m]) & c).values())
                if both >= least * (m + n - both):
                    out.add((i, item))
                    break
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """sizes: source -> words; sources in order, None last."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        left -= sum(most * sizes[s] for s in over)
    return out
