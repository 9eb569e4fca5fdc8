"""Plain versions of the contracts, over lists of (doc_id, text) or rows that begin so."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
ALNUM = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(BLANK).translate(FOLD)
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                docs[key(x)].add(i)
    top = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or top.get(key(x), i) <= i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def decontaminate(rows, items, n=10):
    words = lambda t: ALNUM.findall((t or "").translate(FOLD))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in windows:
                    hit |= set(range(a, a + k))
                    found |= {str(v) for v in windows[x] if v is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def simhash(rows, shingle=4, radius=4):
    prints = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        h = [xxhash.xxh64_intdigest(" ".join(w[a : a + shingle]).encode(), 42) for a in range(max(1, len(w) - shingle + 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [(r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group, strict=True)]


def substring(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[a : a + window]) for w in words for a in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for p in range(a, a + window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def bm25(rows, k=10, k1=1.2, b=0.75):
    import math

    bags = [Counter(ALNUM.findall((t or "").translate(FOLD))) for _, t in rows]
    lens = [sum(x.values()) for x in bags]
    mean, n = sum(lens) / max(1, len(rows)), len(rows)
    df = Counter(w for x in bags for w in x)
    idf = {w: math.log(1 + (n - v + 0.5) / (v + 0.5)) for w, v in df.items()}
    out, done = [], set()
    for (i, _), q in zip(rows, bags, strict=True):
        if i is None or i % 50 or i in done:
            continue
        done.add(i)
        scored = [(round(sum(idf[w] * x[w] * (k1 + 1) / (x[w] + k1 * (1 - b + b * m / mean)) for w in q if w in x), 9), j) for (j, _), x, m in zip(rows, bags, lens, strict=True)]
        best = sorted((s for s in scored if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(i, r, j, s) for r, (s, j) in enumerate(best, 1)]
    return out
