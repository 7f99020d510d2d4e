"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    w = WORD.findall(low(text))
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id)} by counting common shingles of all pairs that have one."""
    sets = {i: shingle_set(t) for i, t in docs}
    holders, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sorted(sets.items()):
        common = Counter(j for x in s for j in holders[x])
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            holders[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs, width=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)} by looking up every window."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - width + 1):
            w = raw[s: s + width]
            if w in seen:
                gone[s: s + width] = [True] * width
            seen.add(w)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone) if not g))
    return out


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, item ids as sorted strings)} by comparing every window."""
    windows = defaultdict(set)
    for item, text in items:
        w = TOKEN.findall(low(text))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k: k + n])].add(str(item))
    sizes, out = {len(w) for w in windows}, {}
    for i, text in docs:
        w, hit, found = TOKEN.findall(low(text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k: k + n])):
                    found |= names
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
    inside = {k + d for k in range(len(w) - 2) if grams[tuple(w[k: k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def binomial_tail(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
