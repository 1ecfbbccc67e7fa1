"""Small tables and brute-force versions for the tests of the text operators."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

TESTDATA = "/root/testdata/sf0.001"


def docs_of(spark, texts, schema="doc_id long, text string"):
    """A table of (id, text) pairs, or of texts numbered from 1."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, schema)


def clashing(spark, texts):
    """The same texts beside columns named as the operators name theirs."""
    rows = [(i, t, "x", 1, 2, None, "y") for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, anchor string, n long, text_key long, spans array<int>, _bucket string"
    )


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if len(words) >= width:
        return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def jaccard_brute(rows, width=5, numerator=75, denominator=100):
    """(set size, component) per id, and the links between different sets."""
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = set()
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if denominator * common >= numerator * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
                    if sets[i] != sets[j]:
                        links.add((i, j))
    return {i: (len(sets[i]), find(i)) for i in ids}, links


def repeats_brute(rows, length):
    """(bytes, removed, spans, hash) per row, for strings that start anywhere else too."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k:k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        cut = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                cut[k:k + length] = b"\1" * length
        kept = bytes(c for c, x in zip(t, cut, strict=True) if not x)
        spans = sum(1 for k in range(len(t)) if cut[k] and (k == 0 or not cut[k - 1]))
        out.append((i, len(t), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


def phrases_brute(rows, window):
    """(words, removed, hash) per id, for windows that start in a document with a smaller id too."""
    first: dict = defaultdict(lambda: float("inf"))
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            first[key] = min(first[key], i)
    out = []
    for i, words in texts:
        cut = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] < i:
                cut[k:k + window] = [True] * window
        kept = b" ".join(w for w, x in zip(words, cut, strict=True) if not x)
        out.append((i, len(words), sum(cut), hashlib.sha256(kept).hexdigest()))
    return out
