"""Spelling variants against brute force, with lists cut or whole."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from levelbook.llm import queries, spelling

from .helpers import TESTDATA, docs_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def vocabulary(rows, min_length=5, min_count=3):
    seen = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute(rows, **options):
    found = vocabulary(rows, **options)
    by_gap = {}
    for w in found:  # near words agree after one deletion in one or both
        for k in range(len(w)):
            by_gap.setdefault(w[:k] + w[k + 1:], set()).add(w)
    form, out = {}, {}
    for w, n in found.items():
        others = set().union(by_gap.get(w, ()), {v for k in range(len(w)) if (v := w[:k] + w[k + 1:]) in found},
                             *(by_gap[w[:k] + w[k + 1:]] for k in range(len(w))))
        near = [v for v in others if one_edit(v, w)]
        best = min(near, key=lambda v: (-found[v], v), default=None)
        form[w] = best if best and found[best] >= 2 * n else None
        out[w] = len(near)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, out[w], found.get(form[w])) for w, n in found.items())


def found(df, **options):
    return sorted(tuple(r) for r in spelling.variants(df, **options).collect())


def texts(seed=0, n=60, letters="abé", longest=8):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, longest))) for _ in range(120)]
    return [" ".join(rng.choice(words)[:: rng.choice([1, 1, 1, -1])] for _ in range(60)) + rng.choice([".", "; Word×s 日本語abcab", "-"]) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"block": 200}, {"block": 900}])
def test_against_brute_force(spark, options):
    rows = list(enumerate(texts()))
    expected = brute(rows)
    assert len(expected) > 50 and sum(x[4] for x in expected) > 50
    assert found(docs_of(spark, rows), **options) == expected


def test_cut_lists_meet_all_blocks(spark):
    rng = random.Random(4)
    # One list of words that share their first halves, in many blocks.
    words = ["prefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(64)]
    rows = [(i, " ".join(words)) for i in range(3)] + [(9, " ".join(rng.choice(words) for _ in range(2000)))]
    expected = brute(rows)
    assert sum(x[4] for x in expected) > 100
    assert found(docs_of(spark, rows), block=150) == expected


def test_chain_of_forms_and_ties(spark):
    chain = ["chaine"] * 3 + ["chainee"] * 6 + ["chaineee"] * 12 + ["chaineeee"] * 24 + ["chaineeeee"] * 48
    ties = ["table"] * 3 + ["tabla"] * 8 + ["tablz"] * 8 + ["tablé"] * 8
    rows = [(None, " ".join(chain)), (None, " ".join(ties))]
    result = {r[0]: r for r in found(docs_of(spark, rows))}
    assert sorted(result.values()) == brute(rows)
    assert result["chaine"][2] == "chaineeeee" and result["table"][1] == "tabla"


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "hello hello Hello"), (None, "HELLO"), (3, "ÀÉÎÖÿ àéîöÿ ÀÉÎÖÿ ÀÉÎÖÿ"), (3, "ÀÉÎÖÿ àéîöÿ ÀÉÎÖÿ ÀÉÎÖÿ"),
            (4, "a×b÷c a×b÷c a×b÷c x"), (5, "ſtraße ſtraße ſtraße Āpple Āpple Āpple"), (6, "日本語hello語 — “hello”")]
    assert found(docs_of(spark, rows)) == brute(rows)


def test_very_long_words(spark):
    long = "ab" * 4000
    rows = [(i, f"{long} x {long}c words words wordss wordss {long[:-1]}") for i in range(5)]
    assert found(docs_of(spark, rows)) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert found(docs_of(spark, [])) == []
    assert found(docs_of(spark, ["few words", None])) == []
    rows = list(enumerate(texts(2, 20)))
    df = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("id", "word", "n", "form", "root", "size", "half", "own", "list", "_l", "_c", "blocks")})
    assert found(df) == brute(rows)


def test_misprints_of_words_that_meet(spark):
    # The shorter word of a misprint may be misprinted itself in the same text.
    rows = [(i, "wordword wordwor wordwod ordword wordword") for i in range(400)]
    expected = brute(rows, min_count=1)
    assert len(expected) > 4
    assert found(docs_of(spark, rows), min_count=1) == expected


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()
    result = queries.QUERIES["op13_spelling_variants"](spark, TESTDATA)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, result.collect())) == brute([(r.doc_id, r.text) for r in docs])
