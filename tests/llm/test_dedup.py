"""Suffix, phrase and Jaccard deduplication against brute force, and their defined cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelbook.llm import jaccard, phrases, suffixes
from levelbook.llm.components import components
from levelbook.llm.frames import documents
from levelbook.llm.scan import RangeHash, anchored_runs, merged, sliding_min, split_words

from .helpers import clashing, docs_of, jaccard_brute, phrases_brute, repeats_brute, shingles


def texts_with_copies(seed, n=40, words=60, kinds=30):
    """Random texts that share passages, repeat themselves and are near copies of each other."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(kinds)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 40))] for _ in range(5)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            out = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if out:
                    out[rng.randrange(len(out))] = rng.choice(vocabulary)
        else:
            out = [rng.choice(vocabulary) for _ in range(rng.randint(0, words))]
            if kind < 0.7:
                at = rng.randint(0, len(out))
                out[at:at] = rng.choice(passages) * rng.randint(1, 2)
        texts.append(" ".join(out))
    return [*texts, None, "", "   \n\t ", "one", "One", "a b c", "x " * 300, "é" * 500]


def test_words_are_split_as_bytes_split():
    texts = [b"", b" a  b\n", "é x\x0by".encode(), b"\x1cq", b"", b"tail"]
    words = split_words(texts)
    found = [[bytes(words.buffer[a:b]) for a, b in zip(words.starts[i:j], words.ends[i:j], strict=True)]
             for i, j in zip(words.first, words.first[1:], strict=False)]
    assert found == [t.split() for t in texts]
    assert len(split_words([]).starts) == 0


def test_sliding_min_and_runs():
    rng = np.random.default_rng(5)
    for width in (1, 2, 5, 16):
        values = rng.integers(0, 9, 50).astype(np.uint64)
        assert sliding_min(values, width).tolist() == [values[i:i + width].min() for i in range(51 - width)]
    values = rng.integers(0, 3, 300).astype(np.uint64)
    starts, n, anchors = anchored_runs(RangeHash(values), np.arange(300) + 20 <= 300, 20, 5)
    assert np.concatenate([np.arange(s, s + k) for s, k in zip(starts, n, strict=True)]).tolist() == list(range(281))
    by_window = {}
    for s, k, a in zip(starts, n, anchors, strict=True):
        for i in range(s, s + k):
            assert by_window.setdefault(values[i:i + 20].tobytes(), a) == a


def test_merged_spans():
    assert merged([(5, 7), (0, 2), (2, 3), (6, 9)]) == [(0, 3), (5, 9)]


@pytest.mark.parametrize("length", [1, 3, 7, 8, 20, 40])
def test_interval_expansion(length):
    rng = random.Random(length)
    for _ in range(40):
        base = bytes(rng.randrange(97, 99) for _ in range(60))
        parts = [base[rng.randint(0, 50):][: rng.randint(0, 60)] + bytes(rng.randrange(97, 100) for _ in range(8)) for _ in range(4)]
        symbols = np.array([x for p in parts for x in [*(c + 1 for c in p), 0]])
        found = suffixes.repeated_starts(symbols, length)
        windows = [tuple(symbols[i:i + length]) for i in range(len(symbols) - length + 1)]
        for i, w in enumerate(windows):
            assert 0 in w or found[i] == (windows.count(w) > 1)


@pytest.mark.parametrize("most", [1, 1000])
def test_suffixes_against_brute_force(spark, most):
    rows = list(enumerate(texts_with_copies(1), 1))
    rows += [(3, rows[2][1]), (None, rows[5][1]), (None, "n" * 90)]  # repeated rows and NULL ids are documents too
    found = suffixes.remove_repeats(docs_of(spark, rows), length=40, gram=8, most_passages=most)
    got = sorted((tuple(r)[:5] for r in found.collect()), key=str)
    assert got == sorted(repeats_brute(rows, 40), key=str)


@pytest.mark.parametrize("most", [1, 1000])
def test_phrases_against_brute_force(spark, most):
    rows = list(enumerate(texts_with_copies(2), 1))
    found = phrases.remove_repeats(docs_of(spark, rows[::-1]), window=10, gram=4, most_passages=most)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect())
    assert got == sorted(phrases_brute(rows, 10))


def test_phrases_with_repeated_and_nameless_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text), (3, "short")]
    found = phrases.remove_repeats(docs_of(spark, rows), window=10, gram=4).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in found) == [("1", 0), ("1", 0), ("2", 30), ("3", 0), ("None", 0)]


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_against_brute_force(spark, seed):
    rows = list(enumerate(texts_with_copies(seed, n=60, words=40), 1))
    expected, links = jaccard_brute(rows, width=2)
    found = jaccard.components_of(docs_of(spark, rows), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    classes = {r.doc_id: r.class_id for r in found}
    pairs = {tuple(sorted((classes[a], classes[b]))) for a, b in links}
    assert {(r.a, r.b) for r in jaccard.links(docs_of(spark, rows), width=2).collect()} == pairs


def test_jaccard_chain_and_threshold(spark):
    """Links reach over documents that are not similar themselves; exactly three quarters counts."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i + 10, " ".join(words[i * 2:i * 2 + 22])) for i in range(8)] + [(5, "q1 q2 q3 q4"), (6, "q1 q2 q3")]
    expected, _ = jaccard_brute(rows, width=1)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs_of(spark, rows), width=1).collect()}
    assert found == expected
    assert found[17] == (22, 10) and found[6] == (3, 5)


def test_jaccard_nameless_and_repeated_rows(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (9, None), (8, "")]
    found = sorted(map(str, (tuple(r) for r in jaccard.components_of(docs_of(spark, rows)).collect())))
    assert found == sorted(map(str, [(2, 2, 1, 1), (2, 2, 1, 1), (None, 2, None, None), (1, 2, 1, 1), (9, 0, 9, 9), (8, 0, 8, 8)]))
    kept = jaccard.keep_one(docs_of(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "8", "9", "None"]


def several_texts_brute(rows, width):
    """(id, set size, component) per row, where rows of one id are one document."""
    sets = [shingles(t, width) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in zip(sets, rows, strict=True):
        for y, (j, _) in zip(sets, rows, strict=True):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted((i, len(s), find(i) if s else i) for s, (i, _) in zip(sets, rows, strict=True))


@pytest.mark.parametrize("backwards", [False, True])
def test_jaccard_with_several_texts_under_one_id(spark, backwards):
    """All texts of an id take part, whatever the order of the rows."""
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " x"), (3, ""), (4, two), (5, "q r"), (6, "q r")]
    rows += [(i % 25 + 10, t) for i, t in enumerate(texts_with_copies(9, n=50, words=40))]
    rows = rows[::-1] if backwards else rows
    found = jaccard.components_of(docs_of(spark, rows), width=2).collect()
    expected = several_texts_brute(rows, 2)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert {r.doc_id: r.component_id for r in found if r.n_shingles and r.doc_id < 5} == {1: 1, 2: 1, 3: 1, 4: 1}
    kept = jaccard.keep_one(docs_of(spark, rows), width=2).collect()
    gone = {i for i, _, component in expected if component < i}
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted({(i, t or "") for i, t in rows if i not in gone})
    links = {(r.a, r.b) for r in jaccard.links(docs_of(spark, rows[:8] if not backwards else rows[-8:]), width=2).collect()}
    assert links == {(1, 2), (1, 3)}


def test_spans_of_repeated_rows_are_held_once(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = documents(docs_of(spark, [(None, text)] * 50 + [(1, text), (2, text), (2, text)]), "doc_id", "text")
    sizes = {len(r.spans) for r in suffixes.repeated_spans(docs, 40, 8).collect()}
    assert max(sizes) <= 2 * len(text)
    spans = [r for r in phrases.repeated_spans(docs, 10, 4).collect()]
    assert {r.doc_id for r in spans} == {2} and all(len(r.spans) <= 2 * 30 for r in spans)


def python_steps(plan):
    """The most Python steps of one task, and those of the task that ends with ``plan``."""
    name, below = plan.nodeName(), plan.children()
    most, own = 0, 0
    for i in range(below.size()):
        found = python_steps(below.apply(i))
        most, own = max(most, found[0]), max(own, found[1])
    own = 0 if "Exchange" in name else own + (name == "MapInArrow")
    return max(most, own), own


def test_a_task_of_frequent_anchors_holds_one_python_worker(spark, conf, monkeypatch):
    conf(spark__sql__adaptive__enabled="false")
    steps, write = {}, suffixes.written

    def written(df, name):
        steps[name] = max(steps.get(name, 0), python_steps(df._jdf.queryExecution().executedPlan())[0])
        return write(df, name)

    monkeypatch.setattr(suffixes, "written", written)
    rows = list(enumerate(texts_with_copies(1), 1))
    found = suffixes.remove_repeats(docs_of(spark, rows), length=40, gram=8, most_passages=1)
    assert found.filter("n_removed > 0").count()
    assert steps["suffix-blocks"] == 1 and steps["suffix-passages"] == 1


def test_numbers_found_several_times():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 5, 40):
        parts = [rng.integers(0, 12, size).astype(np.uint64), rng.integers(0, 12, size // 2).astype(np.uint64)]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        found, often = jaccard._several(parts)
        assert found.tolist() == values[counts > 1].tolist() and often.tolist() == counts[counts > 1].tolist()
        assert not parts


def family(seed, n=60, words=150, changes=7):
    """Copies of one text, each with words of its own at random places, mostly just too many for a link."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        out = list(base)
        for at in rng.sample(range(words), rng.randint(changes - 2, changes)):
            out[at] = f"own{i}x{at}"
        rows.append((i + 1, " ".join(out)))
    return rows


def test_a_family_just_below_the_threshold_makes_few_pairs(spark):
    """What two sets have in common from their first meeting on decides before they are paired."""
    rows = family(11)
    expected, links = jaccard_brute(rows)
    join = jaccard._Join(documents(docs_of(spark, rows), "doc_id", "text"), 5, 75, 100)
    keys = join.keys()
    pairs = join._pairs(keys, keys, F.col("x.rep") < F.col("y.rep"))
    assert len(links) <= pairs.count() < 60 * 59 / 2 / 4
    assert {(r.a, r.b) for r in join.verified(pairs).collect()} == links
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs_of(spark, rows)).collect()}
    assert found == expected


@pytest.mark.parametrize("changes", [3, 5])
def test_a_family_with_many_links(spark, changes, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SETS", 4)
    monkeypatch.setattr(jaccard, "SENT_BYTES", 1 << 10)
    rows = family(12, changes=changes)
    expected, links = jaccard_brute(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs_of(spark, rows)).collect()}
    assert found == expected and links
    assert {(r.a, r.b) for r in jaccard.links(docs_of(spark, rows * 2)).collect()} == links


def test_boundary_has_the_least_cost():
    assert jaccard.choose_boundary([(10, 5.0, 1000), (100, 1e9, 50)], 75, 100) >= 10
    assert jaccard.choose_boundary([(10, 5000.0, 10), (100, 1e9, 50)], 75, 100) < 10
    assert jaccard.choose_boundary([], 75, 100) == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 20)] + [(30, 40), (40, 35), (50, 50)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 1 for i in range(1, 21)}, 30: 30, 40: 30, 35: 30}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_empty_tables_and_clashing_columns(spark):
    empty = docs_of(spark, [])
    assert suffixes.remove_repeats(empty).count() == 0
    assert phrases.remove_repeats(empty).count() == 0
    assert jaccard.components_of(empty).count() == 0
    texts = texts_with_copies(6, n=12)
    plain, other = docs_of(spark, texts), clashing(spark, texts)
    assert sorted(suffixes.remove_repeats(plain, length=40, gram=8).collect()) == sorted(
        suffixes.remove_repeats(other, length=40, gram=8).collect()
    )
    assert sorted(phrases.remove_repeats(plain, window=10, gram=4).collect()) == sorted(
        phrases.remove_repeats(other, window=10, gram=4).collect()
    )
    assert sorted(jaccard.components_of(plain).collect()) == sorted(jaccard.components_of(other).collect())
    cut = suffixes.cut_documents(other, length=40)
    assert cut.columns == other.columns and cut.count() == len(texts)
    assert jaccard.keep_one(other).columns == other.columns


def test_string_ids(spark):
    rows = [("b", "a b c d e f"), ("a", "a b c d e f")]
    found = jaccard.components_of(docs_of(spark, rows, "doc_id string, text string")).collect()
    assert {r.component_id for r in found} == {"a"}
