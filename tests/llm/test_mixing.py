"""Language-model scores: the fixed columns against a plain count, and what the model learns."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from levelbook.llm import mixing

from .helpers import TESTDATA, clashing, docs_of


def base_of(rows):
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    return {
        i: (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(train[w] > 0 for w in ws), n,
            sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        for i, ws in tokens.items()
    }


def corpus(n=120):
    rng = random.Random(7)
    words = ["the", "cat", "sat", "on", "mat", "and", "dog", "ran", "far", "away"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) for _ in range(n)]


def test_counts_and_base(spark):
    rows = list(enumerate([*corpus(), None, "", "İX ÉÉ\x00 q", "w" * 5000, "A a A"], 1))
    found = mixing.score(clashing(spark, [t for _, t in rows]), slot_bits=12, block_bytes=2000).collect()
    expected = base_of(rows)
    assert len(found) == len(rows)
    for r in found:
        held, n, known, train, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and (r.bits_per_byte is None) == (not rows[r.doc_id - 1][1])


def test_scores_are_those_of_learnt_text(spark):
    """Held-out text of the same kind costs far less than text of other letters."""
    odd = ["zq xv kj wq zx vq jk qz"] * 20
    rows = list(enumerate([*corpus(300), *odd], 1))
    found = {r.doc_id: r for r in mixing.score(docs_of(spark, rows), slot_bits=14).collect() if r.held_out}
    usual = [r.bits_per_byte for i, r in found.items() if i <= 300]
    assert len(usual) > 10 and max(usual) < 2.0


def chunk_of(seen, after, edges=()):
    """A chunk of words with their counts, and of (word before, front) with theirs."""
    words = sorted(seen)
    rows = sorted((words.index(p), front, n) for (p, front), n in after.items())
    return mixing.Chunk(
        words, np.array([seen[w] for w in words], dtype=np.int64),
        np.bincount([r[0] for r in rows], minlength=len(words)), np.array([r[1] for r in rows], dtype=np.uint16),
        np.array([r[2] for r in rows], dtype=np.int64), np.array(edges, dtype=np.uint64),
    )


def learnt(chunk):
    """The table of short contexts and the model of one chunk."""
    keys = mixing.Sums()
    for k, n in chunk.short_contexts():
        keys.add(k, n)
    model = mixing.Model()
    short = mixing.short_nodes(mixing.packed(*keys.total()))
    model.weights, _ = mixing.learn_chunk(chunk, short, model.cells)
    return short, model


def test_probabilities_sum_to_one():
    """Over all fronts after a word, and over all bytes after a beginning, probabilities sum to one."""
    seen = {b"the": 50, b"cat": 10, b"then": 3, b"": 20}
    every = {(b"cat", f): 0 for f in range(1 << 16) if f >> 8 != mixing.END} | {(b"cat", mixing.END << 8): 2}
    every[b"cat", ord("t") << 8 | ord("h")] = 7
    chunk = chunk_of(seen, every | {(b"", ord("c") << 8 | ord("a")): 10})
    short, model = learnt(chunk)
    _, fronts = mixing.score_chunk(chunk, short, model)
    after_cat = fronts[np.repeat(np.arange(len(chunk.words)), chunk.fan) == chunk.words.index(b"cat")]
    assert (10 ** after_cat).sum() == pytest.approx(1.0, abs=1e-4)
    coded = mixing.code_rests([b"the"], np.array([1]))
    first = coded.part(np.zeros(256, dtype=np.int64))
    first.symbols = np.arange(256)
    cost = mixing.costs(1, first, [short, short, short, chunk.beginnings], model)
    assert (10 ** cost).sum() == pytest.approx(1.0, abs=1e-4)
    assert 10 ** cost[ord("e")] > 0.5


def test_defined_cases(spark):
    assert mixing.score(docs_of(spark, []), slot_bits=10).count() == 0
    found = mixing.score(docs_of(spark, [(None, "a b"), (None, None)]), slot_bits=10).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in found)
    assert sorted(r.score for r in found)[1] == pytest.approx(8 * math.log10(0.5), rel=1e-6)
    twice = mixing.score(docs_of(spark, [(1, "a b"), (1, "a b"), (2, "a")]), slot_bits=10).collect()
    assert len(twice) == 3


def test_contexts_share_no_counts(spark):
    """Every context has counts of its own, however many there are and however words are dealt out."""
    rows = list(enumerate(corpus(), 1))
    few = {r.doc_id: r.score for r in mixing.score(docs_of(spark, rows), slot_bits=4).collect()}
    many = {r.doc_id: r.score for r in mixing.score(docs_of(spark, rows), slot_bits=18).collect()}
    assert few == pytest.approx(many, rel=1e-9)


def model_parts(spark, rows, chunk_bytes, block_bytes=300):
    blocks = mixing._blocks(docs_of(spark, rows), "doc_id", "text", block_bytes)
    bounds = mixing._bounds(blocks, max(1, chunk_bytes // 16))
    chunks = mixing._chunks(mixing._packs(blocks, bounds), bounds)
    short = mixing._short_table(chunks)
    return bounds, chunks, short, mixing._learnt(chunks, short)


def brute_counts(rows, bounds):
    """Per (predictor, context, bits so far): zeros and ones, from the texts one by one. Contexts are spelt out."""
    edges = {b[:k] for b in bounds for k in range(2, len(b) + 1)}

    def coded(text):
        before = b""
        for word in [*text.encode().lower().split(), b""]:
            whole = word + b" " if word else b"\n"
            for i, byte in enumerate(whole):
                so_far = whole[:i]
                if i < 2:
                    names = [("start", so_far), ("tail", before[-2:], so_far), ("before", before, so_far)]
                else:
                    names = [("one", so_far[-1:]), ("two", so_far[-2:], i == 2),
                             ("three", so_far[-3:], min(i, 4)), ("whole", None if so_far in edges else so_far)]
                yield byte, i, so_far, names
            before = word

    counts = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 10:
            for byte, _, _, names in coded(text):
                for name in names:
                    if None not in name:
                        for bit in range(8):
                            counts[name, bit, byte >> (8 - bit), byte >> (7 - bit) & 1] += 1
    return coded, counts


@pytest.mark.parametrize("chunk_bytes", [16, 60, 1 << 19])
def test_scores_against_a_brute_mixer(spark, chunk_bytes):
    """Under the learnt weights, every score is that of contexts counted one by one, however the vocabulary is cut."""
    rows = list(enumerate([*corpus(60), "then that hat a an", "", "the thé theme themes themed"], 1))
    bounds, _, _, model = model_parts(spark, rows, chunk_bytes)
    assert len(bounds) > 3 or chunk_bytes > 100
    coded, counts = brute_counts(rows, bounds)

    def level(n):
        return min(int(n).bit_length(), mixing.LEVELS - 1)

    def probability(byte, i, so_far, names):
        total = 0.0
        kind = int(i >= 2)
        for bit in range(8):
            pairs = [[counts[name, bit, byte >> (8 - bit), v] for v in (0, 1)] for name in names]
            odds = [math.log((one + mixing.PRIOR) / (zero + mixing.PRIOR)) for zero, one in pairs]
            levels = [level(sum(pair)) for pair in pairs]
            gates = [levels[g[0]] * 8 + bit if len(g) == 1 else levels[g[0]] * mixing.LEVELS + levels[g[1]]
                     for g in mixing.KINDS[kind].gating]
            mixed = [max(-12.0, min(12.0, sum(a * b for a, b in zip(own[g], odds, strict=True))))
                     for g, own in zip(gates, model.weights[kind], strict=True)]
            mean = sum(mixed) / len(mixed)
            last = so_far[-1] if so_far else 0
            cell = ((kind * 8 + bit) * 256 + last) * mixing.STEPS + round((mean + 12) * (mixing.STEPS - 1) / 24)
            p = 0.5 / (1 + math.exp(-mean)) + 0.5 * model.refined[cell]
            total += math.log10(p if byte >> (7 - bit) & 1 else 1 - p)
        return total

    found = mixing.score(docs_of(spark, rows), block_bytes=300, chunk_bytes=chunk_bytes).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = sum(probability(*step) for step in coded(rows[r.doc_id - 1][1]))
        assert r.score == pytest.approx(expected, rel=1e-4)


@pytest.mark.parametrize("chunk_bytes", [16, 1 << 19])
def test_chunks_hold_all_counts(spark, chunk_bytes):
    """Words, and fronts after words, are counted once over all blocks and chunks."""
    rows = list(enumerate(corpus(60), 1))
    words, after = Counter(), Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 10:
            own = [b"", *text.encode().split(), b""]
            words.update(own[1:])
            after.update((p, int(mixing.fronts_of([w])[0])) for p, w in zip(own, own[1:]))
    got_words, got_after = Counter(), Counter()
    for chunk in mixing._opened(model_parts(spark, rows, chunk_bytes)[1].toArrow().to_batches()):
        got_words.update(dict(zip(chunk.words, chunk.counts.tolist(), strict=True)))
        before = np.repeat(np.arange(len(chunk.words)), chunk.fan)
        got_after.update({(chunk.words[p], int(f)): int(n) for p, f, n in zip(before, chunk.fronts, chunk.seen, strict=True)})
    assert +got_words == words and +got_after == after


def test_order_of_words_counts(spark):
    """Text in its usual order costs less than the same words in another order."""
    usual = "one two three four five six seven eight nine ten " * 3
    words = usual.split()
    other = " ".join(words[::-1])
    rows = [(i, usual) for i in range(1, 41)]
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows += [(held[0], usual.strip()), (held[1], other)]
    found = {r.doc_id: r for r in mixing.score(docs_of(spark, rows)).collect()}
    assert found[held[0]].base_score == pytest.approx(found[held[1]].base_score)
    assert found[held[0]].bits_per_byte < 0.5 * found[held[1]].bits_per_byte


def test_base_after_words_of_wide_characters(spark):
    rows = [(i, t) for i, t in enumerate(["é日本 été a", "日本 été é", "a été 日本 日本", "b é"] * 5, 1)]
    expected = base_of(rows)
    for r in mixing.score(docs_of(spark, rows)).collect():
        assert (r.n_known, r.base_score) == (expected[r.doc_id][2], pytest.approx(expected[r.doc_id][4], rel=1e-9))


def test_scores_do_not_depend_on_the_partitions(spark, conf):
    conf(spark__sql__adaptive__enabled="false")
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    found = []
    for n in (1, 4, 16):
        conf(spark__sql__shuffle__partitions=str(n))
        rows = mixing.score(docs.repartition(n), chunk_bytes=1 << 14).collect()
        found.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in rows})
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        for i, values in other.items():
            assert values == pytest.approx(found[0][i], rel=1e-9)
