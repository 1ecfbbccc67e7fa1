"""Hard negatives against brute force, under several layouts of groups and slices."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelbook.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=2, positives=5, wanted=3, window=(50, 95)):
    """All results, for rows with ids of their own."""
    usable = [
        (i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in rows
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) and abs(x) < negatives.LARGEST for x in v)
    ]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for i, v, label in usable:
        if i % every:
            continue
        scored = sorted((-score(v, w), j, other) for j, w, other in usable if j != i)
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(s, n) for s, n, other in scored if other != label and window[0] * -p <= 100 * -s <= window[1] * -p]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fits[:wanted], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % 2 == 0, **options).collect())


def vectors(n, dims=6, labels=3, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.normal(0.3, 0.5, (n, dims)).astype(np.float32).round(1)  # rounded, so scores tie
    return [(i, [float(x) for x in points[i]], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("layout", [{}, {"group_anchors": 7, "slice_rows": 11}, {"group_anchors": 100, "slice_rows": 5}])
def test_against_brute_force(spark, layout):
    rows = vectors(90)
    found = mined(spark, rows, **layout)
    assert len(found) > 100 and found == brute(rows)


def test_one_hot_label_and_copies(spark):
    rows = [(i, v, 0 if i % 3 else 1) for i, v, _ in vectors(40)] + [(100 + i, [1.0] * 6, i % 2) for i in range(30)]
    assert mined(spark, rows, group_anchors=5, slice_rows=8) == brute(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (50, None, 1), (52, [1.0, None], 1), (54, [1.0, nan], 1), (56, [inf, 1.0], 1), (58, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1), (60, [1e30, 0.0], 1), (62, [], 1), (64, [1.0], 1), (65, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0, 9.0], 2),
    ]
    rows = vectors(30) + odd
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows(spark):
    once = vectors(12, labels=2)
    twice = once + once
    found = mined(spark, twice, slice_rows=5)
    # An anchor is taken once, no copy of it is its positive, and every copy of another row counts.
    assert found and all(a != p for a, p, *_ in found)
    assert {a for a, *_ in found} <= {i for i, *_ in once if i % 2 == 0}
    per_anchor = {}
    for a, p, rank, n, *_ in found:
        per_anchor.setdefault((a, p), []).append((rank, n))
    best = {key: rows[0][1] for key, rows in ((k, sorted(v)) for k, v in per_anchor.items())}
    assert all(best[k] == n for k, n in {(a, p): n for a, p, rank, n, *_ in brute(once) if rank == 1}.items() if k in best)


def test_empty_tables_and_clashing_names(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    rows = vectors(30)
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5.0) for r in rows], SCHEMA + ", id int, q int, mark int, rank string, score int, place double")
    found = negatives.mine(df, F.col("id") % 2 == 0).collect()
    assert sorted(map(tuple, found)) == brute(rows)


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 40), (64, 64, 64), (50, 7, 90), (129, 65, 70)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 24), 1 << 24, (m, k)), rng.integers(-(1 << 24), 1 << 24, (k, n))
    assert (negatives.strassen(a, b) == np.array(a.astype(object) @ b.astype(object), dtype=np.int64)).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    owner, score, ids = (rng.integers(0, n, 500) for n in (9, 6, 1000))
    mark = np.zeros(500, dtype=np.int64)
    whole = negatives.Heaps(4)
    whole.add(owner, score, ids, mark)
    parts = negatives.Heaps(4)
    for at in np.array_split(rng.permutation(500), 7):
        parts.add(owner[at], score[at], ids[at], mark[at])

    def of(h):
        return list(zip(h.owner.tolist(), h.score.tolist(), h.id.tolist(), strict=True))

    assert of(parts) == of(whole)
    assert of(whole) == [
        (o, s, i) for o in range(9)
        for s, i in sorted(((s, i) for q, s, i in zip(owner.tolist(), score.tolist(), ids.tolist(), strict=True) if q == o),
                           key=lambda x: (-x[0], x[1]))[:4]
    ]
