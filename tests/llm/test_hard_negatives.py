"""Hard negatives against plain scoring of all pairs; intervals against true scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timedtext.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    held = {}
    for i, x, y in rows:
        if y is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(256 * c) for c in x)
        if sum(c * c for c in v) < 2**62:
            held[(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, v)] = None
    held, out = list(held), []
    order = lambda p: (-p[1], p[0] is None, p[0] or 0)
    for a in held:
        if a[0] is None or a[0] % 50:
            continue
        scored = [(b[0], sum(x * y for x, y in zip(a[2], b[2])), b[1] == a[1]) for b in held if b is not a and len(b[2]) == len(a[2])]
        for p, s, _ in sorted((x for x in scored if x[2]), key=order)[:5]:
            near = sorted((x for x in scored if not x[2] and 50 * s <= 100 * x[1] <= 95 * s), key=order)[:3]
            out += [(a[0], p, r + 1, n, s, t) for r, (n, t, _) in enumerate(near)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk,block", [(1_500, 512), (60, 2)])
def test_equals_plain(spark, chunk, block):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 20))
    rows = [(int(i), (base[i % 12] + 0.7 * rng.standard_normal(20)).tolist(), int(i % 12 % 4) if i % 3 else 1) for i in range(400)]
    rows += [(i, [1.0, 0.5, float(i % 5)], 2) for i in range(450, 520)] + [(i, [1.0, 0.4, float(i % 7)], 3) for i in range(520, 560)]
    rows += [(600, None, 1), (650, [1.0] * 20, None), (700, [], 1), (750, [float("nan")] * 20, 1), (800, [None] * 20, 1), (850, [0.0] * 20, 1), (900, [1e300] * 20, 1), (950, [2.0e6] * 20, 1), (951, [2.0e6] * 20, 1), (952, [1.9e6] * 20, 3)]
    rows += [(100, rows[100][1], rows[100][2])] * 2 + [(101, rows[101][1], 3), (None, rows[50][1], rows[50][2]), (None, rows[50][1], 3), (150, rows[151][1], 1), (1000, [0.5], 1), (1001, [0.25], 1), (1002, [0.24], 2), (-50, rows[3][1], 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "rid", "v", "chunk", "score"):
        d = d.withColumn(c, F.lit(9))
    want = plain(rows)
    assert len(want) > 60 and got(H.hard_negatives(d, chunk=chunk, block=block)) == want


def test_empty(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)).count() == 0


@pytest.mark.parametrize("dim", [1, 3, 64, 200])
def test_intervals_hold_the_scores(dim):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((5, dim))
    v = np.floor(256 * (base[rng.integers(0, 5, 500)] + rng.choice([0.01, 0.3, 2.0], 500)[:, None] * rng.standard_normal((500, dim))))
    codes = H.encode(v)
    for a in [*v[:20], np.zeros(dim)]:
        low, high = H.intervals(a, codes)
        score = v @ a
        assert (low <= score).all() and (score <= high).all()
    if dim == 64:
        low, high = H.intervals(v[0], codes)
        assert ((high - low) / (np.linalg.norm(v[0]) * codes.norm + 1e-9)).max() < 0.75


def test_filter_leaves_rows_out(monkeypatch):
    """Far rows are never scored."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.standard_normal((3000, 64)))
    v[:40] = np.floor(v[0] + 60 * rng.standard_normal((40, 64)))
    n = np.arange(3000)
    rows = H.rows_of(n, n, np.ones(3000, np.int64), v, H.encode(v))
    seen, plain_scores = [], H._scores
    monkeypatch.setattr(H, "_scores", lambda r, at, a: seen.append(len(at)) or plain_scores(r, at, a))
    at, score = H.closest(rows, 0, 1, v[0], 5)
    want = np.argsort(-(v @ v[0]), kind="stable")
    assert at.tolist() == [i for i in want if i][:5] and seen[0] < 300
