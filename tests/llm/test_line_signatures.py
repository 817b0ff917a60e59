"""Recall of the bands on the minima that ``signatures`` gives."""

import random

from pyspark.sql import functions as F

from tests.llm.test_line_dedup import shingles
from timedtext.llm import line_dedup as L


def test_recall_of_signatures(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    pairs = []
    while len(pairs) < 1500:
        a = [word() for _ in range(rnd.randint(25, 90))]
        b = list(a)
        for i in rnd.sample(range(len(b)), rnd.randint(1, max(1, len(b) // 18))):
            b[i] = word()
        a, b = " ".join(a), " ".join(b)
        x, y = shingles(a), shingles(b)
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            pairs.append((a, b))
    rows = [(2 * k + i, 0, t) for k, p in enumerate(pairs) for i, t in enumerate(p)]
    sig = L.signatures(spark.createDataFrame(rows, "h1 long, h2 int, line string")).collect()
    at = {r.h1: [tuple(r[f"m{j}"] for j in band) for band in (*L.BANDS, *getattr(L, "MORE_BANDS", ()))] for r in sig}
    hits = sum(any(x == y for x, y in zip(at[2 * k], at[2 * k + 1])) for k in range(len(pairs)))
    print("recall", hits / len(pairs))
    assert hits >= 0.985 * len(pairs)


def test_minima_are_independent(spark):
    """Two minima pick the same shingle no more often than one in the number of shingles."""
    rnd = random.Random(7)
    rows = spark.createDataFrame([(k, "".join(chr(97 + rnd.randrange(26)) for _ in range(75))) for k in range(600)], "h1 long, line string").withColumn("h2", F.lit(0))
    one = L._shingle_rows(rows, "h1").collect()
    sets = {}
    for r in one:
        sets.setdefault(r.h1, set()).update(r[f"__s{u}"] for u in range(8))
    factors = random.Random(20)
    factors = [factors.getrandbits(31) | 1 for _ in range(L.MINIMA)]
    order = lambda c: lambda h: h * c & (2**31 - 1)
    sig = {r.h1: r for r in L.signatures(rows).collect()}
    picks = {k: [min(s, key=order(c)) for c in factors] for k, s in sets.items()}
    assert all(sig[k][f"m{j}"] == order(c)(picks[k][j]) for k in sets for j, c in enumerate(factors))
    for i in range(L.MINIMA):
        for j in range(i):
            assert sum(p[i] == p[j] for p in picks.values()) <= 0.06 * len(picks), (i, j)
