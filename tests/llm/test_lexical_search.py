"""Ranked search against plain scoring of every document, and the walk over lists against full sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timedtext.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    held = [(i, fold(t)) for i, t in docs]
    held = [(i, x, Counter(x)) for i, x in held if x]
    n, total = len(held), sum(len(x) for _, x, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, x, c in held:
            m = 25 + 75 * len(x) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in fold(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "字", "A1", "X_y", "don't"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rnd.choices(words, weights, k=rnd.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("shard,block", [(4_000, 200_000), (70, 40)])
def test_equals_plain(spark, shard, block):
    docs = corpus(600, 1)
    docs += [(5, docs[5][1]), (5, "w1 w2 w59"), (None, "w59 w58 É"), (None, "w59"), (900, None), (901, ""), (902, " .,-\t"), (903, "w3 " * 40_000 + "W59"), (904, "\x7fw59\x1fÉ")]
    items = [(1, "w0 w1 w59 w59"), (2, "É straße unknown"), (2, "w40"), (3, None), (4, ""), (None, "w58 X_Y"), (1, "w0 w1 w59 w59"), (6, "none of these"), (7, " ".join(f"w{i}" for i in range(60)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    for c in ("id", "n", "term", "score", "rank"):
        d, q = d.withColumn(c, F.lit(9)), q.withColumn(c, F.lit("x"))
    assert got(L.search(d, q, shard=shard, block=block)) == plain(docs, items)


def test_empty(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(d.limit(0), q).count() == 0 and L.search(d, q.limit(0)).count() == 0
    assert L.search(d, q).count() == 1


@pytest.mark.parametrize("seed", range(30))
def test_walk_equals_sums(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    lists, total = [], np.zeros(n, np.int64)
    for _ in range(int(rng.integers(1, 12))):
        docs = np.flatnonzero(rng.random(n) < rng.choice([0.003, 0.05, 0.5, 1.0]))
        if len(docs):
            adds = rng.integers(1, int(rng.choice([3, 50, 100_000])), len(docs))
            lists.append(L.Postings(docs, adds, int(adds.max())))
            total[docs] += adds
    want = [d for d in np.lexsort((np.arange(n), -total)) if total[d] > 0][:10]
    kept, sums = L.best(lists, n, 10, short=int(rng.choice([0, 20, 400])), step=int(rng.choice([1, 64, 256])))
    assert kept.tolist() == want and sums.tolist() == total[want].tolist()


def test_walk_skips():
    """Once the rare list has filled the result, the common one is only probed."""
    rare = L.Postings(np.arange(0, 200), np.full(200, 1000), 1000)
    looked = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                looked.append(at.stop - at.start)
            return super().__getitem__(at)

    common = L.Postings(np.arange(100_000).view(Watched), np.full(100_000, 1), 1)
    kept, _ = L.best([rare, common], 100_000, 10)
    assert kept.tolist() == list(range(10)) and sum(looked) <= 2 * L.STEP
