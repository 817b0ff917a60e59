import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from timedtext.llm import simhash
from timedtext.llm.common import Scratch, components


def slow_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A b C d", "Ünïcode Ä b c d e\x0bf", "x " * 500, "the cat\x00 sat on   the mat\r\nand Ran"])
def test_fingerprint_is_the_contract(text):
    assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_spark_hash_is_the_same_function(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("the cat sat on"))).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"the cat sat on", 42)


@pytest.mark.parametrize("bands", [simhash.BANDS_4, ((13, 0), (13, 0), (13, 0), (13, 0), (12, 0)), ((24, 2), (20, 0), (20, 0)), ((64, 4),)])
def test_trees_find_all_links(spark, bands):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        for _ in range(4):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted({simhash._signed(f) for f in fps} | {0})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {(r.a, r.b) for r in simhash.fingerprint_links(df, Scratch(spark, "t"), bands=bands, leaf=10, split=40).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.argwhere(np.bitwise_count(u[:, None] ^ u[None]) <= 4)
    wanted = {(fps[i], fps[j]) for i, j in near if i < j}
    assert {(min(p), max(p)) for p in found} <= wanted
    assert groups(found, fps) == groups(wanted, fps)


def test_documents(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(12)]
    texts = base + [b.upper() for b in base[:4]] + [b + " tail" for b in base[:6]] + [None, "", " ", "one two"]
    rows = [(100 + i, t, "x") for i, t in enumerate(texts)] + [(None, base[0], "x"), (100, base[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.near_duplicates(df, leaf=5).collect()
    assert len(out) == len(rows)
    fp = [(i, slow_fingerprint(t)) for i, t, _ in rows]
    nodes = sorted({f for _, f in fp})
    wanted = groups([(a, b) for a in nodes for b in nodes if (a ^ b).bit_count() <= 4], nodes)
    low = {}
    for i, f in fp:
        if i is not None:
            low[wanted[f]] = min(low.get(wanted[f], i), i)
    assert sorted((str(r.id), r.fp % (1 << 64), r.component_id) for r in out) == sorted((str(i), f, low[wanted[f]]) for i, f in fp)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    want = groups([e for e in edges if e[0] != e[1]], sorted({x for e in edges for x in e if e[0] != e[1]}))
    assert got == want
