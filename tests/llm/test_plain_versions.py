"""The verdicts of the quality rules, the classifier's scores and the token ids against plain versions over all rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from timedtext.llm import packing
from timedtext.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
M = (1 << 32) - 1


def table(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'").fetchall()


@cache
def murmur(text, seed=42):
    """The hash that SQL calls ``hash``: 32-bit murmur3 over words of four bytes, then over single signed bytes."""
    data, h = text.encode(), seed & M
    cut = len(data) // 4 * 4
    for k in [int.from_bytes(data[i : i + 4], "little") for i in range(0, cut, 4)] + [b - 256 * (b > 127) for b in data[cut:]]:
        k = k * 0xCC9E2D51 & M
        k = (k << 15 | k >> 17) & M
        h ^= k * 0x1B873593 & M
        h = (h << 13 | h >> 19) & M
        h = (h * 5 + 0xE6546B64) & M
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & M
    h = (h ^ h >> 13) * 0xC2B2AE35 & M
    return h ^ h >> 16


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [murmur(x) % 65536 for x in w] + [murmur(b[-3:], murmur(a[-3:])) % 65536 for a, b in zip(w, [*w[1:], ""])]


def test_op4_kept_by_counts(spark):
    docs = {d[0]: grams(d[1]) for d in table("documents")}
    good = {i for i, q, _ in table("labels") if q == 1}
    raw = Counter(g for x in docs.values() for g in x)
    target = Counter(g for i, x in docs.items() if i in good for g in x)
    llr = {g: math.log((target[g] + 1) / (target.total() + 65536)) - math.log((n + 1) / (raw.total() + 65536)) for g, n in raw.items()}
    kept = 0
    for r in QUERIES["op4_quality_rules"](spark, DATA).collect():
        mean = np.mean([llr[g] for g in docs[r.doc_id]]) if docs[r.doc_id] else 0.0
        assert r.kept == (not r.base_failed and mean >= -0.3) or abs(mean + 0.3) < 1e-9
        kept += r.kept
    assert 0 < kept < len(docs)


def shape(word):
    kinds = ["a" if c.islower() else "A" if c.isupper() else "9" if c in "0123456789" else c for c in word]
    return "".join(c for c, before in zip(kinds, [None, *kinds]) if c != before)


def features(text):
    """Buckets and values of a text, the bias in bucket 0 apart."""
    words = (text or "").split()
    own = [xxhash.xxh64_intdigest(w.lower(), 1) for w in words]
    form = [xxhash.xxh64_intdigest(shape(w), 2) for w in words]
    keys = own + form + [a * 31 + b for x in (own, form) for a, b in zip(x, x[1:])] + [0xA3B1 if a == b else 0x51ED for a, b in zip(own, own[1:])]
    n = Counter((k % (1 << 64)) * 0x9E3779B97F4A7C15 % (1 << 64) >> 46 for k in keys)
    size = math.sqrt(sum(math.log1p(c) ** 2 for c in n.values())) or 1.0
    return [*((b, math.log1p(c) / size) for b, c in n.items()), (0, 1.0)]


def test_op1_scores_by_plain_updates(spark):
    docs = {d[0]: features(d[1]) for d in table("documents")}
    train = {i: q for i, q, _ in table("labels") if q is not None and i in docs and zlib.crc32(str(i).encode()) % 5 != 0}
    order = [r.id for r in spark.createDataFrame([(i,) for i in train], "id long").selectExpr("id", "xxhash64(id) k").orderBy("k").collect()]
    order = [order[k] for k in np.random.default_rng(7).permutation(len(order))]
    z, n = defaultdict(float), defaultdict(float)

    def weight(b):
        return -math.copysign(max(abs(z[b]) - 0.02, 0.0), z[b]) / ((1 + math.sqrt(n[b])) / 0.5 + 0.02)

    def chance(x):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(weight(b) * v for b, v in x)))))

    for i in order * 4:
        p = chance(docs[i])
        for b, v, w in [(b, v, weight(b)) for b, v in docs[i] if b] + [(0, 1.0, weight(0))]:
            g = (p - train[i]) * v
            z[b] += g - (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / 0.5 * w
            n[b] += g * g
    for r in QUERIES["op1_quality_classifier"](spark, DATA).collect():
        assert abs(r.score - chance(docs[r.doc_id])) < 1e-3, r.doc_id


def test_token_ids_of_odd_strings():
    plain, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    enc = packing.tokenizer(*packing.default_tokenizer())
    signs = ["a", "Bc", "é", "字", " ", " ", "\n", "\t", "'s", "'", "1", "½", ".", "-", "\r", "\x1c", "\x85", "　", "<|endoftext|>", "😀", "́", "ll", "\x00"]
    for _ in range(20_000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randrange(14)))
        assert enc.encode(t, allowed_special="all") == plain.encode(t, add_special_tokens=False).ids, t
