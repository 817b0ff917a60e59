"""Near copies of documents: the SimHash operator's trees and MinHash bands propose, exact Jaccard similarity decides.

Fingerprints of similar texts differ in more bits than the trees can search: about ten at a similarity of 0.8. Minima of independent
hashes agree with a chance equal to the similarity, whatever the length of the texts: at 0.8 a band of four agrees with a
chance of 0.41, one of the fourteen bands with 0.9994. Both give groups of texts that are linked by the machinery of the line
deduplication, which verifies the exact sets and lists no pairs of a large family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components
from .line_dedup import FEW_IDS, WORDS, linked
from .simhash import fingerprint_links

SHINGLE = 5
BANDS, ROWS = 14, 4
_RND = np.random.default_rng(514)
#: Odd factors and summands of the hashes, one for each minimum.
_FACTORS = _RND.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SUMMANDS = _RND.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_BLOCK = 4096


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - SHINGLE + 1)
    start, stop = [0, *ends[: n - 1].tolist()], (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 5) for a, b in zip(start, stop)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The bands' keys as signed 64-bit numbers; texts without words share all of them."""
    least = np.full((BANDS * ROWS, 1), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), _BLOCK):
        block = hashes[None, i : i + _BLOCK] * _FACTORS + _SUMMANDS
        least = np.minimum(least, block.min(axis=1, keepdims=True))
    return np.array([xxhash.xxh64_intdigest(least[ROWS * b : ROWS * (b + 1)].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def _fingerprint(hashes: np.ndarray) -> int:
    """SimHash of the distinct shingles; 0 without words."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _sketch(hashes: np.ndarray) -> list[int]:
    """A bit for each of 1,024 slots: whether an odd number of the hashes falls there."""
    odd = np.bincount((hashes & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def text_key(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def near_copies(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """``(node, root)`` of the texts that link with another one, by ``text_key``; all texts of a component have one root.

    Texts link at a Jaccard similarity of 0.8 or more over distinct shingles of five words, lower-cased in A-Z and cut at
    blanks. Defined cases: a null text is an empty one; texts without words link with each other; texts that
    differ share a 64-bit key with a chance of n**2 / 2**65.
    """
    base = docs.select(text_key(text_col).alias("h1"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(t.as_py()) for t in b.column(1)]
            keys, fp = [band_keys(x) for x in found], [_fingerprint(x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(fp, pa.int64())], ["h1", "keys", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(t.as_py()) for t in b.column(1)]
            sketch = np.array([_sketch(x) for x in found], np.int64).reshape(-1, WORDS)
            columns = [b.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([len(x) for x in found], pa.int64()), *[pa.array(sketch[:, j]) for j in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "shingles", "n", *[f"w{j}" for j in range(WORDS)]])

    def sets_of(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        ids = scratch.table(ids, "ids")
        one = lambda df: df.groupBy("h1").agg(F.max("text").alias("text"))
        # Copies of a text are brought together before they are shuffled, so that a text with many is no hot key.
        text = one(base.join(F.broadcast(ids), "h1", "left_semi")) if ids.count() <= FEW_IDS else one(base).join(ids.hint("merge"), "h1", "left_semi")
        every = scratch.table(text.mapInArrow(sets, "h1 long, shingles array<long>, n long, " + ", ".join(f"w{j} long" for j in range(WORDS))), "sets")
        return every.select("h1", "shingles"), every.drop("shingles")

    keys = base.mapInArrow(bands, "h1 long, keys array<long>, fp long").groupBy("h1").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    keys = scratch.table(keys, "keys")
    links = scratch.table(fingerprint_links(keys.select("fp").distinct(), scratch), "fingerprint-links")
    trees = scratch.table(components(links, scratch, "fingerprint-cc"), "fingerprint-components")
    near = keys.select("h1", "fp").join(trees.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    near = scratch.table(near.select("h1", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("key")), "fingerprint-keys")
    return linked(keys.select("h1", F.explode("keys").alias("key")).unionByName(near), sets_of, scratch)
