"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Bound on the labelled rows that one model is fitted on.
TRAIN_ROWS = 20_000
_RUN = re.compile(r"(.)\1+")
_KINDS = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})


def _shape(word: str) -> str:
    """The word's shape: letters by case, digits, other characters as they are, runs shortened."""
    s = word.translate(_KINDS)
    if not s.isascii():
        s = "".join("a" if c.islower() else "A" if c.isupper() else c for c in s)
    return _RUN.sub(r"\1", s)


class _Words(dict):
    """Hashes of a word and of its shape, kept for short words seen; emptied before it grows large."""

    def __missing__(self, word: str) -> tuple[int, int]:
        got = (xxhash.xxh64_intdigest(word.lower(), 1), xxhash.xxh64_intdigest(_shape(word), 2))
        if len(word) <= 40:
            if len(self) > 300_000:
                self.clear()
            self[word] = got
        return got


_SEEN = _Words()


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a whole text by bucket: of word unigrams and bigrams, of the same over word shapes, and of repeats."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.array([_SEEN[w] for w in words], np.uint64)
    word, shape = h[:, 0], h[:, 1]
    k, mul = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
    same = np.array([0x51ED, 0xA3B1], np.uint64)[(word[1:] == word[:-1]).astype(int)]
    parts = [word, word[:-1] * np.uint64(31) + word[1:], shape, shape[:-1] * np.uint64(31) + shape[1:], same]
    buckets = np.concatenate([(p * mul) >> k for p in parts]).astype(np.int64)
    return np.unique(buckets, return_counts=True)


def vector(index: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values ``log(1 + count)``, scaled to length one, and the bias in bucket 0."""
    value = np.log1p(count)
    return np.append(index, 0), np.append(value / np.sqrt(max(1e-300, (value**2).sum())), 1.0)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a whole text; one without words has only the bias."""
    return vector(*counts(text))


@dataclass(frozen=True)
class Ftrl:
    """Step and penalties of the per-coordinate updates, and passes over the training rows."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    epochs: int = 4


def _weights(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
    return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: Ftrl = Ftrl()) -> np.ndarray:
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for _ in range(p.epochs):
        for (index, value), y in zip(rows, labels):
            w = _weights(z[index], n[index], p)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            s = n[index]
            z[index] += g - (np.sqrt(s + g * g) - np.sqrt(s)) / p.alpha * w
            n[index] = s + g * g
    return _weights(z, n, p)


def fit(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most ``train_rows`` rows of ``labels(doc_id, quality)``, the lowest by the hash of their id.

    ``docs`` has ``doc_id`` and ``text``. Labels that are null count as missing; of texts with the same id the smallest is
    taken. With no labelled row all weights are 0, and every score is one half. Vectors are built where the texts are; the one
    training task gets the vectors of the bounded sample.
    """
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("__y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    text = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "__y").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [counts(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([p[k] for p in x], pa.list_(pa.int32())) for k in (0, 1)]], ["k", "y", "i", "n"])

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*frames, pd.DataFrame({"k": [], "y": [], "i": [], "n": []})]).sort_values("k")
        order = np.random.default_rng(7).permutation(len(rows))
        x = [vector(np.asarray(i, np.int64), np.asarray(n, np.int64)) for i, n in zip(rows["i"], rows["n"])]
        w = train_ftrl([x[o] for o in order], rows["y"].to_numpy(float)[order], p)
        yield pd.DataFrame({"w": [w.astype(np.float32).tobytes()]})

    sparse = text.select(F.xxhash64("doc_id").alias("k"), F.col("__y").cast("int"), "text").mapInArrow(vectors, "k long, y int, i array<int>, n array<int>")
    got = sparse.repartition(1).mapInPandas(train, "w binary").first()
    return np.frombuffer(got["w"], np.float32).astype(float) if got else np.zeros(1 << BITS)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row and ``score``, the probability of label 1; null texts score as empty ones.

    A kept column of that name is replaced; an empty table gives an empty result; repeated rows score alike.
    """
    keep = [c for c in keep if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            sums = np.fromiter((float(w[i] @ v) for i, v in (features(t.as_py()) for t in b.column(0))), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], [*keep, "score"])

    picked = docs.select(F.col(text_col).alias("__text"), *keep)
    schema = docs.select(*keep).schema.add("score", "double")
    return picked.mapInArrow(run, schema)
