"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts is the number of character n-grams (lengths 1 to 3, lower case) that
both have, divided by the root of the product of their numbers of n-grams. Nyström landmarks turn it into a finite feature
map, one-versus-rest kernel ridge regression is solved in it, and texts are scored by products of presence matrices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-grams are hashed to this many columns.
DIM = 1 << 15
LANDMARKS, PER_LANG, RIDGE = 256, 1200, 1e-2
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(r"[A-Za-z]")
_BLOCK = 64


def has_letter(text: str) -> bool:
    """A character of one of Unicode's letter categories; numerals like a half or a Roman eight are none."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Columns of the distinct n-grams of a whole text; blanks count as one character."""
    c = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mul, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 15)
    two = c[:-1] * np.uint64(0x110000) + c[1:]
    three = two[:-1] * np.uint64(0x110000) + c[2:]
    flag = np.zeros(DIM, bool)
    for k, g in enumerate((c, two, three)):
        flag[((g + np.uint64(k)) * mul) >> shift] = True
    return np.flatnonzero(flag)


def _rows(present: list[np.ndarray]) -> np.ndarray:
    """Presence rows of unit length."""
    out = np.zeros((len(present), DIM), np.float32)
    for row, at in zip(out, present):
        row[at] = 1 / np.sqrt(max(1, len(at)))
    return out


def _matrix(texts: list[str]) -> np.ndarray:
    return _rows([presence(t) for t in texts])


def fit_kernel_ridge(present: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages and the weights ``DIM x languages`` of the regression, folded through the landmarks.

    A score is ``k(x, landmarks) @ coefficients`` and the kernel a product of presence rows, so that the landmark matrix and
    the coefficients are multiplied once here.
    """
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((DIM, 0), np.float32)
    by = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    marks = _rows([present[i] for n in names for i in by[n][: max(1, landmarks // len(names))]])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    phi = np.concatenate([_rows(present[k : k + 512]) @ marks.T for k in range(0, len(present), 512)]).astype(float) @ root
    y = np.array([[x == n for n in names] for x in langs], float)
    # Rare languages weigh as much as common ones.
    weight = (1 / y.sum(axis=0))[y.argmax(axis=1)] * len(y) / len(names)
    beta = np.linalg.solve((phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ y)
    return names, (marks.T.astype(float) @ (root @ beta)).astype(np.float32)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG, most: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Fit on about ``per_lang`` rows of each language, ``most`` in all, drawn by the hash of the id.

    Rows without a language or a letter are left out; every language is learned. With so many languages that ``most`` is
    less than twenty rows of each, twenty of each are taken. Presence vectors are built where the texts are; the one training
    task gets the vectors of the sample, and the driver one count a language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy("l").collect()
    if not counts:
        return [], np.zeros((DIM, 0), np.float32)
    want = min(per_lang, max(20, most // len(counts)))
    draw = F.pmod(F.xxhash64("k", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["l"], want / r["n"])]), F.col("l"))
    some = rows.where(draw < rate).select(F.xxhash64("k", "t").alias("k"), "t", "l")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = pa.array([i for i, t in enumerate(b.column(1)) if has_letter(t.as_py())], pa.int64())
            at = pa.array([presence(b.column(1)[i.as_py()].as_py()) for i in known], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(known), at, b.column(2).take(known)], ["k", "at", "l"])

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([*frames, pd.DataFrame({"k": [], "at": [], "l": []})]).sort_values(["k", "l"])
        names, w = fit_kernel_ridge(list(pdf["at"]), list(pdf["l"]))
        yield pd.DataFrame({"names": [names], "w": [w.tobytes()]})

    got = some.mapInArrow(vectors, "k long, at array<int>, l string").repartition(1).mapInPandas(train, "names array<string>, w binary").first()
    if not got:
        return [], np.zeros((DIM, 0), np.float32)
    return list(got["names"]), np.frombuffer(got["w"], np.float32).reshape(DIM, -1)


def predict(docs: DataFrame, names: list[str], weights: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, ``lang_pred`` and ``score``.

    The score is the winning regression value, held to 0..1. Texts that are null or have no letter, and all texts of a model
    without languages, are ``und`` with score 0. Ties go to the first language by name. Kept columns of the two names are
    replaced; an empty table gives an empty result; repeated rows are predicted alike.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            lang, best = np.full(b.num_rows, UNDETERMINED, object), np.zeros(b.num_rows)
            known = [i for i, t in enumerate(b.column(0)) if names and t.is_valid and has_letter(t.as_py())]
            for k in range(0, len(known), _BLOCK):
                rows = known[k : k + _BLOCK]
                f = _matrix([b.column(0)[i].as_py() for i in rows]) @ w
                at = f.argmax(axis=1)
                lang[rows], best[rows] = np.array(names, object)[at], np.clip(f[np.arange(len(at)), at], 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(best)], [*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(F.col(text_col).alias("__text"), *keep).mapInArrow(run, schema)
