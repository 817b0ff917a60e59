"""Hard negatives: for each anchor and positive the closest rows of other labels that are not too close.

Every vector has a one-bit code: it is rotated into ``spread`` times as many dimensions and the signs are kept, with the alignment
of the vector and its code. An anchor is rotated too and rounded to a few bit planes, so that popcounts estimate its product with a code. What
the code does not say of a vector stands at right angles to it; by Cauchy-Schwarz that part adds at most its length times the
anchor's own part at right angles. So each row has an interval that certainly holds its score, and only rows whose interval
reaches what is wanted are scored, by integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SPREAD, PLANES, SEED = 8, 6, 5
#: Intervals are widened by this, as estimates are rounded.
_SLACK = 1e-9
#: Longer integer vectors could have scores beyond 64 bits.
MOST_NORM = 2.0**31
#: Stands for a null id, which comes last in ties.
_NO_ID = (1 << 63) - 1
_KEYS = ["dim", "chunk", "block"]


@cache
def rotation(dim: int, spread: int = SPREAD) -> np.ndarray:
    """``spread * dim`` rows with orthonormal columns, the same in every worker; as many rows as fill 64-bit words."""
    rows = -(-dim * spread // 64) * 64
    return np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((rows, dim)))[0]


class Codes(NamedTuple):
    bits: np.ndarray  # 64-bit words, one row of all vectors for each word
    ones: np.ndarray
    align: np.ndarray  # product of the unit vector and its code
    length: np.ndarray  # of the code, turned back into the vector's own dimensions
    norm: np.ndarray


def encode(v: np.ndarray) -> Codes:
    r = rotation(v.shape[1])
    norm = np.linalg.norm(v, axis=1)
    unit = v / np.where(norm > 0, norm, 1)[:, None]
    sign = unit @ r.T >= 0
    back = np.where(sign, 1.0, -1.0) @ r / np.sqrt(len(r))
    bits = np.packbits(sign, axis=1, bitorder="little").view("<u8")
    return Codes(bits.T, sign.sum(axis=1).astype(np.int64), (unit * back).sum(axis=1), np.linalg.norm(back, axis=1), norm)


def intervals(anchor: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the product of ``anchor`` and each coded vector."""
    norm = np.linalg.norm(anchor)
    if not norm:
        return np.zeros(len(codes.norm)), np.zeros(len(codes.norm))
    y = rotation(len(anchor)) @ (anchor / norm)
    low, step = y.min(), max(y.max() - y.min(), 1e-300) / (2**PLANES - 1)
    level = np.rint((y - low) / step).astype(np.int64)
    off = np.linalg.norm(y - low - step * level)
    planes = np.packbits((level[None] >> np.arange(PLANES)[:, None]) & 1 == 1, axis=1, bitorder="little").view("<u8")
    counted = np.zeros(len(codes.ones), np.int64)
    for j, plane in enumerate(planes):
        counted += np.bitwise_count(codes.bits & plane[:, None]).sum(axis=0, dtype=np.int64) << j
    product = (2 * (low * codes.ones + step * counted) - low * len(y) - step * level.sum()) / np.sqrt(len(y))
    length = np.maximum(codes.length, 1e-300)
    along = codes.align / length**2
    rest = np.sqrt(np.maximum(0, 1 - (codes.align / length) ** 2))
    least = np.maximum(0, np.abs(product) - off) / length
    radius = np.abs(along) * off + rest * np.sqrt(np.maximum(0, 1 - np.minimum(1, least) ** 2)) + _SLACK
    scale = norm * codes.norm
    return scale * (along * product - radius), scale * (along * product + radius)


class Rows(NamedTuple):
    """Rows of one length, by label and then id; ``most``: the largest component."""

    rid: np.ndarray
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    codes: Codes
    most: float


def _rows(t: pa.Table, dim: int) -> Rows:
    t = t.combine_chunks()
    column = lambda name: t[name].to_numpy()
    v = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim) if len(t) else np.zeros((0, dim), np.int64)
    bits = np.frombuffer(b"".join(t["bits"].to_pylist()), "<u8").reshape(-1, len(rotation(dim)) // 64)
    order = np.lexsort((column("id"), column("label")))
    codes = Codes(np.ascontiguousarray(bits[order].T), *[column(c)[order] for c in ("ones", "align", "length", "norm")])
    return rows_of(*[column(c)[order] for c in ("rid", "id", "label")], v[order], codes)


def rows_of(rid: np.ndarray, id_: np.ndarray, label: np.ndarray, v: np.ndarray, codes: Codes) -> Rows:
    """Components as floats where all products among these rows are exact in them."""
    most = float(np.abs(v).max(initial=0))
    return Rows(rid, id_, label, v.astype(np.float64 if most**2 * v.shape[1] < 2.0**53 else np.int64), codes, most)


def _scores(rows: Rows, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer products with the rows ``at``: floats hold them exactly below 2^53, and are used only there."""
    both = float(np.abs(anchor).max(initial=0)) * rows.most * len(anchor) < 2.0**53
    kind = np.float64 if both else np.int64
    return (rows.v[at].astype(kind, copy=False) @ anchor.astype(kind, copy=False)).astype(np.int64)


def _part(codes: Codes, at: slice) -> Codes:
    return Codes(codes.bits[:, at], *[x[at] for x in codes[1:]])


def closest(rows: Rows, rid: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best rows of the anchor's label other than itself."""
    a, b = np.searchsorted(rows.label, label, "left"), np.searchsorted(rows.label, label, "right")
    low, high = intervals(anchor, _part(rows.codes, slice(a, b)))
    other = rows.rid[a:b] != rid
    if np.count_nonzero(other) > k:
        other &= high >= np.partition(low[other], -k)[-k]
    at = np.flatnonzero(other) + a
    score = _scores(rows, at, anchor)
    best = np.lexsort((rows.id[at], -score))[:k]
    return at[best], score[best]


def in_bands(rows: Rows, label: int, anchor: np.ndarray, bands: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each band of scores, places and scores of the ``k`` best rows of other labels within it."""
    low, high = intervals(anchor, rows.codes)
    own = slice(np.searchsorted(rows.label, label, "left"), np.searchsorted(rows.label, label, "right"))
    low[own] = high[own] = -np.inf
    wanted = np.zeros(len(low), bool)
    for first, last in bands:
        sure = low[(low >= first) & (high <= last)]
        least = max(first, np.partition(sure, -k)[-k]) if len(sure) >= k else first
        wanted |= (high >= least) & (low <= last)
    at = np.flatnonzero(wanted)
    score, out = _scores(rows, at, anchor), []
    for first, last in bands:
        inside = np.flatnonzero((score >= first) & (score <= last))
        best = inside[np.lexsort((rows.id[at[inside]], -score[inside]))[:k]]
        out.append((at[best], score[best]))
    return out


def _coded(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that take part, as integers with their codes; equal rows are one."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    good = (F.size("x") > 0) & F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.col("label").isNotNull()
    base = base.where(F.coalesce(good, F.lit(False)))
    moved = F.when(F.pmod("id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    whole = F.transform("x", lambda x: F.floor(x * 256))
    small = F.forall("x", lambda x: F.abs(x) < MOST_NORM / 256) & (F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x.cast("double"))) < MOST_NORM)
    base = base.select("id", moved.alias("label"), "x", whole.alias("v")).where(small)
    base = base.select(F.xxhash64(F.col("id").isNull(), "id", "label", "v").alias("rid"), F.coalesce("id", F.lit(_NO_ID)).alias("id"), "label", F.size("v").alias("dim"), "v").dropDuplicates(["rid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(3).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                c = encode(part.column(4).flatten().to_numpy().reshape(-1, dim).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in np.ascontiguousarray(c.bits.T)], pa.binary()), *[pa.array(x) for x in c[1:]]], [*part.schema.names, "bits", "ones", "align", "length", "norm"])

    return base.mapInArrow(run, "rid long, id long, label long, dim int, v array<long>, bits binary, ones long, align double, length double, norm double")


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), chunk: int = 1_500, block: int = 512) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``. Their positives are the ``positives`` best other rows of their label; for
    each, the ``negatives`` best rows of other labels with a score within ``band`` per cent of the positive's. A task holds ``chunk``
    rows and ``block`` anchors; every anchor meets every row's code, and labels of any size are dealt over chunks. Defined cases: rows with
    a null label or vector, or a null or non-finite component, take no part, nor do integer vectors of a length of 2^31 or more, whose
    scores would not fit 64 bits; ids are integers, a null id is never an anchor and comes last in ties; rows that are equal in id,
    label and vector are one row; rows that share an id only are rows of their own; vectors of different lengths do not meet;
    a zero vector scores 0; a negative positive score has no negatives; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.table(_coded(vectors, id_col, vector_col, label_col), "coded")
    is_anchor = (F.col("id") != _NO_ID) & (F.pmod("id", F.lit(every)) == 0)
    n = rows.agg(F.count("*").alias("rows"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    chunks, blocks = max(1, -(-n["rows"] // chunk)), max(1, -(-n["anchors"] // block))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda name, count: F.pmod("rid", F.lit(count)).cast("int").alias(name)
    dealt = rows.select("*", own("chunk", chunks), each(blocks).alias("block"))
    # Written apart, so that both sides of the meeting have columns of their own.
    anchors = scratch.table(rows.where(is_anchor).select("rid", "id", "label", "dim", "v", own("block", blocks)), "anchors")

    def score(key: tuple, a: pa.Table, t: pa.Table, find) -> pa.Table:
        dim, out = key[0].as_py(), []
        if len(a) and len(t):
            held = _rows(t, dim)
            for x in a.to_pylist():
                for tag, at, s in find(held, x, np.array(x["v"], np.int64)):
                    out += [(x["rid"], x["id"], tag, held.id[i], held.rid[i], n) for i, n in zip(at.tolist(), s.tolist())]
        columns = list(zip(*out)) or [[]] * 6
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("rid", "anchor_id", "tag", "other_id", "other_rid", "score"), columns)})

    shape = "rid long, anchor_id long, tag long, other_id long, other_rid long, score long"
    meet = lambda left, f: left.select("*", each(chunks).alias("chunk")).groupBy(*_KEYS).cogroup(dealt.groupBy(*_KEYS)).applyInArrow(f, shape)
    best = lambda found, keys, k: found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id", "other_rid"))).where(F.col("rank") <= k)

    def near(key: tuple, a: pa.Table, t: pa.Table) -> pa.Table:
        return score(key, a, t, lambda held, x, v: [(0, *closest(held, x["rid"], x["label"], v, positives))])

    def hard(key: tuple, a: pa.Table, t: pa.Table) -> pa.Table:
        lo, hi = band

        def find(held: Rows, x: dict, v: np.ndarray) -> list:
            bands = [(p, -(-lo * p // 100), hi * p // 100) for p in sorted(set(x["scores"])) if p >= 0]
            return [(p, *hit) for (p, _, _), hit in zip(bands, in_bands(held, x["label"], v, [b[1:] for b in bands], negatives))] if bands else []

        return score(key, a, t, find)

    liked = scratch.table(best(meet(anchors, near), ["rid"], positives), "positives")
    # An anchor has few positives, so that the list has a bound.
    scored = anchors.join(liked.groupBy("rid").agg(F.collect_list("score").alias("scores")).hint("merge"), "rid")
    disliked = best(meet(scored, hard), ["rid", "tag"], negatives).select("rid", F.col("tag").alias("score"), "rank", F.col("other_id").alias("negative"), F.col("score").alias("negative_score"))
    out = liked.select("rid", "anchor_id", F.col("other_id").alias("positive"), "score").join(disliked.hint("merge"), ["rid", "score"])
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select("anchor_id", known("positive").alias("positive_id"), "rank", known("negative").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score")
