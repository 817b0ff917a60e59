"""Near-duplicate documents: SimHash fingerprints linked through vantage-point trees.

The 64 bits are cut into bands, and each band has a tree over the Hamming distance restricted to its bits. A node of a tree
splits its fingerprints into rings, one for each distance to the node's vantage point; the rings of all levels name a leaf.
Two fingerprints that differ in at most ``max_bits`` bits differ in at most ``radius`` bits of some band, because the
radii are chosen so that the sum of ``radius + 1`` is ``max_bits + 1``. By the triangle inequality the ring of the other
one is then at most ``radius`` away at every level, and of the same parity as the distance: only these leaves are visited,
all others are pruned. A leaf and the visitors from across its boundaries form a shard, in which exact distances are taken.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, with_lowest

#: (bits, radius) of each band for links at 4 or fewer differing bits: 2 + 1 + 1 + 1 = 4 + 1.
BANDS_4 = ((19, 1), (15, 0), (15, 0), (15, 0))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of one text as a signed 64-bit number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    start, stop = [0, *ends[: n - 1].tolist()], (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(start[i : i + 65536], stop[i : i + 65536])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` of every row, repeated rows included; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, base.select("id").schema.add("fp", "long"))


@dataclass(frozen=True)
class Tree:
    """A vantage-point tree: its band, its search radius and the vantage point of each level."""

    mask: int
    radius: int
    points: tuple[int, ...]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(a: np.ndarray, point: int, mask: int) -> np.ndarray:
    return np.bitwise_count((a.view(np.uint64) ^ np.uint64(point & (2**64 - 1))) & np.uint64(mask)).astype(np.int64)


def build_trees(sample: np.ndarray, n: int, bands: tuple[tuple[int, int], ...], leaf: int) -> list[Tree]:
    """Choose the vantage points on a bounded sample of ``n`` distinct fingerprints.

    Each level takes the candidate that leaves the fewest pairs of the sample together. Levels are added until the largest
    leaf is expected to hold ``leaf`` fingerprints; a tree with a radius over one stays shallow, since each level multiplies
    its visits.
    """
    out, at = [], 0
    rng = np.random.default_rng(64)
    for width, radius in bands:
        mask = ((1 << width) - 1) << at
        at += width
        points, keys = [], np.zeros(len(sample), np.int64)
        while len(points) < (8 if radius < 2 else 4) and len(sample):
            if np.unique(keys, return_counts=True)[1].max() / len(sample) * n <= leaf:
                break
            tried = [int(x) for x in rng.integers(0, 2**63, 24)]
            cost = [(np.unique(keys * 64 + _bits(sample, p, mask), return_counts=True)[1] ** 2).sum() for p in tried]
            best = tried[int(np.argmin(cost))]
            points.append(best)
            keys = np.unique(keys * 64 + _bits(sample, best, mask), return_inverse=True)[1]
        out.append(Tree(mask, radius, tuple(points)))
    return out


def _rings(tree: Tree) -> Column:
    """The leaf of a fingerprint: its ring at each level as a digit to base 128, shifted by the radius so that none is negative."""
    leaf = F.lit(0).cast("long")
    for i, p in enumerate(tree.points):
        ring = F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(_signed(tree.mask)))).cast("long")
        leaf = leaf + (ring + tree.radius) * (128**i)
    return leaf


def visits(tree: Tree) -> list[Column]:
    """Differences to the own leaf of the other leaves that a search visits; null where a difference is not visited.

    Within distance one, flipping bit b moves every ring by one, up or down as the vantage point's bit is equal or not, so that
    at most one leaf a bit is visited, however deep the tree. For larger radii all rings within the triangle bounds and of
    the right parity are. Of two leaves that would visit each other, only the one with the higher first ring visits.
    """
    if not tree.points or tree.radius == 0:
        return []
    if tree.radius == 1:
        out = []
        for b in (b for b in range(64) if tree.mask >> b & 1):
            up = sum((1 - 2 * (p >> b & 1)) * 128**i for i, p in enumerate(tree.points))
            bit = F.shiftright("fp", b).bitwiseAND(F.lit(1)) == 1
            first = tree.points[0] >> b & 1
            out.append(F.when(bit, F.lit(-up) if not first else F.lit(None)).otherwise(F.lit(up) if first else F.lit(None)).cast("long"))
        return out
    near = {d for t in range(tree.radius + 1) for d in itertools.product(range(-t, t + 1, 2), repeat=len(tree.points))}
    near = {d for d in near if any(d) and next(x for x in d if x) < 0}
    return [F.lit(sum(x * 128**i for i, x in enumerate(d))).cast("long") for d in sorted(near)]


def _placed(fps: DataFrame, trees: list[Tree]) -> DataFrame:
    """``(tree, leaf, home, fp)``: each fingerprint in its leaf and, as a visitor, in those across the boundaries."""
    parts = []
    for t, tree in enumerate(trees):
        leaf = _rings(tree)
        own = F.array(F.struct(F.lit(t).alias("tree"), leaf.alias("leaf"), F.lit(True).alias("home")))
        if near := visits(tree):
            moves = F.filter(F.array_distinct(F.array(*near)), lambda x: x.isNotNull())
            own = F.concat(own, F.transform(moves, lambda x: F.struct(F.lit(t).alias("tree"), (leaf + x).alias("leaf"), F.lit(False).alias("home"))))
        parts.append(own)
    return fps.select("fp", F.explode(F.concat(*parts)).alias("at")).select("at.tree", "at.leaf", "at.home", "fp")


def _forest(fp: np.ndarray, home: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join whatever the links of home rows with all rows of the shard join: at most one a row less."""
    u, rows, label = fp.view(np.uint64), np.flatnonzero(home), np.arange(len(fp))
    out: list[tuple[int, int]] = []
    for k in range(0, len(rows), 256):
        block = rows[k : k + 256]
        near = np.bitwise_count(u[block][:, None] ^ u[None, :]) <= max_bits
        several = near.sum(axis=1) > 1
        for i, row in zip(block[several], near[several]):
            hits = np.flatnonzero(row)
            names, at = np.unique(label[hits], return_index=True)
            if len(names) > 1:
                out += [(int(fp[i]), int(fp[hits[j]])) for j in at if label[hits[j]] != label[i]]
                label[np.isin(label, names)] = names[0]
    return out


def fingerprint_links(fps: DataFrame, scratch: Scratch, max_bits: int = 4, bands: tuple[tuple[int, int], ...] = BANDS_4, leaf: int = 1000, sample: int = 8192, split: int = 6000) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fps(fp)`` that join all pairs at ``max_bits`` or fewer differing bits.

    The trees come from a sample of at most ``sample`` fingerprints; every fingerprint is placed. A shard of more than
    ``split`` rows is cut into chunks whose pairs are tasks of their own, so that no task holds an unbounded group.
    """
    if sum(r + 1 for _, r in bands) != max_bits + 1 or sum(w for w, _ in bands) != 64:
        raise ValueError("bands must cover 64 bits, and their radii plus one must add up to max_bits + 1")
    n = fps.count()
    some = fps.orderBy(F.hash("fp")).limit(sample).toPandas()["fp"].to_numpy(np.int64)
    trees = build_trees(some, n, bands, leaf)
    placed = _placed(fps, trees)
    chunks = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / split).cast("int").alias("chunks"))
    placed = placed.join(chunks.hint("merge"), ["tree", "leaf"]).withColumn("own", F.pmod(F.hash("fp"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    placed = placed.select("tree", "leaf", "home", "fp", "own", other).select("tree", "leaf", "home", "fp", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home", "fp"], ascending=False)
        return pd.DataFrame(_forest(pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool), max_bits), columns=["a", "b"], dtype=np.int64)

    return placed.groupBy("tree", "leaf", "x", "y").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, **tree: object) -> DataFrame:
    """``(id, fp, component_id)`` of every row: its SimHash and the smallest id reachable through links.

    Texts are lower-cased in A-Z, words are cut at blanks, and fingerprints link at ``max_bits`` or fewer differing bits.
    Exact copies share a fingerprint and are one node. Defined cases: texts that are null, empty or without words have
    fingerprint 0 and link like any other; rows with a null id keep their row, and ids that are null are never the
    smallest unless a component has no other; ids may be of any type that has an order; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = scratch.table(rows.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    links = scratch.table(fingerprint_links(classes.select("fp"), scratch, max_bits, **tree), "links")
    found = scratch.table(components(links, scratch), "components")
    roots = classes.join(found.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    roots = scratch.table(roots, "roots")
    labels = scratch.table(with_lowest(roots, "root", "low", "component_id", "fp").select("fp", "component_id"), "labels")
    return rows.join(labels.hint("merge"), "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

