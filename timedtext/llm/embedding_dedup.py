"""Near-duplicate embeddings: exact cosine pairs by a dual traversal of a cover tree that is built over all vectors.

On the unit sphere a cosine of at least c is a distance of at most ``sqrt(2 - 2c)``. The tree grows in rounds over tables. A cell with
many vectors draws candidates; those further apart than the cell's radius become centres, every vector of the cell goes to its
nearest centre if that is within the radius, and these cells have half the radius. What no centre covers stays together and draws
again, until a round covers little: such vectors lie apart from each other, and no ball would tell them from each other.
Then pairs of cells are taken down the rounds: a pair goes when its centres are further apart than what both cells reach
and the threshold together. The vectors of what is left are compared exactly. The driver sees counts alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, with_lowest

#: Bounds are widened by this, as distances come from rounded cosines.
_SLACK = 1e-6
#: Radius of the first balls and the smallest one that is tried.
_FIRST, _LAST = 1.0, 1 / 64
#: A round that brings less than this share of a cell into balls, the centres apart, is its last one.
_YIELD = 0.05


def _unit(rows: list | np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is scaled to one first, so that no square overflows or vanishes."""
    v = np.asarray(rows, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))


def _vectors(t: pa.Table, name: str) -> np.ndarray:
    """A column of vectors of one length."""
    c = t[name].combine_chunks()
    return _unit(c.flatten().to_numpy().reshape(len(c), -1)) if len(c) else np.zeros((0, 0))


def separated(v: np.ndarray, radius: float) -> np.ndarray:
    """Places of a largest set in order whose members are further apart than ``radius``; all others are within it of one."""
    kept, free = [], np.ones(len(v), bool)
    for i in range(len(v)):
        if free[i]:
            kept.append(i)
            free &= _distance(v[i : i + 1], v)[0] > radius
    return np.array(kept, np.int64)


def _block(a: np.ndarray, b: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All ``(i, j)`` with a cosine of at least ``cosine``; within one set (``b`` None) those with i < j."""
    out = []
    for k in range(0, len(a), 512):
        hit = a[k : k + 512] @ (a if b is None else b).T >= cosine
        i, j = np.nonzero(hit)
        out.append((i + k, j) if b is not None else (i[i + k < j] + k, j[i + k < j]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links: ``(member, its smallest member)``."""
    label = np.arange(n)
    while True:
        low, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _grown(points: DataFrame, scratch: Scratch, name: str, leaf: int, draw: int, chunk: int) -> tuple[DataFrame, DataFrame] | None:
    """One round: ``(points, cells)`` of the cells that were opened; None if no cell has more than ``leaf`` vectors and a radius to try.

    ``points(node, copies, v, dim, cell, radius)``; a cell that had its last round has a radius of 0. ``cells(parent, cell, c, reach, ball)``.
    """
    n = points.where(F.col("radius") >= _LAST).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > leaf)
    n = scratch.table(n, f"{name}-open")
    if not n.limit(1).count():
        return None
    here = points.join(n.hint("merge"), "cell")
    # By a hash, so that a cell of any size sends about ``draw`` rows to the task that chooses its centres.
    drawn = F.pmod(F.xxhash64("node", F.lit(name)), F.lit(1 << 30)) < F.lit(float(draw << 30)) / F.col("n")

    def choose(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("node", "ascending")]))
        return t.take(pa.array(separated(_vectors(t, "v"), t["radius"][0].as_py()))).select(["cell", "node", "v"])

    centres = here.where(drawn).select("cell", "node", "v", "radius").groupBy("cell").applyInArrow(choose, "cell long, node long, v array<double>")
    centres = scratch.table(centres.select("cell", F.col("node").alias("centre"), F.col("v").alias("c")), f"{name}-centres")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    dealt = here.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    spread = centres.join(n.hint("merge"), "cell").select("cell", "centre", "c", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

    def assign(key: tuple, c: pa.Table, t: pa.Table) -> pa.Table:
        near, d = np.zeros(len(t), np.int64), np.full(len(t), np.inf)
        if len(c) and len(t):
            to, own = _vectors(c, "c"), _vectors(t, "v")
            for k in range(0, len(t), 1000):
                each = _distance(own[k : k + 1000], to)
                near[k : k + 1000], d[k : k + 1000] = each.argmin(axis=1), each.min(axis=1)
        inside = d <= t["radius"].to_numpy()
        centre = c["centre"].take(pa.array(near)).to_numpy() if len(c) else near
        out = {x: t[x] for x in ("node", "copies", "v", "dim", "cell", "radius", "n")}
        return pa.table(out | {"centre": pa.array(centre, mask=~inside), "d": pa.array(np.where(inside, d, 0.0))})

    shape = "node long, copies long, v array<double>, dim int, cell long, radius double, n long, centre long, d double"
    at = spread.groupBy("cell", "part").cogroup(dealt.select("node", "copies", "v", "dim", "cell", "radius", "n", "part").groupBy("cell", "part")).applyInArrow(assign, shape)
    at = scratch.table(at.withColumn("child", F.xxhash64("cell", F.coalesce("centre", F.lit(0)), F.lit(name))), f"{name}-at")
    cells = at.groupBy("cell", "child", "centre").agg(F.max("d").alias("reach"), F.count("*").alias("size"), F.first("n").alias("n"))
    cells = scratch.table(cells.join(centres.hint("merge"), ["cell", "centre"], "left").select(F.col("cell").alias("parent"), F.col("child").alias("cell"), "c", "reach", "size", "n", F.col("centre").isNotNull().alias("ball")), f"{name}-cells")
    count = cells.groupBy("parent").agg(F.sum(F.when(F.col("ball"), F.col("size") - 1).otherwise(0)).alias("gain"), F.max("n").alias("n"))
    dry = count.where(F.col("gain") < _YIELD * F.col("n")).select(F.col("parent").alias("cell"), F.lit(True).alias("dry"))
    moved = at.join(dry.hint("merge"), "cell", "left")
    radius = F.when(F.col("centre").isNotNull(), F.col("radius") / 2).when(F.col("dry"), 0.0).otherwise(F.col("radius"))
    return scratch.table(moved.select("node", "copies", "v", "dim", F.col("child").alias("cell"), radius.alias("radius")), f"{name}-points"), cells


def _descended(pairs: DataFrame, cells: DataFrame, known: DataFrame, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """Pairs ``(a, b)`` after one round: opened cells give way to their children, pairs out of reach go.

    ``cells(parent, cell, c, reach)`` are this round's children and ``known`` all cells so far. A cell has about as many children as centres
    are drawn, so that the children of a pair of cells fit a task.
    """
    down = cells.select("parent", F.col("cell").alias("child"))
    opened = cells.select(F.col("parent").alias("cell")).distinct().withColumn("open", F.lit(True))
    both = pairs.join(opened.toDF("a", "open_a").hint("merge"), "a", "left").join(opened.toDF("b", "open_b").hint("merge"), "b", "left")
    both = scratch.table(both.withColumn("open", F.coalesce("open_a", "open_b")).select("a", "b", "open"), f"{name}-marked")
    node = known.select(F.col("cell").alias("child"), "c", "reach")

    def side(of: str) -> DataFrame:
        d = both.where("open").join(down.withColumnRenamed("parent", of).hint("merge"), of, "left").withColumn("child", F.coalesce("child", of))
        return d.join(node.hint("merge"), "child").select("a", "b", F.lit(of == "a").alias("first"), "child", "c", "reach")

    def keep(t: pa.Table) -> pa.Table:
        first = t["first"].to_numpy()
        x, y = t.filter(pa.array(first)), t.filter(pa.array(~first))
        d = _distance(_vectors(x, "c"), _vectors(y, "c"))
        i, j = np.nonzero(d <= x["reach"].to_numpy()[:, None] + y["reach"].to_numpy()[None] + threshold + _SLACK)
        p, q = x["child"].to_numpy()[i], y["child"].to_numpy()[j]
        return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    found = side("a").unionByName(side("b")).groupBy("a", "b").applyInArrow(keep, "a long, b long").distinct()
    return scratch.table(found.unionByName(both.where("open IS NULL").select("a", "b")), name)


def cell_pairs(nodes: DataFrame, threshold: float, scratch: Scratch, leaf: int, draw: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """``(points, pairs)``: all of ``nodes(node, copies, v, dim)`` in cells, and the pairs ``a <= b`` of cells that may hold near vectors."""
    # One root a length of vectors; any of its vectors is its centre, and 2 is as far as unit vectors can be apart.
    roots = scratch.table(nodes.groupBy("dim").agg(F.min_by("v", "node").alias("c")).select(F.col("dim").cast("long").alias("cell"), "c", F.lit(2.0).alias("reach")), "roots")
    points = nodes.select("node", "copies", "v", "dim", F.col("dim").cast("long").alias("cell"), F.lit(_FIRST).alias("radius"))
    closed, levels = [], []
    while (grown := _grown(points, scratch, f"round-{len(levels)}", leaf, draw, chunk // 2)) is not None:
        at, cells = grown
        closed.append(points.join(cells.select(F.col("parent").alias("cell")).distinct().hint("merge"), "cell", "left_anti"))
        points = at
        levels.append(cells)
    for x in closed:
        points = points.unionByName(x.select(*points.columns))
    known, pairs = roots, roots.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    for k, cells in enumerate(levels):
        # What no ball took has the centre and the reach of its parent.
        up = known.select(F.col("cell").alias("parent"), F.col("c").alias("above"), F.col("reach").alias("far"))
        own = cells.join(up.hint("merge"), "parent").select("parent", "cell", F.coalesce("c", "above").alias("c"), F.when(F.col("ball"), F.col("reach")).otherwise(F.col("far")).alias("reach"))
        own = scratch.table(own, f"level-{k}")
        known = scratch.table(known.unionByName(own.drop("parent")), f"known-{k}")
        pairs = _descended(pairs, own, known, threshold, scratch, f"pairs-{k}")
    return points, pairs


def _sent(points: DataFrame, pairs: DataFrame, chunk: int, scratch: Scratch) -> DataFrame:
    """``(lo, hi, first, node, copies, v)``: each vector once for each pair of bins it takes part in.

    Small cells share bins of about ``chunk`` vectors by the hash of the cell; a large cell is cut into bins of its own.
    """
    size = scratch.table(points.groupBy("cell", "dim").agg(F.count("*").alias("n")), "sizes")
    small = F.col("n") * 2 <= chunk
    total = size.groupBy("dim").agg(F.sum(F.when(small, F.col("n")).otherwise(0)).alias("total"))
    shared = F.xxhash64("dim", F.pmod(F.xxhash64("cell"), F.greatest(F.lit(1), F.ceil(F.col("total") / chunk))))
    parts = F.when(small, 1).otherwise(F.ceil(F.col("n") / chunk)).cast("int")
    size = scratch.table(size.join(total.hint("merge"), "dim").select("cell", F.when(small, shared).otherwise(F.xxhash64("cell", F.lit("own"))).alias("bin"), parts.alias("parts")), "bins")
    bin_of = lambda part: F.xxhash64("bin", part)
    each = size.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "bin").select("cell", bin_of(F.col("part")).alias("bin"))
    met = pairs.join(each.toDF("a", "x").hint("merge"), "a").join(each.toDF("b", "y").hint("merge"), "b")
    met = met.select("a", "b", "x", "y", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
    # A cell goes only to the bins in which it has a partner.
    to = met.select(F.explode(F.array(F.struct(F.col("a").alias("cell"), F.col("x").alias("bin")), F.struct(F.col("b").alias("cell"), F.col("y").alias("bin")))).alias("e"), "lo", "hi").select("e.*", "lo", "hi")
    to = scratch.table(to.distinct(), "bin-pairs").withColumn("first", F.col("bin") == F.col("lo"))
    at = points.join(size.hint("merge"), "cell").select("node", "copies", "v", "cell", bin_of(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("bin"))
    return at.join(to.hint("merge"), ["cell", "bin"]).select("lo", "hi", "first", "node", "copies", "v")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, leaf: int = 256, draw: int = 512, chunk: int = 2048) -> DataFrame:
    """``(id, n_links, component_id)`` of every row: links are the pairs with a cosine of at least ``cosine``.

    Equal vectors are one node with a multiplicity, so that a large group of copies is compared once. A cell with more than ``leaf``
    vectors is opened, with about ``draw`` candidates for its centres; a task compares two bins of about ``chunk`` vectors. Vectors that lie
    apart from each other, as random ones of many dimensions do, stay in one cell, all pairs of whose bins are compared by
    matrix products. Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing and are
    their own component; rows with a null id keep their row, and count as links of others; ids may be of any type that has an
    order; vectors of different lengths do not link, each length has a root of its own; an empty table gives an empty result;
    other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))
    rows = base.select("id", F.when(good & F.exists("v", lambda x: x != 0), F.col("v")).alias("v"))
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    nodes = scratch.table(nodes.select(F.xxhash64("v").alias("node"), F.size("v").alias("dim"), "low", "copies", "v"), "nodes")
    threshold = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    points, pairs = cell_pairs(nodes.select("node", "copies", "v", "dim"), threshold, scratch, leaf, draw, chunk)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["first"]], pdf[~pdf["first"]]
        alone = len(right) == 0
        if not len(left) or (alone and pdf["lo"].iloc[0] != pdf["hi"].iloc[0]):
            return pd.DataFrame({"node": [], "links": [], "other": []}).astype(np.int64)
        a, b = _unit(list(left["v"])), None if alone else _unit(list(right["v"]))
        i, j = _block(a, b, cosine)
        both = left if alone else pd.concat([left, right])
        j = j if alone else j + len(left)
        node, copies = both["node"].to_numpy(np.int64), both["copies"].to_numpy(np.int64)
        links = np.bincount(i, copies[j], len(both)) + np.bincount(j, copies[i], len(both))
        other = node.copy()
        moved, to = _joined(len(both), i, j)
        other[moved] = node[to]
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "other": other[some]})

    sent = _sent(points, pairs, chunk, scratch)
    found = scratch.table(sent.groupBy("lo", "hi").applyInPandas(compare, "node long, links long, other long"), "found")
    joined = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = nodes.select("node", "low", "copies", "v").join(links.hint("merge"), "node", "left").join(joined.hint("merge"), "node", "left")
    label = scratch.table(label.select("v", "node", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "labels")
    label = scratch.table(with_lowest(label, "root", "low", "component_id", "node").select("v", "n_links", "component_id"), "final")
    out = rows.join(label.select(F.col("v").alias("__v"), "n_links", "component_id").hint("merge"), F.col("v") == F.col("__v"), "left")
    lone = F.col("v").isNull()
    return out.select("id", F.when(lone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(lone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
