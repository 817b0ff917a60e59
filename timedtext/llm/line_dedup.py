"""Fuzzy line deduplication by MinHash, with DataFrame expressions only.

Lines are compared by the Jaccard similarity of their sets of character shingles. Six minima per line form two triangles, each side
of which is a band of two minima; colliding lines are verified by their exact shingle sets, links are closed by connected
components, and one line of each component stays.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components

SHINGLE = 12
THRESHOLD = 0.8
#: Two triangles over six minima: a pair at a similarity of 0.8 agrees in two minima of one of them with a chance of 0.989.
BANDS = ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5))
MINIMA = 6
#: Words of a sketch, and members of a bucket that are compared in one task.
WORDS, _CHUNK = 16, 2000
#: Members of a bucket that the others are held against before all are.
_REPS = 64
#: Members of a bucket that all are compared at once, without representatives.
_FEW = 32
_UNROLL = 8
#: Up to this many ids (16 MB) are broadcast to fetch their lines; more are joined by a sort merge.
FEW_IDS = 2_000_000
#: At most so many lines are told apart as frequent ones.
_FREQUENT = 10_000


def _shingle_rows(lines: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``keys``, ``__first`` (1 in the first row of a line) and eight shingle hashes ``__s0..__s7`` at consecutive positions.

    Characters are UTF-16 code units; a line shorter than a shingle is one shingle. Positions past the end repeat the last
    shingle, which changes neither a minimum nor a set. Eight a row, so that what stands above works once per eight.
    """
    b = lines.select(*keys, F.encode("line", "UTF-16BE").alias("__b"))
    b = b.withColumn("__n", F.expr(f"greatest(1, octet_length(__b) div 2 - {SHINGLE - 1})"))
    s = b.select(*keys, "__b", "__n", F.explode(F.expr(f"sequence(0, __n - 1, {_UNROLL})")).alias("__i"))
    at = [f"hash(substring(__b, 2 * least(__i + {u}, __n - 1) + 1, {2 * SHINGLE}))" for u in range(_UNROLL)]
    return s.select(*keys, (F.col("__i") == 0).cast("long").alias("__first"), *[F.expr(x).alias(f"__s{u}") for u, x in enumerate(at)])


def signatures(lines: DataFrame) -> DataFrame:
    """One row per distinct line: ``h1, h2`` (its hashes), ``n`` (occurrences) and the minima ``m0..m5``.

    Each minimum has its own order of the hashes: an odd factor modulo 2^31 lets all lower bits decide about the top ones.
    """
    rnd = random.Random(20)
    factors = [rnd.getrandbits(31) | 1 for _ in range(MINIMA)]
    least = [F.least(*[(F.col(f"__s{u}").cast("long") * F.lit(c)).bitwiseAND(F.lit(2**31 - 1)) for u in range(_UNROLL)]).cast("int") for c in factors]
    return _shingle_rows(lines, "h1", "h2").groupBy("h1", "h2").agg(F.sum("__first").alias("n"), *[F.min(x).alias(f"m{j}") for j, x in enumerate(least)])


def _shingle_sets(lines: DataFrame, ids: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(h1, shingles)`` and ``(h1, n, w0..w15)`` of the lines in ``ids(h1)``: distinct shingle hashes, their number and a sketch.

    The sketch has a bit for each of 1,024 slots: whether an odd number of the line's shingles falls there.
    """
    ids = scratch.table(ids, "ids")
    wanted = F.broadcast(ids) if ids.count() <= FEW_IDS else ids.hint("merge")
    text = lines.select("h1", "line").join(wanted, "h1", "left_semi").groupBy("h1").agg(F.max("line").alias("line"))
    rows = _shingle_rows(text, "h1").select("h1", F.array(*[f"__s{u}" for u in range(_UNROLL)]).alias("part"))
    sets = scratch.table(rows.groupBy("h1").agg(F.array_distinct(F.flatten(F.collect_list("part"))).alias("shingles")), "shingles")
    one = sets.select("h1", F.explode("shingles").alias("s")).select("h1", F.expr("shiftrightunsigned(s, 6) & 15").alias("word"), F.expr("shiftleft(1L, s & 63)").alias("bit"))
    words = [F.bit_xor(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{j}") for j in range(WORDS)]
    return sets, scratch.table(one.groupBy("h1").agg(F.count("*").alias("n"), *words), "sketches")


def _side(sketch: DataFrame, side: str) -> DataFrame:
    return sketch.select(F.col("h1").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sketch.columns if c != "h1"])


def _differ() -> Column:
    """Slots whose parities differ."""
    differ = F.lit(0)
    for j in range(WORDS):
        differ = differ + F.bit_count(F.col(f"a_w{j}").bitwiseXOR(F.col(f"b_w{j}")))
    return differ


def _can_link() -> Column:
    """Bound on the similarity of the sets behind two sketches.

    Slots whose parities differ are at most as many as the shingles that only one of the lines has, and these are at most
    (1 - t) / (1 + t) of both sizes together if the similarity is t or more: no similar pair is lost.
    """
    return _differ() <= (1 - THRESHOLD) / (1 + THRESHOLD) * (F.col("a_n") + F.col("b_n")) + 1e-6


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those of the distinct ``pairs(a, b, ...)`` whose shingle sets have the wanted similarity."""
    ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct(), f"{name}-ids")
    if ids.count() <= FEW_IDS:
        sets = sets.join(F.broadcast(ids), "h1", "left_semi")
    a = sets.select(F.col("h1").alias("a"), F.col("shingles").alias("__a"))
    b = sets.select(F.col("h1").alias("b"), F.col("shingles").alias("__b"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    both = both.select(*pairs.columns, F.size("__a").alias("na"), F.size("__b").alias("nb"), F.size(F.array_intersect("__a", "__b")).alias("shared"))
    # Written before the filter, which would be pushed into the join and intersect the sets once more.
    both = scratch.table(both, f"{name}-shared")
    return both.where(F.col("shared") >= THRESHOLD * (F.col("na") + F.col("nb") - F.col("shared"))).select(*pairs.columns)


def _star(members: DataFrame, sketch: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links between the ``members(h1, low, high)`` of a bucket and the first and the last of them."""
    star = members.select(F.col("h1").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
    star = scratch.table(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    fits = star.join(_side(sketch, "a").hint("merge"), "a").join(_side(sketch, "b").hint("merge"), "b").where(_can_link()).select("a", "b")
    return _verified(scratch.table(fits, f"{name}-fits"), sets, scratch, name)


def _open(placed: DataFrame) -> DataFrame:
    """``(key, k)`` of the buckets whose ``k`` members aren't one component yet."""
    return placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("k")).where("x <> y").select("key", "k")


def _nearest(placed: DataFrame, sketch: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links, as names of components, of each member with the most similar sketch among ``_REPS`` members of its buckets.

    The representatives are chosen by a hash of ``name``, so that each row meets a bounded number of others.
    """
    rows = placed.join(_open(placed).hint("merge"), "key", "left_semi").select("key", "h1", "c").join(sketch.hint("merge"), "h1")
    rows = scratch.table(rows, f"{name}-open")
    order = Window.partitionBy("key").orderBy(F.xxhash64("h1", F.lit(name)), "h1")
    reps = scratch.table(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= _REPS).drop("rank"), f"{name}-reps")
    near = _side(rows, "a").join(_side(reps, "b").hint("merge"), (F.col("a_key") == F.col("b_key")) & (F.col("a_c") != F.col("b_c")) & _can_link())
    to = F.struct("b", F.col("a_c").alias("ca"), F.col("b_c").alias("cb"))
    best = near.groupBy("a").agg(F.min_by(to, F.struct(_differ() / (F.col("a_n") + F.col("b_n")), "b")).alias("to")).select("a", "to.*")
    return _verified(scratch.table(best, name), sets, scratch, name).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _across(placed: DataFrame, sketch: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links ``(a, b)`` between components, as their names, of a bucket in ``placed(key, h1, low, high, c)``.

    The first and the last member have been compared with all others. The rest of a bucket that is not one component yet is
    cut into chunks by hash, and each pair of chunks is a group of its own, so that no bucket is one task's work.
    """
    open_ = scratch.table(_open(placed).select("key", F.ceil(F.col("k") / _CHUNK).cast("int").alias("chunks")), f"{name}-buckets")
    rows = placed.where("h1 <> low and h1 <> high").join(open_.hint("merge"), "key").withColumn("own", F.pmod(F.hash("h1"), F.col("chunks")))
    rows = scratch.table(rows.select("key", "h1", "c", "chunks", "own").join(sketch.hint("merge"), "h1"), f"{name}-open")
    left = rows.withColumn("y", F.explode(F.sequence(F.col("own"), F.col("chunks") - 1))).withColumnRenamed("own", "x")
    right = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumnRenamed("own", "y")
    left, right = _side(left.drop("chunks"), "a"), _side(right.drop("chunks"), "b")
    same = (F.col("a_key") == F.col("b_key")) & (F.col("a_x") == F.col("b_x")) & (F.col("a_y") == F.col("b_y"))
    once = (F.col("a_x") < F.col("a_y")) | (F.col("a") < F.col("b"))
    cross = left.join(right.hint("merge"), same & once & (F.col("a_c") != F.col("b_c")) & _can_link())
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("a_c", "b_c").alias("ca"), F.greatest("a_c", "b_c").alias("cb"))
    return _verified(scratch.table(cross.distinct(), name), sets, scratch, name).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _placed(members: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``members`` with ``c``, the component of each so far."""
    # Up to three members of a bucket have all been compared; to few, representatives would be no less work than the comparison of all.
    at = members.where(F.col("k") > (_FEW if name.startswith("near") else 3)).join(found.withColumnRenamed("node", "h1").hint("merge"), "h1", "left")
    return scratch.table(at.select("key", "h1", "low", "high", F.coalesce("root", "h1").alias("c")), name)


def _merged(found: DataFrame, joined: DataFrame) -> DataFrame:
    """Components ``found`` after ``joined`` has joined some of them, or of the members that had none."""
    every = found.unionByName(joined.select("node", F.col("node").alias("root"))).distinct()
    top = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return every.join(top.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def line_links(lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(signatures, components)`` of ``lines(h1, h2, line)``; the second holds linked lines only: ``(node, root)``."""
    sig = scratch.table(signatures(lines), "signatures")
    key = [F.xxhash64(F.lit(k), *[f"m{j}" for j in band]) for k, band in enumerate(BANDS)]
    bands = sig.select("h1", F.explode(F.array(*key)).alias("key"))
    return sig, linked(bands, lambda ids: _shingle_sets(lines, ids, scratch), scratch)


def linked(bands: DataFrame, sets_of: Callable[[DataFrame], tuple[DataFrame, DataFrame]], scratch: Scratch) -> DataFrame:
    """Components ``(node, root)`` of what shares a key in ``bands(h1, key)`` and has the wanted similarity.

    ``sets_of`` gives the shingle sets and the sketches of the wanted ``h1``.
    All members of a band's bucket are first compared with its first and its last one; then those of a bucket of many that is not
    one component yet are linked with the nearest of some representatives, in two rounds. At last, members of a bucket that are
    still in different components are compared with each other, so that no link is lost and a large family is joined without
    listing its pairs. Before shingle sets are fetched, pairs are held against the bound of their sketches inside the join.
    """
    ends = bands.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("k")).where("low <> high")
    ends = scratch.table(ends, "buckets")
    # A hash join: sorting all rows of all bands would cost more than the table of the buckets that have two lines or more.
    members = scratch.table(bands.join(ends.hint("shuffle_hash"), "key"), "members")
    sets, sketch = sets_of(members.select("h1").distinct())
    found = scratch.table(components(_star(members, sketch, sets, scratch, "star"), scratch, "star-cc"), "star-found")
    for name, step in (("near-1", _nearest), ("near-2", _nearest), ("cross", _across)):
        placed = _placed(members, found, scratch, f"{name}-placed")
        joined = scratch.table(components(step(placed, sketch, sets, scratch, name), scratch, f"{name}-cc"), f"{name}-joined")
        found = scratch.table(_merged(found, joined), f"{name}-found")
        for done in ("placed", "open", "reps", "shared"):
            scratch.drop(f"{name}-{done}")
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the lines that repeat, exactly or nearly, an earlier line of the corpus.

    Adds ``n_lines`` (lines before), ``n_dropped`` and replaces the text; all other columns stay as they are, and columns of
    the two names are replaced. Lines are split at ``\\n`` and compared without outer blanks; near means a Jaccard similarity of
    0.8 or more over 12-character shingles. The line kept of a component is its first by id, text hash and position.
    Defined cases: a null text stays null; blank lines always stay; a document all of whose lines go keeps its row with an
    empty text; rows with equal id and text are one document and lose the same lines; a null id sorts first; ids may be of
    any type that has an order. Two lines that differ share a 64-bit hash with a chance of n**2 / 2**65.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    every = base.select("id", "th", F.posexplode(F.split("t", "\n")).alias("pos", "raw"))
    every = every.select("id", "th", "pos", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line"))
    filled = every.where("line <> ''").select("id", "th", "pos", "line", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))
    # Three steps read the lines; the last one needs their hashes only.
    filled = scratch.table(filled, "filled")
    sig, found = line_links(filled.select("h1", "h2", "line"), scratch)
    classes = sig.select("h1", "h2", "n").join(found.select(F.col("node").alias("h1"), "root").hint("merge"), "h1", "left")
    classes = classes.where("n > 1 or root is not null").select("h1", "h2", "n", F.when(F.col("root").isNull(), F.xxhash64("h1", "h2")).otherwise(F.xxhash64("root")).alias("c"))
    placed = scratch.table(_occurrences(filled.drop("line"), scratch.table(classes, "classes"), scratch), "occurrences")
    scratch.drop("filled")
    first = placed.groupBy("c").agg(F.min(F.struct("id", "th", "pos")).alias("at")).select("at.*")
    # A document's lines that have a class, less those that are the first of theirs.
    both = placed.select("id", "th", F.col("pos").alias("seen"), F.lit(None).cast("int").alias("first")).unionByName(first.select("id", "th", F.lit(None).cast("int").alias("seen"), F.col("pos").alias("first")))
    gone = both.groupBy("id", "th").agg(F.array_except(F.collect_set("seen"), F.collect_set("first")).alias("gone"))
    gone = scratch.table(gone.where("size(gone) > 0"), "gone").select(F.col("id").alias("gid"), F.col("th").alias("gth"), "gone")
    # The row is one column, so that no name of the caller's meets one of ours.
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    out = out.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    # The split text is used several times below, so that Spark keeps it as a column of its own.
    out = out.withColumn("t", F.col(f"row.`{text_col}`")).withColumn("parts", F.split("t", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    n_lines = F.when(F.col("t").isNotNull(), F.size("parts")).alias("n_lines")
    kept = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*kept, n_lines, F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))


def _occurrences(filled: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, th, pos, c)`` of the lines in ``classes(h1, h2, n, c)``.

    Lines with more than 1 / ``_FREQUENT`` of all occurrences are less than ``_FREQUENT`` by that bound: they are broadcast to tell
    their occurrences, which are dealt over salts, so that no key of the join is hot.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    frequent = classes.where(F.col("n") > max(1000, total // _FREQUENT))
    mark = F.broadcast(frequent.select(F.col("h1").alias("f1"), F.col("h2").alias("f2")))
    rows = filled.join(mark, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    rows = rows.select("id", "th", "pos", "h1", "h2", F.when(F.col("f1").isNull(), 0).otherwise(F.pmod(F.hash("th", "pos"), F.lit(64))).alias("salt"))
    salts = F.when(F.col("n") > max(1000, total // _FREQUENT), 64).otherwise(1)
    dealt = classes.select("h1", "h2", "c", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return rows.join(dealt.hint("merge"), ["h1", "h2", "salt"]).select("id", "th", "pos", "c")
