"""Interval operators: joins by overlap and distance, islands, unions and intersections, all keyed by ``video_id``.

Times are whole milliseconds. Overlap joins explode both sides into time buckets and equi-join on video and bucket; a pair is
kept only in the first bucket both sides share, so that it appears once without a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp

BUCKET_MS = 30_000


def _bucketed(df: DataFrame, start: str, end: str, bucket_ms: int) -> DataFrame:
    first, last = F.floor(F.col(start) / bucket_ms), F.floor(F.greatest(start, end) / bucket_ms)
    return df.withColumn("__first", first).withColumn("__bucket", F.explode(F.sequence(first, last)))


def range_join(left: DataFrame, right: DataFrame, on: Column | None = None, bucket_ms: int = BUCKET_MS, how: str = "inner") -> DataFrame:
    """Pairs of one video whose closed ranges ``start_ms..end_ms`` meet; right columns get the prefix ``r_``.

    The bucket should be about a high percentile of the range lengths; longer ranges are listed in several buckets. The
    join is a shuffle join by hint, since Spark cannot estimate exploded sides.
    """
    a = _bucketed(left, "start_ms", "end_ms", bucket_ms)
    b = _bucketed(right, "start_ms", "end_ms", bucket_ms)
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns])
    meets = (F.col("video_id") == F.col("r_video_id")) & (F.col("__bucket") == F.col("r___bucket"))
    meets = meets & (F.col("__bucket") == F.greatest("__first", "r___first")) & (F.col("start_ms") <= F.col("r_end_ms")) & (F.col("r_start_ms") <= F.col("end_ms"))
    out = a.join(b.hint("merge"), meets if on is None else meets & on)
    return out.drop("__first", "__bucket", "r___first", "r___bucket")


def overlap_ms() -> Column:
    return F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")


def overlap_join(left: DataFrame, right: DataFrame, min_overlap_ms: int = 10, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs that overlap by more than ``min_overlap_ms``, with ``overlap_ms``."""
    return range_join(left, right, bucket_ms=bucket_ms).withColumn("overlap_ms", overlap_ms()).where(F.col("overlap_ms") > min_overlap_ms)


def attach_text(scenes: DataFrame, cues: DataFrame, most: int = 900, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``(video_id, scene_no, dialogue)``: texts of the cues that touch a scene, ends included, in order, cut to ``most``."""
    pairs = range_join(scenes.select("video_id", "scene_no", "start_ms", "end_ms"), cues.select("video_id", "cue_no", "start_ms", "end_ms", "text"), bucket_ms=bucket_ms)
    rows = F.array_sort(F.collect_list(F.struct("r_cue_no", "r_text")))
    joined = pairs.groupBy("video_id", "scene_no").agg(F.left(F.array_join(F.transform(rows, lambda x: x["r_text"]), " "), F.lit(most)).alias("dialogue"))
    return scenes.select("video_id", "scene_no").join(joined.hint("merge"), ["video_id", "scene_no"], "left").withColumn("dialogue", F.coalesce("dialogue", F.lit("")))


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row of its video with the nearest midpoint; of equally near ones the lowest id.

    Both sides are put on one line and the last right row before and the first after each left row are carried over by
    windows: one sort per video, no pairs.
    """
    mid = (F.col("start_ms") + F.col("end_ms")).alias("m2")
    right = right.groupBy("video_id", mid).agg(F.min(right_id).alias("rid"))
    both = left.select("video_id", mid, F.col(left_id).alias("lid"), F.lit(None).cast(right.schema["rid"].dataType).alias("rid"), F.lit(1).alias("side"))
    both = both.unionByName(right.select("video_id", "m2", F.lit(None).cast(left.schema[left_id].dataType).alias("lid"), "rid", F.lit(0).alias("side")))
    w = Window.partitionBy("video_id").orderBy("m2", "side")
    back = Window.partitionBy("video_id").orderBy(F.desc("m2"), "side")
    hit = F.when(F.col("side") == 0, F.struct("m2", "rid"))
    both = both.withColumn("p", F.last(hit, True).over(w)).withColumn("n", F.last(hit, True).over(back)).where("side = 1")
    dp, dn = F.abs(F.col("m2") - F.col("p.m2")), F.abs(F.col("n.m2") - F.col("m2"))
    take_p = F.col("n").isNull() | (dp < dn) | ((dp == dn) & (F.col("p.rid") <= F.col("n.rid")))
    out = both.select("video_id", F.col("lid").alias(left_id), F.when(take_p, F.col("p.rid")).otherwise(F.col("n.rid")).alias(f"r_{right_id}"), F.when(take_p, dp).otherwise(dn).alias("distance2_ms"))
    return out.where(F.col(f"r_{right_id}").isNotNull())


def align_tracks(source: DataFrame, target: DataFrame, min_overlap_ms: int = 10, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``(video_id, source_no, target_no, kind)``: overlaps, else the nearest target, and then the targets never used."""
    s, t = source.select("video_id", "cue_no", "start_ms", "end_ms"), target.select("video_id", "cue_no", "start_ms", "end_ms")
    hits = overlap_join(s, t, min_overlap_ms, bucket_ms).select("video_id", F.col("cue_no").alias("source_no"), F.col("r_cue_no").alias("target_no"), F.lit("overlap").alias("kind"))
    lone = s.join(hits.select("video_id", F.col("source_no").alias("cue_no")).distinct().hint("merge"), ["video_id", "cue_no"], "left_anti")
    near = nearest_join(lone, t, "cue_no", "cue_no").select("video_id", F.col("cue_no").alias("source_no"), F.col("r_cue_no").alias("target_no"), F.lit("nearest").alias("kind"))
    used = hits.unionByName(near)
    rest = t.join(used.select("video_id", F.col("target_no").alias("cue_no")).distinct().hint("merge"), ["video_id", "cue_no"], "left_anti")
    no = F.lit(None).cast(source.schema["cue_no"].dataType)
    rest = rest.select("video_id", no.alias("source_no"), F.col("cue_no").alias("target_no"), F.lit("unmatched").alias("kind"))
    none = s.join(used.select("video_id", F.col("source_no").alias("cue_no")).distinct().hint("merge"), ["video_id", "cue_no"], "left_anti")
    none = none.select("video_id", F.col("cue_no").alias("source_no"), no.alias("target_no"), F.lit("unmatched").alias("kind"))
    return used.unionByName(rest).unionByName(none)


def islands(df: DataFrame, *keys: str) -> DataFrame:
    """Merged ranges per key: touching and overlapping ranges become one; empty ranges are left out."""
    keys = keys or ("video_id",)
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    d = df.where("end_ms > start_ms").select(*keys, "start_ms", "end_ms")
    d = d.withColumn("__new", (F.col("start_ms") > F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    d = d.withColumn("__run", F.sum(F.coalesce("__new", F.lit(0))).over(w))
    return d.groupBy(*keys, "__run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("__run")


def union_duration(df: DataFrame) -> DataFrame:
    return islands(df).groupBy("video_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("union_ms"))


def intersection_duration(a: DataFrame, b: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Length of the time that both sets of ranges cover; islands are disjoint, so that overlaps of islands add up."""
    pairs = range_join(islands(a), islands(b), bucket_ms=bucket_ms)
    return pairs.groupBy("video_id").agg(F.sum(overlap_ms()).alias("both_ms"))


def timeline_score(source: DataFrame, target: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """How well the target track follows the source track: ``(video_id, score, mean_offset_ms, source_ms, target_ms, both_ms)``.

    0.65 of the mean of both coverage shares and 0.35 of an offset score: 100 less 80 a second beyond 0.05 s of mean
    distance between the ends of a source cue and those of all that it matches. A video without one of the tracks scores 0.
    """
    pairs = align_tracks(source, target, bucket_ms=bucket_ms).where("source_no is not null and target_no is not null")
    s = source.select("video_id", F.col("cue_no").alias("source_no"), F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    t = target.select("video_id", F.col("cue_no").alias("target_no"), F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"))
    span = pairs.join(t.hint("merge"), ["video_id", "target_no"]).groupBy("video_id", "source_no").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    gap = F.abs(F.col("s0") - F.col("t0")) + F.abs(F.col("s1") - F.col("t1"))
    offset = span.join(s.hint("merge"), ["video_id", "source_no"]).groupBy("video_id").agg((F.sum(gap) / (2 * F.count("*"))).alias("mean_offset_ms"))
    sums = [union_duration(source).withColumnRenamed("union_ms", "source_ms"), union_duration(target).withColumnRenamed("union_ms", "target_ms"), intersection_duration(source, target, bucket_ms), offset]
    out = sums[0]
    for d in sums[1:]:
        out = out.join(d.hint("merge"), "video_id", "full")
    out = out.select("video_id", "mean_offset_ms", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("source_ms", "target_ms", "both_ms")])
    share = (F.col("both_ms") / F.greatest("source_ms", F.lit(1)) + F.col("both_ms") / F.greatest("target_ms", F.lit(1))) / 2 * 100
    late = clamp(100 - 80 * F.greatest(F.lit(0.0), F.col("mean_offset_ms") / 1000 - 0.05))
    score = F.when((F.col("source_ms") > 0) & (F.col("target_ms") > 0), clamp(0.65 * share + 0.35 * late)).otherwise(F.lit(0.0))
    return out.withColumn("score", score)


def index_runs(samples: DataFrame) -> DataFrame:
    """Runs of consecutive ``idx``: ``(video_id, first_idx, last_idx, n)``."""
    run = F.col("idx") - F.row_number().over(Window.partitionBy("video_id").orderBy("idx"))
    return samples.select("video_id", "idx").distinct().withColumn("run", run).groupBy("video_id", "run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n")).drop("run")


def sample_windows(samples: DataFrame, duration_ms: str = "duration_ms") -> DataFrame:
    """Validity of each sampled time: half-way to its neighbours, 0 and the duration at the ends."""
    w = Window.partitionBy("video_id").orderBy("at_ms", "idx")
    lo = F.coalesce(F.floor((F.lag("at_ms").over(w) + F.col("at_ms")) / 2), F.lit(0))
    hi = F.coalesce(F.floor((F.lead("at_ms").over(w) + F.col("at_ms")) / 2), F.col(duration_ms))
    return samples.withColumn("from_ms", lo).withColumn("to_ms", hi)


def audit_slots(slots: DataFrame, recorded: DataFrame, slack_ms: int = 80) -> DataFrame:
    """Recorded segments against expected slots: counts, overruns, unreadable ones (no duration), coverage and exact match."""
    a = slots.select("video_id", "idx", F.col("available_ms"), F.lit(1).alias("e"))
    b = recorded.select("video_id", "idx", F.col("duration_ms"), F.lit(1).alias("r"))
    j = a.join(b.hint("merge"), ["video_id", "idx"], "full")
    both = F.col("e").isNotNull() & F.col("r").isNotNull()
    over, mute = both & (F.col("duration_ms") > F.col("available_ms") + slack_ms), both & F.col("duration_ms").isNull()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = j.groupBy("video_id").agg(n(F.col("r").isNotNull()).alias("n_recorded"), n(F.col("e").isNotNull()).alias("n_expected"), n(over).alias("n_overrun"), n(mute).alias("n_unreadable"), n(both).alias("__both"))
    ok = F.col("__both") - F.col("n_overrun") - F.col("n_unreadable")
    share = F.when(F.col("n_expected") > 0, 100.0 * ok / F.col("n_expected")).otherwise(F.when(F.col("n_recorded") == 0, 100.0).otherwise(0.0))
    exact = (F.col("n_recorded") == F.col("n_expected")) & (ok == F.col("n_expected"))
    return out.withColumn("coverage", share).withColumn("matched", exact).drop("__both")
