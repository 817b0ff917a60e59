"""Narration segments, their clips and matching scenes: order, voice time, repetition, roles and top candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .cues import fold_groups

# Connectives that open a narration sentence, and those that only say that time goes on.
OPENERS = (
    "ngay\\s+sau\\s+đó|sau\\s+đó|tiếp\\s+đó|tiếp\\s+theo|kế\\s+tiếp|kế\\s+đó|"
    "rồi|lúc\\s+này|ngay\\s+lúc\\s+ấy|đúng\\s+lúc\\s+ấy|cùng\\s+lúc(?:\\s+ấy)?|"
    "trong\\s+khi(?:\\s+ấy|\\s+đó)?|ở\\s+nơi\\s+khác|ở\\s+phía\\s+bên\\s+kia|"
    "thế\\s+nhưng|tuy\\s+nhiên|vì\\s+vậy|bởi\\s+vậy|do\\s+đó|cuối\\s+cùng"
)
GENERIC = ("ngay sau đó", "sau đó", "tiếp đó", "tiếp theo", "kế tiếp", "kế đó", "rồi")


def _w(*order: str | Column) -> Window:
    return Window.partitionBy("video_id").orderBy(*order)


def _all() -> Window:
    return Window.partitionBy("video_id")


def leading_marker(c: str | Column, openers: str = OPENERS) -> Column:
    """The opening connective of a sentence in lower case with single blanks, or the empty text."""
    col = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract(col, "(?iU)^\\s*[\"'“”‘’(\\[]*\\s*(" + openers + ")\\b", 1)
    return F.regexp_replace(F.lower(found), "\\s+", " ")


def marker_repetition(segments: DataFrame, openers: str = OPENERS) -> DataFrame:
    """``(video_id, marker, n, n_segments)`` of markers that open more than max(2, a tenth) of a video's segments.

    Videos with fewer than four segments pass.
    """
    d = segments.select("video_id", leading_marker("narration", openers).alias("marker"))
    counts = d.groupBy("video_id", "marker").agg(F.count("*").alias("n"))
    counts = counts.withColumn("n_segments", F.sum("n").over(_all()))
    return counts.where((F.col("marker") != "") & (F.col("n_segments") >= 4) & (F.col("n") > F.greatest(F.lit(2), F.floor(F.col("n_segments") * F.lit(0.10)))))


def marker_runs(segments: DataFrame, openers: str = OPENERS, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` segments in a row with the same opening marker: ``(video_id, marker, first_seq, n)``."""
    d = segments.select("video_id", "seq", leading_marker("narration", openers).alias("marker"))
    new = (F.col("marker") != F.coalesce(F.lag("marker").over(_w("seq")), F.lit("\x00"))).cast("int")
    d = d.withColumn("new", new).withColumn("run", F.sum("new").over(_w("seq")))
    g = d.where("marker <> ''").groupBy("video_id", "run", "marker").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least).drop("run")


def strip_markers(segments: DataFrame, openers: str = OPENERS, generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """Narrations without a generic opening marker where the segment before tells the same event; the rest is capitalised."""
    same = F.col("event_no") == F.lag("event_no").over(_w("seq"))
    rest = F.regexp_replace("narration", "(?iU)^\\s*[\"'“”‘’(\\[]*\\s*(?:" + openers + ")\\b[\\s,;:–—-]*", "")
    capital = F.concat(F.upper(F.left(rest, F.lit(1))), F.substring(rest, 2, 1 << 30))
    strip = F.coalesce(same, F.lit(False)) & leading_marker("narration", openers).isin(*generic) & (F.trim(rest) != "")
    return segments.withColumn("stripped", strip).withColumn("narration", F.when(strip, capital).otherwise(F.col("narration")))


def chronology(decisions: DataFrame, slack_ms: int = 250) -> DataFrame:
    """Backward steps of each decision: in event order, and in source time against the row before and the running latest."""
    w = _w("seq")
    back = F.col("start_ms") < F.lag("start_ms").over(w) - slack_ms
    behind = F.col("start_ms") < F.max("start_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)) - slack_ms
    event = F.col("event_no") < F.lag("event_no").over(w)
    no = F.lit(False)
    return decisions.select("video_id", "seq", F.coalesce(event, no).alias("event_back"), F.coalesce(back, no).alias("time_back"), F.coalesce(behind, no).alias("behind_latest"))


def repeats_previous(segments: DataFrame, least: float = 0.45) -> DataFrame:
    """Segments that say again what the one before said: same event, the same single scene, the same single action, and a token
    overlap of at least ``least``.

    ``scene_ids`` and ``actions`` are arrays. Actions are compared in lower case and without doubled blanks.
    """
    d = segments.withColumn("__t", T.tokens("narration")).withColumn("__p", F.lag(F.struct("event_no", "__t", "scene_ids", "actions")).over(_w("seq"))).where("__p is not null")
    share = T.shared_tokens(F.col("__t"), F.col("__p.__t"))
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    action = lambda c: F.nullif(F.btrim(F.regexp_replace(F.lower(only(F.col(c))), r"\s+", " ")), F.lit(""))
    same = (F.col("event_no") == F.col("__p.event_no")) & (only(F.col("scene_ids")) == only(F.col("__p.scene_ids"))) & (action("actions") == action("__p.actions"))
    return d.select("video_id", "seq", share.alias("overlap"), F.coalesce(same & (share >= least), F.lit(False)).alias("repeats"))


def allocate_voice(decisions: DataFrame, durations: DataFrame) -> DataFrame:
    """Voice ranges by weight: ends are the running share of the measured duration, rounded to the millisecond; the last ends
    exactly there and each starts where the one before ends."""
    d = decisions.join(durations.hint("merge"), "video_id")
    run, total = F.sum("weight").over(_w("seq").rowsBetween(Window.unboundedPreceding, 0)), F.sum("weight").over(_all())
    d = d.withColumn("voice_end_ms", F.floor(run * F.col("duration_ms") / total + F.lit(0.5)).cast("long"))
    return d.withColumn("voice_start_ms", F.coalesce(F.lag("voice_end_ms").over(_w("seq")), F.lit(0)))


def resequence(decisions: DataFrame, order: DataFrame) -> DataFrame:
    """Voice ranges after a reorder ``(video_id, seq, new_seq)``: lengths of at least 0.01 s are laid end to end."""
    d = decisions.join(order.hint("merge"), ["video_id", "seq"]).withColumn("len", F.greatest(F.lit(10), F.col("end_ms") - F.col("start_ms")))
    end = F.sum("len").over(_w("new_seq").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("voice_end_ms", end).withColumn("voice_start_ms", end - F.col("len"))


def reorder_in_event(decisions: DataFrame) -> DataFrame:
    """``(video_id, seq, new_seq)``: runs of one event are sorted by source time if all their rows have one."""
    new = (F.col("event_no") != F.coalesce(F.lag("event_no").over(_w("seq")), F.lit(-1))).cast("int")
    d = decisions.withColumn("__new", new).withColumn("__run", F.sum("__new").over(_w("seq")))
    run = Window.partitionBy("video_id", "__run")
    known = F.count("source_ms").over(run) == F.count("*").over(run)
    key = F.when(known, F.col("source_ms")).otherwise(F.lit(0))
    return d.withColumn("__key", key).withColumn("new_seq", F.row_number().over(_w("__run", "__key", "seq")).cast("long")).select("video_id", "seq", "new_seq")


def story_roles(events: DataFrame) -> DataFrame:
    """Roles of the verified events, or of all if none is: hook, context, conflict, climax, resolution by progress."""
    d = events.withColumn("__any", F.max(F.col("verified").cast("int")).over(_all())).where("verified or __any = 0")
    p = F.percent_rank().over(_w("order_index", "start_ms", "event_no"))
    i, n = F.row_number().over(_w("order_index", "start_ms", "event_no")), F.count("*").over(_all())
    role = F.when(i == 1, "hook").when(i == n, "resolution").when(p <= 0.25, "context").when(p <= 0.65, "conflict").when(p <= 0.85, "climax").otherwise("resolution")
    return d.select("video_id", "event_no", role.alias("role"))


def quantize(plan: DataFrame, fps: int) -> DataFrame:
    """Frame boundaries without drift: each at least one after the one before, else the rounded running time.

    ``plan(video_id, seq, length_ms, target_ms)``; the last boundary is the target's last frame, or the number of rows if that is more.
    Without a target it is like the others. The guard is a running maximum of frame less row: no fold is needed.
    """
    w = _w("seq").rowsBetween(Window.unboundedPreceding, 0)
    i = F.row_number().over(_w("seq"))
    frame = F.bround(F.sum("length_ms").over(w) * F.lit(fps) / F.lit(1000), 0).cast("long")
    d = plan.withColumn("__i", i).withColumn("__d", frame - F.col("__i"))
    end = F.col("__i") + F.greatest(F.lit(0), F.max("__d").over(w))
    if "target_ms" in plan.columns:
        final = F.greatest(F.col("__i").cast("long"), F.ceil(F.greatest(F.col("target_ms"), F.lit(0)) * F.lit(fps) / F.lit(1000)))
        end = F.when(F.lead(F.lit(1)).over(_w("seq")).isNull(), final).otherwise(end)
    return d.withColumn("frame_end", end.cast("long")).drop("__i", "__d")


def partition_repeats(plan: DataFrame) -> DataFrame:
    """Runs of source windows whose start and length are within 50 ms of the run's first, cut into equal slices of that first one.

    A run of one keeps its window. Where a run ends depends on its first row, so that runs are numbered by a fold.
    """
    zero = F.struct(F.lit(0).alias("g"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length"))

    def step(s: Column, r: Column) -> Column:
        length = r["end_ms"] - r["start_ms"]
        new = s["start"].isNull() | (F.abs(r["start_ms"] - s["start"]) > 50) | (F.abs(length - s["length"]) > 50)
        return F.struct((s["g"] + new.cast("int")).alias("g"), F.when(new, r["start_ms"]).otherwise(s["start"]).alias("start"), F.when(new, length).otherwise(s["length"]).alias("length"))

    d = fold_groups(plan, ["seq"], ["start_ms", "end_ms"], zero, step, "__run")
    run = Window.partitionBy("video_id", "__run")
    i, n = F.row_number().over(run.orderBy("seq")) - 1, F.count("*").over(run)
    first = F.first(F.struct("start_ms", "end_ms")).over(run.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = d.withColumn("__i", i).withColumn("__n", n).withColumn("__f", first)
    cut = lambda k: (F.col("__f.start_ms") + F.floor((F.col("__f.end_ms") - F.col("__f.start_ms")) * k / F.col("__n"))).cast("long")
    return d.withColumn("slice_start_ms", cut(F.col("__i"))).withColumn("slice_end_ms", cut(F.col("__i") + 1)).drop("__run", "__i", "__n", "__f")


def top_candidates(candidates: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best candidates of each segment with their rank; ties by id."""
    w = Window.partitionBy("video_id", "seq").orderBy(F.desc("score"), "candidate_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidate_pool(candidates: DataFrame) -> DataFrame:
    """The best score of each candidate of a video; of equal ones the earliest position."""
    best = F.max_by(F.struct("score", "pos"), F.struct(F.col("score"), -F.col("pos")))
    return candidates.groupBy("video_id", "candidate_id").agg(best.alias("x")).select("video_id", "candidate_id", "x.score", "x.pos")


def smooth_boxes(detections: DataFrame, back: int = 6) -> DataFrame:
    """Rolling median of x, y, w, h over the last detections, widened to include the current box."""
    w = _w("frame").rowsBetween(-back, 0)
    med = {c: F.percentile(c, F.lit(0.5)).over(w) for c in ("x", "y", "w", "h")}
    d = detections
    for c, m in med.items():
        d = d.withColumn(f"m{c}", m)
    lo_x, lo_y = F.least("mx", "x"), F.least("my", "y")
    hi_x, hi_y = F.greatest(F.col("mx") + F.col("mw"), F.col("x") + F.col("w")), F.greatest(F.col("my") + F.col("mh"), F.col("y") + F.col("h"))
    return d.select("video_id", "frame", lo_x.alias("x"), lo_y.alias("y"), (hi_x - lo_x).alias("w"), (hi_y - lo_y).alias("h"))


def overlapping_regions(regions: DataFrame, least: float, cell: float = 25.0) -> DataFrame:
    """Pairs of regions of a video whose intersection is more than ``least`` of the smaller area, by a grid of cells.

    A pair is kept only in the first cell that both touch, so that it appears once. With columns ``start_ms`` and ``end_ms``, regions that both
    have a time range must share more than its edge; one without a range is seen all the time.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(a) + F.col(b)) / cell))
    d = regions.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    a, b = d, d.select(*[F.col(c).alias(f"r_{c}") for c in d.columns])
    ix = F.least(F.col("x") + F.col("w"), F.col("r_x") + F.col("r_w")) - F.greatest("x", "r_x")
    iy = F.least(F.col("y") + F.col("h"), F.col("r_y") + F.col("r_h")) - F.greatest("y", "r_y")
    first = (F.col("cx") == F.floor(F.greatest("x", "r_x") / cell)) & (F.col("cy") == F.floor(F.greatest("y", "r_y") / cell))
    share = ix * iy / F.greatest(F.lit(1.0), F.least(F.col("w") * F.col("h"), F.col("r_w") * F.col("r_h")))
    on = (F.col("video_id") == F.col("r_video_id")) & (F.col("cx") == F.col("r_cx")) & (F.col("cy") == F.col("r_cy")) & (F.col("region_id") < F.col("r_region_id"))
    if {"start_ms", "end_ms"} <= set(regions.columns):
        timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & F.col("r_start_ms").isNotNull() & F.col("r_end_ms").isNotNull()
        on = on & (~timed | (F.greatest("start_ms", "r_start_ms") < F.least("end_ms", "r_end_ms")))
    out = a.join(b.hint("merge"), on & first & (ix > 0) & (iy > 0))
    return out.withColumn("share", share).where(F.col("share") > least).select("video_id", "region_id", "r_region_id", "share")
