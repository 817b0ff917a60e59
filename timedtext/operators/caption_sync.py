"""How well captions follow a narration: text, bounds and offsets, by word times where they fit and by voice ranges elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.blocks import matching_ratio
from ..functions.scores import clamp
from .matching import _word_spans, match_by_tokens
from .texts import caption_offsets


def _key(rows: DataFrame, order: str, text: str, out: str) -> DataFrame:
    """``(video_id, out)``: letters and digits of a video's texts in order, as one string."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, T.alignment_key(text).alias("k")))), lambda x: x["k"]), "")
    return rows.groupBy("video_id").agg(joined.alias(out))


def _summary(offsets: DataFrame, score: Column, source: str) -> DataFrame:
    g = offsets.groupBy("video_id").agg(F.avg("offset").alias("mean_offset"), F.max("offset").alias("max_offset"), F.avg("share").alias("share"))
    return g.select("video_id", F.col("mean_offset").cast("double"), F.col("max_offset").cast("double"), score.alias("range_score"), F.lit(source).alias("source"))


def caption_sync(captions: DataFrame, words: DataFrame, ranges: DataFrame, durations: DataFrame) -> DataFrame:
    """``(video_id, n_cues, text_match, sync_score, mean_offset, max_offset, n_out_of_bounds, coverage, source)``, offsets in seconds.

    ``captions(video_id, cue_no, start_ms, end_ms, text)``, ``words(video_id, word_no, word, start_ms, end_ms)``, ``ranges(video_id, seq, narration, start_ms, end_ms)`` with the narration and
    its voice times, ``durations(video_id, duration_ms)``. Where the letters of the captions are those of the words, each cue is held against its first word
    less 0.08 s and its last word plus 0.18 s; a mean of 0.12 s and a maximum of 0.30 s are free. Elsewhere each cue is held against the
    range whose narration shares most of its words. The score is 0.72 of the offsets', 0.20 of the texts' matching blocks and 0.08 of
    the cues within bounds. Defined cases: a video of ``durations`` without captions has zeros and the source ``missing``; without a
    narration nothing matches; a null or zero duration bounds nothing; videos without a row in ``durations`` are left out. The
    captions of one video must fit a row, as their text is compared as a whole; a film has some 60,000 letters.
    """
    d = captions.where(F.trim("text") != "").join(durations.select("video_id", F.coalesce("duration_ms", F.lit(0)).alias("dur")).hint("merge"), "video_id")
    bad = (F.col("start_ms") < -10) | (F.col("end_ms") <= F.col("start_ms")) | ((F.col("dur") > 0) & (F.col("end_ms") > F.col("dur") + 150))
    base = d.groupBy("video_id").agg(
        F.count("*").alias("n_cues"),
        F.sum(bad.cast("long")).alias("n_out_of_bounds"),
        (100.0 * F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))) / F.greatest(F.max("dur"), F.max("end_ms"), F.lit(10))).alias("seen"),
    )
    spans = _word_spans(d.select("video_id", F.col("cue_no").alias("text_no"), "text"), words).withColumnRenamed("text_no", "cue_no")
    timed = d.join(spans.hint("merge"), ["video_id", "cue_no"])
    until = F.when(F.col("dur") > 0, F.least("dur", F.col("w1") + 180)).otherwise(F.col("w1") + 180)
    gap = lambda a, b: F.abs(a - b) / 1000.0
    both = F.explode(F.array(gap(F.col("start_ms"), F.greatest(F.lit(0), F.col("w0") - 80)), gap(F.col("end_ms"), until)))
    free = lambda c, n, w: F.greatest(F.lit(0.0), F.col(c) - n) * w
    by_words = _summary(timed.select("video_id", both.alias("offset"), F.lit(0.0).alias("share")), clamp(100 - free("mean_offset", 0.12, 85.0) - free("max_offset", 0.30, 20.0)), "word_timings")
    rest = d.join(spans.select("video_id").distinct().hint("merge"), "video_id", "left_anti")
    voiced = caption_offsets(rest, ranges, match_by_tokens(rest, ranges))
    by_range = _summary(voiced.select("video_id", (F.col("offset_ms") / 1000.0).alias("offset"), F.col("score").alias("share")), 100 * F.col("share"), "voice_ranges")
    keys = _key(d, "cue_no", "text", "said").join(_key(ranges, "seq", "narration", "told").hint("merge"), "video_id", "left")
    match = F.when((F.col("said") != "") & (F.coalesce("told", F.lit("")) != ""), 100 * matching_ratio("said", "told")).otherwise(0.0)
    out = base.join(by_words.unionByName(by_range).hint("merge"), "video_id").join(keys.select("video_id", match.alias("text_match")).hint("merge"), "video_id")
    bounds = 100.0 * (1 - F.col("n_out_of_bounds") / F.col("n_cues"))
    out = out.withColumn("sync_score", clamp(F.col("range_score") * 0.72 + F.col("text_match") * 0.20 + bounds * 0.08)).withColumn("coverage", F.least(F.lit(100.0), F.col("seen")))
    every = durations.select("video_id").distinct().join(out.hint("merge"), "video_id", "left")
    two = lambda c, n=2: F.bround(F.coalesce(c, F.lit(0.0)), n).alias(c)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select("video_id", none("n_cues"), two("text_match"), two("sync_score"), F.bround("mean_offset", 3).alias("mean_offset"), F.bround("max_offset", 3).alias("max_offset"), none("n_out_of_bounds"), two("coverage"), F.coalesce("source", F.lit("missing")).alias("source"))
