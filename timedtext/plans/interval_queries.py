"""Queries over ranges: overlap, nearest match, unions, agreement of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import micro
from ..operators import intervals as I
from . import views as V

# Event spans last up to some hours; this is near their 90th percentile.
_BUCKET = 1_800_000
#: Event types that are the source track; all others are the target track.
_SOURCE = "('view', 'purchase')"


def _tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = V.spans(spark, d)
    return s.where(f"track IN {_SOURCE}"), s.where(f"track NOT IN {_SOURCE}")


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = _tracks(spark, d)
    return I.overlap_join(a, b, 10, _BUCKET).select("video_id", "cue_no", "r_cue_no", "overlap_ms")


def attach_dialogue(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    scenes = c.groupBy("video_id", F.floor(F.col("cue_no") / 3).alias("scene_no")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    out = I.attach_text(scenes, c)
    return out.select("video_id", "scene_no", F.md5("dialogue").alias("dialogue_md5"), F.length("dialogue").alias("n_chars"))


def nearest_cue(spark: SparkSession, d: str) -> DataFrame:
    a, b = _tracks(spark, d)
    return I.nearest_join(a, b, "cue_no", "cue_no")


def align_tracks(spark: SparkSession, d: str) -> DataFrame:
    a, b = _tracks(spark, d)
    return I.align_tracks(a, b, 10, _BUCKET)


def union_duration(spark: SparkSession, d: str) -> DataFrame:
    return I.union_duration(V.spans(spark, d))


def intersection_duration(spark: SparkSession, d: str) -> DataFrame:
    a, b = _tracks(spark, d)
    return I.intersection_duration(a, b, _BUCKET)


def timeline_score(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: how well the target track follows the source track."""
    a, b = _tracks(spark, d)
    out = I.timeline_score(a, b, _BUCKET)
    return out.select("video_id", "source_ms", "target_ms", "both_ms", micro("mean_offset_ms").alias("offset_micro"), micro("score").alias("score_micro"))


def index_runs(spark: SparkSession, d: str) -> DataFrame:
    return I.index_runs(V.spans(spark, d).select("video_id", F.floor(F.col("start_ms") / 86_400_000).alias("idx")))


def sample_windows(spark: SparkSession, d: str) -> DataFrame:
    s = V.spans(spark, d).select("video_id", F.col("cue_no").alias("idx"), F.col("start_ms").alias("at_ms"), F.lit(4_000_000_000_000).alias("duration_ms"))
    return I.sample_windows(s).select("video_id", "idx", "from_ms", "to_ms")


def audit_slots(spark: SparkSession, d: str) -> DataFrame:
    """Some slots and some recordings have a number of their own, so that either side misses them."""
    c = V.cues(spark, d)
    slots = c.select("video_id", F.expr("if(cue_no % 5 = 4, -2 * cue_no, cue_no)").alias("idx"), (F.col("end_ms") - F.col("start_ms")).alias("available_ms"))
    recorded = c.select("video_id", F.expr("if(cue_no % 4 = 3, -2 * cue_no - 1, cue_no)").alias("idx"), F.when(F.col("cue_no") % 6 == 5, F.lit(None)).otherwise(F.col("end_ms") - F.col("start_ms") + F.col("cue_no") * 40).alias("duration_ms"))
    out = I.audit_slots(slots, recorded)
    return out.select("video_id", "n_recorded", "n_expected", "n_overrun", "n_unreadable", micro("coverage").alias("coverage_micro"), "matched")


QUERIES = {f.__name__: f for f in (overlap_pairs, attach_dialogue, nearest_cue, align_tracks, union_duration, intersection_duration, timeline_score, index_runs, sample_windows, audit_slots)}

_AB = f"s AS ({V.SPANS_DUCK}), a AS (SELECT * FROM s WHERE track IN {_SOURCE}), b AS (SELECT * FROM s WHERE track NOT IN {_SOURCE})"
_PAIRS = """
o AS (SELECT a.video_id, a.cue_no AS source_no, b.cue_no AS target_no FROM a JOIN b ON a.video_id = b.video_id AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 10),
n AS (SELECT a.video_id, a.cue_no AS source_no, arg_min(b.cue_no, (abs(a.start_ms + a.end_ms - b.start_ms - b.end_ms), b.cue_no)) AS target_no
  FROM a JOIN b ON a.video_id = b.video_id WHERE (a.video_id, a.cue_no) NOT IN (SELECT (video_id, source_no) FROM o) GROUP BY 1, 2)
"""
_ISLANDS = """
SELECT video_id, sum(hi - lo)::BIGINT AS ms FROM (
  SELECT video_id, run, min(start_ms) AS lo, max(end_ms) AS hi FROM (
    SELECT *, sum(CASE WHEN start_ms > before THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {t} WHERE end_ms > start_ms))
  GROUP BY 1, 2) GROUP BY 1
"""
#: Independent of the islands above: every elementary interval between two boundaries is tested by its start.
_SWEEP = """
e AS (SELECT video_id, t, lead(t) OVER (PARTITION BY video_id ORDER BY t) AS u FROM (
  SELECT video_id, start_ms AS t FROM a UNION SELECT video_id, end_ms FROM a UNION SELECT video_id, start_ms FROM b UNION SELECT video_id, end_ms FROM b)),
i AS (SELECT video_id, sum(u - t)::BIGINT AS both_ms FROM e WHERE u IS NOT NULL
  AND EXISTS (SELECT 1 FROM a WHERE a.video_id = e.video_id AND a.start_ms <= t AND t < a.end_ms)
  AND EXISTS (SELECT 1 FROM b WHERE b.video_id = e.video_id AND b.start_ms <= t AND t < b.end_ms) GROUP BY 1)
"""
ORACLE_SQL = {
    "overlap_pairs": f"WITH {_AB} SELECT a.video_id, a.cue_no, b.cue_no AS r_cue_no, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms FROM a JOIN b ON a.video_id = b.video_id AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 10",
    "attach_dialogue": f"""WITH c AS ({V.CUES_DUCK}), s AS (SELECT video_id, CAST(floor(cue_no / 3) AS BIGINT) AS scene_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM c GROUP BY 1, 2),
j AS (SELECT s.video_id, s.scene_no, left(string_agg(c.text, ' ' ORDER BY c.cue_no), 900) AS dialogue FROM s JOIN c ON s.video_id = c.video_id AND c.end_ms >= s.start_ms AND c.start_ms <= s.end_ms GROUP BY 1, 2)
SELECT video_id, scene_no, md5(dialogue) AS dialogue_md5, length(dialogue)::INT AS n_chars FROM j""",
    "nearest_cue": f"""WITH {_AB} SELECT a.video_id, a.cue_no, arg_min(b.cue_no, (abs(a.start_ms + a.end_ms - b.start_ms - b.end_ms), b.cue_no)) AS r_cue_no,
min(abs(a.start_ms + a.end_ms - b.start_ms - b.end_ms)) AS distance2_ms FROM a JOIN b ON a.video_id = b.video_id GROUP BY 1, 2""",
    "align_tracks": f"""WITH {_AB}, {_PAIRS}, u AS (SELECT *, 'overlap' AS kind FROM o UNION ALL SELECT *, 'nearest' FROM n)
SELECT * FROM u UNION ALL SELECT video_id, NULL, cue_no, 'unmatched' FROM b WHERE (video_id, cue_no) NOT IN (SELECT (video_id, target_no) FROM u)
UNION ALL SELECT video_id, cue_no, NULL, 'unmatched' FROM a WHERE (video_id, cue_no) NOT IN (SELECT (video_id, source_no) FROM u)""",
    "union_duration": f"WITH s AS ({V.SPANS_DUCK}) SELECT video_id, ms AS union_ms FROM ({_ISLANDS.format(t='s')})",
    "intersection_duration": f"WITH {_AB}, {_SWEEP} SELECT video_id, both_ms FROM i",
    "timeline_score": f"""WITH {_AB}, {_PAIRS}, {_SWEEP}, p AS (SELECT * FROM o UNION ALL SELECT * FROM n),
m AS (SELECT p.video_id, p.source_no, min(b.start_ms) AS t0, max(b.end_ms) AS t1 FROM p JOIN b ON b.video_id = p.video_id AND b.cue_no = p.target_no GROUP BY 1, 2),
f AS (SELECT m.video_id, sum(abs(a.start_ms - t0) + abs(a.end_ms - t1)) / (2.0 * count(*)) AS mean_offset_ms FROM m JOIN a ON a.video_id = m.video_id AND a.cue_no = m.source_no GROUP BY 1),
k AS (SELECT video_id, mean_offset_ms, coalesce(x.ms, 0) AS source_ms, coalesce(y.ms, 0) AS target_ms, coalesce(both_ms, 0) AS both_ms
  FROM ({_ISLANDS.format(t='a')}) x FULL JOIN ({_ISLANDS.format(t='b')}) y USING (video_id) LEFT JOIN i USING (video_id) LEFT JOIN f USING (video_id))
SELECT video_id, source_ms, target_ms, both_ms, cast(floor(mean_offset_ms * 1000000 + 0.5) AS BIGINT) AS offset_micro,
  cast(floor(CASE WHEN source_ms > 0 AND target_ms > 0 THEN least(100, greatest(0, 0.65 * (both_ms / greatest(source_ms, 1) + both_ms / greatest(target_ms, 1)) / 2 * 100
    + 0.35 * least(100, greatest(0, 100 - 80 * greatest(0, mean_offset_ms / 1000 - 0.05))))) ELSE 0 END * 1000000 + 0.5) AS BIGINT) AS score_micro FROM k""",
    "index_runs": f"""WITH s AS (SELECT DISTINCT video_id, CAST(floor(start_ms / 86400000) AS BIGINT) AS idx FROM ({V.SPANS_DUCK}))
SELECT video_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY video_id ORDER BY idx) AS g FROM s) GROUP BY video_id, g""",
    "sample_windows": f"""SELECT video_id, cue_no AS idx, coalesce((lag(start_ms) OVER w + start_ms) // 2, 0) AS from_ms, coalesce((lead(start_ms) OVER w + start_ms) // 2, 4000000000000) AS to_ms
FROM ({V.SPANS_DUCK}) WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, cue_no)""",
    "audit_slots": f"""WITH c AS ({V.CUES_DUCK}), e AS (SELECT video_id, CASE WHEN cue_no % 5 = 4 THEN -2 * cue_no ELSE cue_no END AS cue_no, end_ms - start_ms AS a FROM c),
r AS (SELECT video_id, CASE WHEN cue_no % 4 = 3 THEN -2 * cue_no - 1 ELSE cue_no END AS cue_no, CASE WHEN cue_no % 6 = 5 THEN NULL ELSE end_ms - start_ms + cue_no * 40 END AS d, 1 AS has FROM c),
x AS (SELECT video_id, count(has) AS n_recorded, count(a) AS n_expected, count(*) FILTER (d > a + 80) AS n_overrun, count(*) FILTER (has = 1 AND a IS NOT NULL AND d IS NULL) AS n_unreadable,
  count(*) FILTER (has = 1 AND a IS NOT NULL) AS n FROM e FULL JOIN r USING (video_id, cue_no) GROUP BY 1)
SELECT video_id, n_recorded, n_expected, n_overrun, n_unreadable,
  cast(floor(CASE WHEN n_expected > 0 THEN 100.0 * (n - n_overrun - n_unreadable) / n_expected WHEN n_recorded = 0 THEN 100.0 ELSE 0.0 END * 1000000 + 0.5) AS BIGINT) AS coverage_micro,
  n_recorded = n_expected AND n - n_overrun - n_unreadable = n_expected AS matched FROM x""",
}
