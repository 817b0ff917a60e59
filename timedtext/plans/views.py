"""Timed-text views derived from the base tables. A view is one SQL text for both engines, or a pair where they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DUR = "greatest(500, 60 * length(text))"
CUES = f"""
SELECT conv_id AS video_id, turn AS cue_no, role, text,
  CAST(start_ms AS BIGINT) AS start_ms, CAST(start_ms + dur_ms + CASE WHEN turn % 7 = 3 THEN 900 ELSE 0 END AS BIGINT) AS end_ms
FROM (SELECT conv_id, turn, role, text, {_DUR} AS dur_ms,
  coalesce(sum({_DUR}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 200 * turn AS start_ms
  FROM {{conversations}})
"""
SPANS_SPARK = """
SELECT user_id AS video_id, event_id AS cue_no, event_type AS track, unix_micros(cast(ts AS timestamp)) div 1000 AS start_ms,
  unix_micros(cast(ts AS timestamp)) div 1000 + cast(floor(value * 60000) AS bigint) AS end_ms FROM {events}
"""
SPANS_DUCK = """
SELECT user_id AS video_id, event_id AS cue_no, event_type AS track, epoch_us(ts) // 1000 AS start_ms,
  epoch_us(ts) // 1000 + cast(floor(value * 60000) AS bigint) AS end_ms FROM events
"""
#: Six criteria per supplier, over all its line items; a judge's score is missing for a quarter of them.
SCORES = """
SELECT video_id, k, CAST(sum(q) % 101 AS DOUBLE) AS baseline, CASE WHEN (video_id + k) % 4 = 0 THEN NULL ELSE CAST(sum(p) % 101 AS DOUBLE) END AS judge
FROM (SELECT l_suppkey AS video_id, CAST((l_linenumber - 1) % 6 + 1 AS BIGINT) AS k, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p FROM {lineitem})
GROUP BY video_id, k
"""
SEGMENTS = """
SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY cue_no) AS BIGINT) AS seq, CAST(floor(cue_no / 3) AS BIGINT) AS event_no,
  text AS narration, start_ms, end_ms, length(text) AS weight FROM ({cues})
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CUES, conversations=table(spark, sf_dir, "conversations"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPANS_SPARK, events=table(spark, sf_dir, "events"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORES, lineitem=table(spark, sf_dir, "lineitem"))


CUES_DUCK = CUES.format(conversations="conversations")
SCORES_DUCK = SCORES.format(lineitem="lineitem")
SEGMENTS_DUCK = SEGMENTS.format(cues=CUES_DUCK)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEGMENTS.replace("({cues})", "{cues}"), cues=cues(spark, sf_dir))
