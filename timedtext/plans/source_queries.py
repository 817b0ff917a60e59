"""Queries over subtitle text, word timings, listings and jobs, built from the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import times
from ..functions.scores import micro
from ..sources import subtitles as R
from ..streaming import jobs as J
from . import views as V


def srt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Cues written as subtitle text and parsed again."""
    c = V.cues(spark, d).withColumn("track", F.col("role")).withColumn("text", F.regexp_replace("text", "\\s+", " "))
    back = R.parse_srt(R.srt_text(c))
    return back.select("video_id", "track", F.col("cue_no").cast("long").alias("cue_no"), "start_ms", "end_ms", F.md5("text").alias("text_md5"))


def rescale_words(spark: SparkSession, d: str) -> DataFrame:
    s = V.spans(spark, d).select("video_id", F.col("cue_no").alias("word_no"), F.col("track").alias("word"), (F.col("start_ms") % 100000).alias("start_ms"), (F.col("start_ms") % 100000 + F.col("cue_no") % 700).alias("end_ms"))
    dur = s.select("video_id").distinct().select("video_id", F.lit(100000).alias("from_ms"), (F.col("video_id") % 5 * 20000).cast("long").alias("to_ms"))
    return R.rescale_words(s, dur)


def word_boundaries(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select((F.col("user_id") % 40).alias("video_id"), (F.col("event_id") % 3).alias("part_no"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "view", "SentenceBoundary").otherwise("WordBoundary").alias("type"), (F.col("event_id") * 12345).alias("offset"), (F.floor("value") * 7000).cast("long").alias("duration"), F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("event_id"))).alias("text"))
    lines = e.select("video_id", "part_no", "line_no", F.to_json(F.struct("type", "offset", "duration", "text")).alias("line"))
    parts = e.select("video_id", "part_no").distinct().withColumn("length_ms", (F.col("part_no") + 2) * 1000)
    return R.word_boundaries(lines, parts).select("video_id", F.col("word_no").cast("long").alias("word_no"), "word", "start_ms", "end_ms")


def pick_track(spark: SparkSession, d: str) -> DataFrame:
    t = V.table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("video_id"), F.concat(F.lit("l"), F.col("s_nationkey") % 4).alias("language"), (F.col("s_nationkey") % 4).alias("lang_rank"), F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 5 == 0, "-orig").otherwise("")).alias("name"))
    return R.pick_track(t)


def pick_artifacts(spark: SparkSession, d: str) -> DataFrame:
    listing = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("video_id"), F.concat(F.lit("f"), F.col("l_linenumber")).alias("name")).agg(F.max(F.col("l_quantity").cast("long") % 4).alias("size"))
    order = V.table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "video").otherwise("text").alias("role"), F.concat(F.lit("f"), F.col("n_nationkey")).alias("name"), (30 - F.col("n_nationkey")).alias("rank"))
    return R.pick_artifacts(listing, order)


def timestamps(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    return c.select("video_id", "cue_no", times.format_timestamp("start_ms").alias("srt"), times.format_timestamp("start_ms", "ass").alias("ass"), times.format_timestamp("start_ms", "clock").alias("clock"), times.format_range("start_ms", "end_ms").alias("span"), times.parse_timestamp(times.format_timestamp("end_ms")).alias("parsed_ms"), times.parse_clock(times.format_timestamp("end_ms", "clock")).alias("clock_ms"), F.floor(times.time_proximity("start_ms", "end_ms", F.lit(600000)) * 1e6 + 0.5).cast("long").alias("near_micro"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.clean_caption(F.concat(F.lit('"'), F.replace("text", F.lit("."), F.lit(" .")), F.lit(".....")))).alias("caption_md5"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    out = docs.select("doc_id", T.clean_tags(F.transform(F.split("text", " "), lambda w: F.concat(F.lit("##"), w))).alias("t"))
    return out.select("doc_id", F.size("t").alias("n"), F.array_join("t", ",").alias("tags"))


def numbers(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").select("p_partkey", F.concat(F.lit("about "), F.floor(F.col("p_size") / 4), F.lit(","), F.lpad((F.col("p_size") % 4 * 25).cast("string"), 2, "0"), F.lit(" %")).alias("said"))
    return p.select("p_partkey", micro(S.to_number("said")).alias("number_micro"), micro(S.to_confidence("said")).alias("confidence_micro"))


def json_recovery(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("j"))
    reply = F.when(F.col("o_orderkey") % 4 == 0, F.col("j")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Here it is: "), "j", F.lit(" done"))).otherwise(F.concat(F.lit("no "), F.substring("j", 2, 100)))
    out = o.select("o_orderkey", T.recover_json(reply).alias("r"))
    return out.select("o_orderkey", F.get_json_object("r", "$.o_orderstatus").alias("status"))


def retain(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("modified_at"))
    last = e.agg(F.max("modified_at")).first()[0]
    return J.retain(e, F.lit(last)).select("event_id")


def windowed_activity(spark: SparkSession, d: str) -> DataFrame:
    u = V.table(spark, d, "events").select(F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), F.floor("value").alias("progress"))
    out = J.windowed_activity(u)
    return out.select(F.unix_seconds("window_start").alias("window_s"), "status", "n", "max_progress")


QUERIES = {f.__name__: f for f in (srt_round_trip, rescale_words, word_boundaries, pick_track, pick_artifacts, timestamps, captions, tags, numbers, json_recovery, retain, windowed_activity)}

_C = f"c AS ({V.CUES_DUCK})"
_HMS = "lpad((t // 3600000)::VARCHAR, 2, '0') || ':' || lpad((t // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((t // 1000 % 60)::VARCHAR, 2, '0')"
ORACLE_SQL = {
    "srt_round_trip": rf"WITH {_C} SELECT video_id, role AS track, row_number() OVER (PARTITION BY video_id, role ORDER BY cue_no) AS cue_no, start_ms, end_ms, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5 FROM c WHERE trim(text) <> ''",
    "rescale_words": f"""WITH s AS (SELECT video_id, cue_no AS word_no, track AS word, start_ms % 100000 AS a, start_ms % 100000 + cue_no % 700 AS b, video_id % 5 * 20000 AS t FROM ({V.SPANS_DUCK})),
h AS (SELECT *, CASE WHEN t > 0 THEN t / 100000.0::DOUBLE ELSE 1 END AS f FROM s WHERE b > a), g AS (SELECT *, greatest(0, least(t, cast(floor(a * f + 0.5) AS BIGINT))) AS start_ms FROM h)
SELECT video_id, word_no, word, start_ms, greatest(greatest(0, least(t, cast(floor(b * f + 0.5) AS BIGINT))), start_ms + 10) AS end_ms FROM g""",
    "word_boundaries": """WITH e AS (SELECT user_id % 40 AS video_id, event_id % 3 AS part_no, event_id, event_type, floor(value)::BIGINT * 7000 AS n FROM events), p AS (SELECT DISTINCT video_id, part_no FROM e),
o AS (SELECT *, coalesce(sum((part_no + 2) * 1000) OVER (PARTITION BY video_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM p),
k AS (SELECT e.*, base + cast(floor(event_id * 12345 / 10000.0::DOUBLE + 0.5) AS BIGINT) AS start_ms FROM e JOIN o USING (video_id, part_no) WHERE event_type <> 'view' AND event_id % 11 <> 0)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY part_no, event_id) AS word_no, 'w' || event_id AS word, start_ms, start_ms + greatest(10, cast(floor(n / 10000.0::DOUBLE + 0.5) AS BIGINT)) AS end_ms FROM k""",
    "pick_track": """WITH t AS (SELECT s_suppkey % 7 AS video_id, 'l' || (s_nationkey % 4) AS language, s_nationkey % 4 AS r, s_suppkey % 5 = 0 AS o, s_name || CASE WHEN s_suppkey % 5 = 0 THEN '-orig' ELSE '' END AS name FROM supplier),
h AS (SELECT *, bool_or(o) OVER (PARTITION BY video_id, language) AS has FROM t) SELECT video_id, language, name FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY has DESC, r, o, name) AS i FROM h) WHERE i = 1""",
    "pick_artifacts": """WITH l AS (SELECT l_orderkey AS video_id, 'f' || l_linenumber AS name, max(l_quantity::BIGINT % 4) AS size FROM lineitem GROUP BY 1, 2), p AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'video' ELSE 'text' END AS role, 'f' || n_nationkey AS name, 30 - n_nationkey AS rank FROM nation)
SELECT video_id, role, arg_min(name, rank) AS name FROM l JOIN p USING (name) WHERE size > 0 GROUP BY 1, 2""",
    "timestamps": f"""WITH {_C}, t AS (SELECT *, start_ms AS t FROM c) SELECT video_id, cue_no, {_HMS} || ',' || lpad((t % 1000)::VARCHAR, 3, '0') AS srt, (t // 3600000)::VARCHAR || ':' || lpad((t // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((t // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((t % 1000 // 10)::VARCHAR, 2, '0') AS ass,
{_HMS} AS clock, {_HMS} || '-' || {_HMS.replace('(t //', '(end_ms //')} AS span, end_ms AS parsed_ms, end_ms // 1000 * 1000 AS clock_ms, cast(floor(exp(-pow((end_ms - start_ms) / 108000.0::DOUBLE, 2)) * 1000000 + 0.5) AS BIGINT) AS near_micro FROM t""",
    "captions": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(replace('"' || replace(text, '.', ' .') || '.....', '\N', ' '), '\s+', ' ', 'g')) AS t FROM documents), a AS (SELECT doc_id, regexp_replace(t, '([0-9]),\s+([0-9])', '\1,\2', 'g') AS t FROM t),
b AS (SELECT doc_id, trim(t, e' \t\n"''') AS t FROM a), d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\.{4,}', '...', 'g'), '\s+([.,!?:;])', '\1', 'g') AS t FROM b) SELECT doc_id, md5(regexp_replace(t, ',([^\s0-9])', ', \1', 'g')) AS caption_md5 FROM d""",
    "tags": r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), t AS (SELECT doc_id, regexp_replace(lower(w), '[^\pL\pN\pM_-]+', '', 'g') AS t, i FROM w),
u AS (SELECT doc_id, t, min(i) AS i FROM t WHERE t <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM u) SELECT doc_id, count(t)::INT AS n, coalesce(string_agg(t, ',' ORDER BY k), '') AS tags FROM documents LEFT JOIN r USING (doc_id) WHERE coalesce(k, 1) <= 18 GROUP BY 1""",
    "numbers": """WITH n AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS v FROM part) SELECT p_partkey, cast(floor(v * 1000000 + 0.5) AS BIGINT) AS number_micro, cast(floor(least(1, greatest(0, CASE WHEN v > 1 THEN v / 100 ELSE v END)) * 1000000 + 0.5) AS BIGINT) AS confidence_micro FROM n""",
    "json_recovery": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderstatus END AS status FROM orders",
    "retain": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR",
    "windowed_activity": "SELECT epoch_us(ts) // 3600000000 * 3600 AS window_s, event_type AS status, count(*) AS n, max(floor(value)::BIGINT) AS max_progress FROM events GROUP BY 1, 2",
}
