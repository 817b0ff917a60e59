"""Queries over narration segments, candidates and boxes. The opening words of the test data stand in for connectives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import segments as G
from ..functions.scores import micro
from . import views as V

#: Frequent first words of the test texts, in the role of opening connectives.
OPENERS = "the|of|on|in|and|die|der|la|el|de|th|en"
GENERIC = ("the", "of", "die", "la", "en")
_ROWS = 500_000


def _segments(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?…]+[.!?…]*"), F.lit(0))).alias("seq", "narration"))
    n = F.length("narration")
    return s.select("video_id", F.col("seq").cast("long").alias("seq"), F.floor(F.col("seq") / 3).alias("event_no"), F.ltrim("narration").alias("narration"), n.cast("long").alias("weight"), ((F.col("seq") * 37 + n * 11) % 5000).cast("long").alias("start_ms"), ((F.col("seq") * 37 + n * 11) % 5000 + n * 20).cast("long").alias("end_ms"))


def marker_repetition(spark: SparkSession, d: str) -> DataFrame:
    return G.marker_repetition(_segments(spark, d), OPENERS)


def marker_runs(spark: SparkSession, d: str) -> DataFrame:
    return G.marker_runs(_segments(spark, d), OPENERS, 2)


def strip_markers(spark: SparkSession, d: str) -> DataFrame:
    out = G.strip_markers(_segments(spark, d), OPENERS, GENERIC)
    return out.select("video_id", "seq", "stripped", F.md5("narration").alias("narration_md5"))


def chronology(spark: SparkSession, d: str) -> DataFrame:
    return G.chronology(_segments(spark, d))


def repeats_previous(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).withColumn("scene_ids", F.when(F.col("weight") % 7 == 0, F.array()).otherwise(F.array(F.floor(F.col("seq") / 4))))
    said = F.when(F.col("weight") % 3 == 0, F.array(F.lit(" Walks  off"))).when(F.col("weight") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("weight") % 11 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("walks off")))
    return G.repeats_previous(s.withColumn("actions", said), 0.2).select("video_id", "seq", micro("overlap").alias("overlap_micro"), "repeats")


def allocate_voice(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    t = s.groupBy("video_id").agg((F.sum("weight") * 55 + 345).alias("duration_ms"))
    return G.allocate_voice(s, t).select("video_id", "seq", "voice_start_ms", "voice_end_ms")


def resequence(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    order = s.select("video_id", "seq", F.row_number().over(G._w("weight", "seq")).cast("long").alias("new_seq"))
    return G.resequence(s, order).select("video_id", "new_seq", "seq", "voice_start_ms", "voice_end_ms")


def reorder_in_event(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).withColumn("source_ms", F.when(F.col("weight") % 9 != 0, F.col("start_ms")))
    return G.reorder_in_event(s)


def story_roles(spark: SparkSession, d: str) -> DataFrame:
    e = _segments(spark, d).groupBy("video_id", "event_no").agg(F.min("start_ms").alias("start_ms"), F.max("weight").alias("m"))
    return G.story_roles(e.withColumn("order_index", F.col("event_no")).withColumn("verified", F.col("m") % 4 != 0))


def quantize(spark: SparkSession, d: str) -> DataFrame:
    p = _segments(spark, d).select("video_id", "seq", (F.col("weight") % 97).alias("length_ms"))
    p = p.withColumn("target_ms", F.sum("length_ms").over(Window.partitionBy("video_id")) + F.col("video_id") % 90)
    return G.quantize(p, 30).select("video_id", "seq", "frame_end")


def partition_repeats(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("video_id"), F.col("l_orderkey").alias("seq")).agg((F.sum("l_linenumber") % 3 * 1000 + F.sum("l_linenumber") % 5 * 20).alias("start_ms"), (2000 + F.max("l_linenumber") % 4 * 30).alias("length"))
    return G.partition_repeats(p.withColumn("end_ms", F.col("start_ms") + F.col("length"))).select("video_id", "seq", "slice_start_ms", "slice_end_ms")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem")
    # Dealt by segment before they are summed, some _ROWS a task at any size: few rows of an order are of one part, so that sums on the way save none.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), li.count() // _ROWS)
    li = li.select(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") % 50).alias("seq"), F.col("l_partkey").alias("candidate_id"), "l_orderkey", "l_linenumber", "l_quantity").repartition(tasks, "video_id", "seq")
    return li.groupBy("video_id", "seq", "candidate_id", "l_orderkey").agg(F.sum("l_linenumber").alias("pos"), F.sum(F.col("l_quantity").cast("long")).alias("score")).drop("l_orderkey")


def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).groupBy("video_id", "seq", "candidate_id").agg(F.max("score").alias("score"))
    return G.top_candidates(c, 3)


def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    return G.candidate_pool(_candidates(spark, d))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i, span: F.floor(F.abs(F.element_at("embedding", i)) * 4 * span).cast("double")
    return V.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("region_id"), e(1, 80).alias("x"), e(2, 80).alias("y"), (e(3, 30) + 1).alias("w"), (e(4, 30) + 1).alias("h"))


def smooth_boxes(spark: SparkSession, d: str) -> DataFrame:
    return G.smooth_boxes(_boxes(spark, d).withColumnRenamed("region_id", "frame"))


def overlapping_regions(spark: SparkSession, d: str) -> DataFrame:
    return G.overlapping_regions(_boxes(spark, d), 0.25).select("video_id", "region_id", "r_region_id", micro("share").alias("share_micro"))


QUERIES = {f.__name__: f for f in (marker_repetition, marker_runs, strip_markers, chronology, repeats_previous, allocate_voice, resequence, reorder_in_event, story_roles, quantize, partition_repeats, top_candidates, candidate_pool, smooth_boxes, overlapping_regions)}

_S = r"""s AS (SELECT video_id, seq, seq // 3 AS event_no, ltrim(t) AS narration, length(t) AS weight, (seq * 37 + length(t) * 11) % 5000 AS start_ms, (seq * 37 + length(t) * 11) % 5000 + length(t) * 20 AS end_ms FROM (
  SELECT doc_id AS video_id, unnest(regexp_extract_all(text, '[^.!?…]+[.!?…]*', 0)) AS t, generate_subscripts(regexp_extract_all(text, '[^.!?…]+[.!?…]*', 0), 1) - 1 AS seq FROM documents))"""
_HEAD = f"""'(?i)^\\s*["''“”‘’(\\[]*\\s*({OPENERS})([^\\pL\\pN\\pM_]|$)'"""
_M = f"{_S}, m AS (SELECT *, lower(regexp_extract(narration, {_HEAD}, 1)) AS marker FROM s)"
_BOX = "r AS (SELECT label::BIGINT AS video_id, vec_id AS region_id, floor(abs(embedding[1]::DOUBLE) * 4 * 80) AS x, floor(abs(embedding[2]::DOUBLE) * 4 * 80) AS y, floor(abs(embedding[3]::DOUBLE) * 4 * 30) + 1 AS w, floor(abs(embedding[4]::DOUBLE) * 4 * 30) + 1 AS h FROM embeddings)"
_CAND = "c AS (SELECT l_suppkey AS video_id, l_orderkey % 50 AS seq, l_partkey AS candidate_id, sum(l_linenumber)::BIGINT AS pos, sum(l_quantity::BIGINT)::BIGINT AS score FROM lineitem GROUP BY l_suppkey, l_orderkey, l_partkey)"
_W = "(PARTITION BY video_id ORDER BY seq)"
ORACLE_SQL = {
    "marker_repetition": f"WITH {_M}, n AS (SELECT video_id, marker, count(*) AS n, sum(count(*)) OVER (PARTITION BY video_id)::BIGINT AS n_segments FROM m GROUP BY 1, 2) SELECT * FROM n WHERE marker <> '' AND n_segments >= 4 AND n > greatest(2, floor(n_segments * 0.1::DOUBLE))",
    "marker_runs": f"WITH {_M}, g AS (SELECT *, seq - row_number() OVER (PARTITION BY video_id, marker ORDER BY seq) AS run FROM m WHERE marker <> '') SELECT video_id, marker, min(seq) AS first_seq, count(*) AS n FROM g GROUP BY video_id, marker, run HAVING count(*) >= 2",
    "strip_markers": f"""WITH {_M}, x AS (SELECT *, CASE WHEN marker <> '' THEN regexp_replace(regexp_replace(narration, '(?i)^\\s*["''“”‘’(\\[]*\\s*(?:{OPENERS})', ''), '^[\\s,;:–—-]*', '') ELSE narration END AS rest, coalesce(event_no = lag(event_no) OVER {_W}, FALSE) AS same FROM m),
y AS (SELECT *, same AND marker IN {GENERIC} AND trim(rest) <> '' AS stripped FROM x) SELECT video_id, seq, stripped, md5(CASE WHEN stripped THEN replace(upper(left(rest, 1)), 'ẞ', 'SS') || substring(rest, 2) ELSE narration END) AS narration_md5 FROM y""",
    "chronology": f"""WITH {_S} SELECT video_id, seq, coalesce(event_no < lag(event_no) OVER w, FALSE) AS event_back, coalesce(start_ms < lag(start_ms) OVER w - 250, FALSE) AS time_back,
coalesce(start_ms < max(start_ms) OVER (PARTITION BY video_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 250, FALSE) AS behind_latest FROM s WINDOW w AS {_W}""",
    "repeats_previous": rf"""WITH {_S}, p AS (SELECT *, lag(event_no) OVER w AS pe, list_distinct(regexp_extract_all(strip_accents(lower(narration)), '[\pL\pN\pM_]{{2,}}', 0)) AS a, list_distinct(regexp_extract_all(strip_accents(lower(lag(narration) OVER w)), '[\pL\pN\pM_]{{2,}}', 0)) AS b, seq // 4 = lag(seq) OVER w // 4 AND weight % 7 <> 0 AND lag(weight) OVER w % 7 <> 0 AND (weight % 3 = 0 OR (weight % 5 <> 0 AND weight % 11 <> 0)) AND (lag(weight) OVER w % 3 = 0 OR (lag(weight) OVER w % 5 <> 0 AND lag(weight) OVER w % 11 <> 0)) AS same FROM s WINDOW w AS {_W}),
o AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS v FROM p WHERE pe IS NOT NULL) SELECT video_id, seq, cast(floor(v * 1000000 + 0.5) AS BIGINT) AS overlap_micro, event_no = pe AND same AND v >= 0.2::DOUBLE AS repeats FROM o""",
    "allocate_voice": f"""WITH {_S}, t AS (SELECT *, sum(weight) OVER (PARTITION BY video_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY video_id) AS total FROM s),
e AS (SELECT video_id, seq, cast(floor(run * (total * 55 + 345) / total::DOUBLE + 0.5) AS BIGINT) AS voice_end_ms FROM t) SELECT video_id, seq, coalesce(lag(voice_end_ms) OVER {_W}, 0) AS voice_start_ms, voice_end_ms FROM e""",
    "resequence": f"""WITH {_S}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY weight, seq) AS new_seq, greatest(10, end_ms - start_ms) AS len FROM s), e AS (SELECT *, sum(len) OVER (PARTITION BY video_id ORDER BY new_seq ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM o)
SELECT video_id, new_seq, seq, e - len AS voice_start_ms, e AS voice_end_ms FROM e""",
    "reorder_in_event": f"""WITH {_S}, x AS (SELECT *, CASE WHEN weight % 9 <> 0 THEN start_ms END AS src FROM s), k AS (SELECT video_id, event_no, bool_and(src IS NOT NULL) AS known FROM x GROUP BY 1, 2)
SELECT video_id, seq, row_number() OVER (PARTITION BY video_id ORDER BY event_no, CASE WHEN known THEN src ELSE 0 END, seq) AS new_seq FROM x JOIN k USING (video_id, event_no)""",
    "story_roles": f"""WITH {_S}, e AS (SELECT video_id, event_no, min(start_ms) AS start_ms, max(weight) % 4 <> 0 AS verified FROM s GROUP BY 1, 2), f AS (SELECT * FROM e WHERE verified OR video_id NOT IN (SELECT video_id FROM e WHERE verified)),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY event_no) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM f)
SELECT video_id, event_no, CASE WHEN i = 0 THEN 'hook' WHEN i = n - 1 THEN 'resolution' WHEN i / greatest(n - 1, 1) <= 0.25 THEN 'context' WHEN i / greatest(n - 1, 1) <= 0.65::DOUBLE THEN 'conflict' WHEN i / greatest(n - 1, 1) <= 0.85::DOUBLE THEN 'climax' ELSE 'resolution' END AS role FROM r""",
    "quantize": f"""WITH RECURSIVE {_S}, p AS (SELECT video_id, seq, round_even(sum(weight % 97) OVER (PARTITION BY video_id ORDER BY seq ROWS UNBOUNDED PRECEDING) * 30 / 1000.0::DOUBLE, 0)::BIGINT AS f FROM s),
q(video_id, seq, frame_end) AS (SELECT video_id, seq, greatest(1, f) FROM p WHERE seq = 0 UNION ALL SELECT p.video_id, p.seq, greatest(q.frame_end + 1, p.f) FROM q JOIN p ON p.video_id = q.video_id AND p.seq = q.seq + 1), n AS (SELECT video_id, max(seq) AS last, count(*) AS n, ceil((sum(weight % 97) + any_value(video_id) % 90) * 30 / 1000.0::DOUBLE)::BIGINT AS f FROM s GROUP BY 1) SELECT video_id, seq, CASE WHEN seq = last THEN greatest(n, f) ELSE frame_end END AS frame_end FROM q JOIN n USING (video_id)""",
    "partition_repeats": """WITH RECURSIVE p AS (SELECT l_suppkey AS video_id, l_orderkey AS seq, (sum(l_linenumber) % 3 * 1000 + sum(l_linenumber) % 5 * 20)::BIGINT AS lo, (2000 + max(l_linenumber) % 4 * 30)::BIGINT AS len, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS r FROM lineitem GROUP BY 1, 2),
f(video_id, r, seq, first, lo, len) AS (SELECT video_id, r, seq, r, lo, len FROM p WHERE r = 1 UNION ALL
  SELECT p.video_id, p.r, p.seq, CASE WHEN n THEN p.r ELSE f.first END, CASE WHEN n THEN p.lo ELSE f.lo END, CASE WHEN n THEN p.len ELSE f.len END
  FROM (SELECT f.*, p.r AS nr, abs(p.lo - f.lo) > 50 OR abs(p.len - f.len) > 50 AS n FROM f JOIN p ON p.video_id = f.video_id AND p.r = f.r + 1) f JOIN p ON p.video_id = f.video_id AND p.r = f.nr),
i AS (SELECT *, count(*) OVER (PARTITION BY video_id, first) AS n FROM f) SELECT video_id, seq, (lo + len * (r - first) // n)::BIGINT AS slice_start_ms, (lo + len * (r - first + 1) // n)::BIGINT AS slice_end_ms FROM i""",
    "top_candidates": f"WITH {_CAND}, g AS (SELECT video_id, seq, candidate_id, max(score) AS score FROM c GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seq ORDER BY score DESC, candidate_id)::INT AS rank FROM g) WHERE rank <= 3",
    "candidate_pool": f"WITH {_CAND} SELECT video_id, candidate_id, max(score) AS score, arg_min(pos, (-score, pos)) AS pos FROM c GROUP BY 1, 2",
    "smooth_boxes": f"""WITH {_BOX}, m AS (SELECT *, median(x) OVER w AS mx, median(y) OVER w AS my, median(w) OVER w AS mw, median(h) OVER w AS mh FROM r WINDOW w AS (PARTITION BY video_id ORDER BY region_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT video_id, region_id AS frame, least(mx, x) AS x, least(my, y) AS y, greatest(mx + mw, x + w) - least(mx, x) AS w, greatest(my + mh, y + h) - least(my, y) AS h FROM m""",
    "overlapping_regions": f"""WITH {_BOX}, p AS (SELECT a.video_id, a.region_id, b.region_id AS r_region_id, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) AS ix, (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS iy, greatest(1, least(a.w * a.h, b.w * b.h)) AS s FROM r a JOIN r b ON a.video_id = b.video_id AND a.region_id < b.region_id)
SELECT video_id, region_id, r_region_id, cast(floor(ix * iy / s * 1000000 + 0.5) AS BIGINT) AS share_micro FROM p WHERE ix > 0 AND iy > 0 AND ix * iy / s > 0.25""",
}
