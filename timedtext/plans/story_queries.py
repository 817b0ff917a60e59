"""Queries over whole films: beats and transcripts, weak clips, repair after an edit. A film is eight conversations in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import micro
from ..operators import aliases as N
from ..operators import alignment as A
from ..operators import balancing as B
from ..operators import caption_sync as S
from ..operators import quality as Q
from ..operators.reports import REPORT_WEIGHTS
from ..operators.scorecards import budget
from ..operators.segments import OPENERS
from . import views as V
from .match_queries import _TERMS

FILM = f"""
SELECT video_id, cue_no, text, CAST(coalesce(sum(dur) OVER (PARTITION BY video_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 150 * cue_no AS BIGINT) AS start_ms,
  CAST(sum(dur) OVER (PARTITION BY video_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 150 * cue_no AS BIGINT) AS end_ms
FROM (SELECT CAST(floor(conv_id / 8) AS BIGINT) AS video_id, CAST(row_number() OVER (PARTITION BY floor(conv_id / 8) ORDER BY conv_id, turn) - 1 AS BIGINT) AS cue_no, text, {V._DUR} AS dur FROM {{conversations}})
"""
#: Every turn is a beat too; some have a hint, some of these an end, some hints are void.
BEATS = """
SELECT video_id, cue_no AS beat_no, text, CASE WHEN cue_no % 4 = 1 THEN (CASE WHEN cue_no % 8 = 5 THEN -1 ELSE 1 END) * (start_ms + 15000 * (cue_no % 3)) END AS hint_start_ms,
  CASE WHEN cue_no % 3 = 1 THEN start_ms + 30000 END AS hint_end_ms FROM {film}
"""
#: The selected clip of each turn at position 0, with a gap where there is none, and three more, of which some are the selected one again.
CLIPS = """
SELECT video_id, seq, pos, CASE WHEN pos = 3 AND seq % 2 = 0 THEN seq * 10 ELSE seq * 10 + pos END AS candidate_id, start_ms + (seq % 4 - 1) * 9000 * (1 - sign(pos)) + pos * 4000 - 6000 * (seq % 3) * sign(pos) AS start_ms,
  CAST((seq * 7 + pos * 5 + video_id) % 10 AS DOUBLE) / 10 AS score, (seq + pos) % 5 <> 0 AS supports
FROM (SELECT video_id, cue_no AS seq, start_ms, CAST(pos AS BIGINT) AS pos FROM {film} CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)) WHERE NOT (pos = 0 AND seq % 11 = 5)
"""


def film(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(FILM, conversations=V.table(spark, d, "conversations"))


def _durations(f: DataFrame) -> DataFrame:
    return f.groupBy("video_id").agg((F.max("end_ms") + 5000).alias("duration_ms"))


def _clips(spark: SparkSession, f: DataFrame) -> DataFrame:
    c = spark.sql(CLIPS, film=f)
    return c.withColumn("start_ms", F.col("start_ms").cast("long"))


def align_beats(spark: SparkSession, d: str) -> DataFrame:
    f = film(spark, d)
    out = A.align_beats(spark.sql(BEATS, film=f), f, _durations(f))
    return out.select("video_id", "beat_no", "start_ms", "end_ms", F.floor(F.col("score") * 10000 + 0.5).cast("long").alias("score_e4"), "source")


def replace_weak(spark: SparkSession, d: str) -> DataFrame:
    f = film(spark, d)
    c = _clips(spark, f)
    now = f.select("video_id", F.col("cue_no").alias("seq")).join(c.where("pos = 0").select("video_id", "seq", "candidate_id", "start_ms", "score").hint("merge"), ["video_id", "seq"], "left")
    out = A.replace_weak(now, c.where("pos > 0"))
    return out.withColumn("score", micro("score"))


def repair_edit(spark: SparkSession, d: str) -> DataFrame:
    f = film(spark, d)
    s = f.select("video_id", F.col("cue_no").alias("seq"), F.col("text").alias("narration"))
    b = f.select("video_id", (F.col("video_id") % 3 + 1).alias("minutes"), F.lit("story").alias("style")).distinct()
    out = A.repair_edit(s, _clips(spark, f).drop("supports"), b.select("video_id", *[c.alias(k) for k, c in budget("minutes", "style").items()]))
    return out.withColumn("score", micro("score"))


def caption_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Captions, words, voice ranges and lengths of all films. In every fourth film the words are not those of the captions; cues come late by film."""
    f = film(spark, d)
    late = (F.col("video_id") % 5) * 90 * (F.col("cue_no") % 3)
    captions = f.select("video_id", "cue_no", (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + 2 * late - 120).alias("end_ms"), "text")
    w = f.select("video_id", "cue_no", "start_ms", "end_ms", F.posexplode(F.split("text", " ")).alias("i", "word"), F.size(F.split("text", " ")).alias("n"))
    at = lambda k: F.floor(F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * (F.col("i") + k) / F.col("n"))
    said = F.when((F.col("video_id") % 4 == 1) & (F.col("cue_no") == 2), F.concat("word", F.lit("x"))).otherwise(F.col("word"))
    words = w.select("video_id", (F.col("cue_no") * 10000 + F.col("i")).alias("word_no"), said.alias("word"), at(0).alias("start_ms"), at(1).alias("end_ms"))
    told = F.when(F.col("cue_no") % 6 == 4, F.reverse("text")).otherwise(F.col("text"))
    ranges = f.select("video_id", F.col("cue_no").alias("seq"), told.alias("narration"), (F.col("start_ms") + 300).alias("start_ms"), "end_ms")
    return captions, words, ranges, _durations(f)


def caption_sync(spark: SparkSession, d: str) -> DataFrame:
    return S.caption_sync(*caption_tables(spark, d))


def event_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three turns of a film are an event, but for the later films' first events, which are much longer or missing."""
    f = film(spark, d)
    no = F.when((F.col("video_id") % 3 == 1) & (F.col("cue_no") < 20), 0).otherwise(F.floor(F.col("cue_no") / 3))
    events = f.withColumn("event_no", no).where("video_id % 3 <> 2 OR cue_no >= 12").groupBy("video_id", "event_no").agg(F.collect_list("cue_no").alias("scene_ids"))
    scenes = f.select("video_id", F.col("cue_no").alias("scene_id"), "start_ms", "end_ms", (F.col("cue_no") % 4).alias("n_evidence"), ((F.col("cue_no") * 7 % 10) / 10).alias("confidence"))
    counts = f.select("video_id").distinct().select("video_id", (F.col("video_id") % 4 * 4 + 5).alias("target"), (F.col("video_id") % 4 * 3 + 3).alias("least"), (F.col("video_id") % 4 * 4 + 6).alias("most"))
    return events, scenes, counts


def balance_events(spark: SparkSession, d: str) -> DataFrame:
    return B.balance_events(*event_tables(spark, d))


def alias_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parts as a cast: records by their names, glossary entries whose targets hold a name, observed names with a letter changed, seeds for some videos."""
    p = V.table(spark, d, "part").select((F.col("p_partkey") % 16).alias("video_id"), F.col("p_partkey").alias("no"), F.initcap("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))
    pair = F.concat("name", F.lit(" / "), F.reverse("name"))
    records = p.select("video_id", "no", F.when(F.col("no") % 7 == 3, pair).when(F.col("no") % 7 == 5, F.upper("name")).otherwise(F.col("name")).alias("name"), F.when(F.col("no") % 3 == 0, F.array(F.concat("brand", F.lit(", "), "type"), F.concat(F.lit("É"), "name"))).alias("aliases"))
    glossary = p.select("video_id", "no", F.concat(F.lit("g"), (F.col("no") % 50).cast("string"), F.lit("; h"), F.col("no").cast("string")).alias("source"), F.concat_ws(" ", F.lit("the old"), F.when(F.col("no") % 2 == 0, F.col("name")).otherwise(F.reverse("type")), F.lit("again")).alias("target"))
    observed = p.select("video_id", "no", F.when(F.col("no") % 9 == 0, F.lit("unknown man")).when(F.col("no") % 4 == 1, F.concat("name", F.lit("e"))).otherwise(F.concat_ws(" ", "type", "brand")).alias("name"))
    seeds = p.where("video_id % 4 = 1").select("video_id", "no", F.concat(F.lit("Seed "), "brand").alias("canonical"), F.array("brand", F.lower("type")).alias("aliases"))
    return records, glossary, observed, seeds


def build_aliases(spark: SparkSession, d: str) -> DataFrame:
    return N.build_aliases(*alias_tables(spark, d))


#: The tables of a review in one film's terms: every turn is a segment, a scene and a decision, three turns are an event.
REVIEW = {
    "videos": """SELECT video_id, CAST(video_id % 3 + 1 AS BIGINT) AS minutes, CASE WHEN video_id % 2 = 0 THEN 'story' ELSE 'fast' END AS style, CASE WHEN video_id % 4 = 1 THEN CAST(80 + video_id % 20 AS DOUBLE) END AS coherence,
  CASE WHEN video_id % 4 = 1 THEN CAST(70 + video_id % 30 AS DOUBLE) END AS style_score, CASE WHEN video_id % 4 = 1 THEN video_id % 8 = 1 END AS logic_passed, CASE WHEN video_id % 4 = 1 THEN video_id % 3 > 0 END AS style_passed FROM {film} GROUP BY video_id""",
    "segments": """SELECT f.video_id, f.cue_no AS seq, CAST(floor(f.cue_no / 3) AS BIGINT) AS event_no, CASE WHEN f.video_id % 5 = 2 AND f.cue_no = 4 THEN 'odd' WHEN f.cue_no = 0 THEN 'hook' WHEN f.cue_no * 4 <= n THEN 'context' WHEN f.cue_no * 3 <= n * 2 THEN 'conflict'
  WHEN f.cue_no * 20 <= n * 17 THEN 'climax' ELSE 'resolution' END AS story_role, concat(CASE WHEN f.video_id % 3 = 1 AND f.cue_no % 7 = 2 THEN 'Sau đó, ' WHEN f.video_id % 7 = 4 AND f.cue_no BETWEEN 5 AND 7 THEN 'Tuy nhiên ' ELSE '' END, text) AS narration, f.cue_no % 13 <> 4 AS supported
  FROM {film} f JOIN (SELECT video_id, count(*) AS n FROM {film} GROUP BY video_id) k ON k.video_id = f.video_id""",
    "events": """SELECT video_id, CAST(floor(cue_no / 3) AS BIGINT) AS event_no, CAST(floor(cue_no / 3) + CASE WHEN video_id % 6 = 5 AND floor(cue_no / 3) = 2 THEN 40 ELSE 0 END AS BIGINT) AS order_index, min(start_ms) AS start_ms, floor(cue_no / 3) % 5 <> 3 OR video_id % 2 = 0 AS verified
  FROM {film} GROUP BY video_id, floor(cue_no / 3)""",
    "scenes": """SELECT video_id, cue_no AS scene_id, start_ms, end_ms, CAST(cue_no % 3 AS BIGINT) AS n_evidence, cue_no % 10 < 8 AS usable, CASE WHEN video_id % 2 = 1 AND cue_no % 4 = 1 THEN 'Unknown' ELSE 'Ann' END AS one FROM {film}""",
    "decisions": """SELECT f.video_id, f.cue_no AS seq, CAST(floor(f.cue_no / 3) AS BIGINT) AS event_no, f.cue_no AS scene_id, CASE WHEN f.video_id % 3 = 0 AND c.start_ms IS NOT NULL THEN f.start_ms ELSE CAST(c.start_ms AS BIGINT) END AS start_ms, CASE WHEN f.video_id % 3 = 0 AND c.score IS NOT NULL THEN 0.9 ELSE c.score END AS match_score
  FROM {film} f LEFT JOIN (SELECT * FROM {clips} WHERE pos = 0) c ON c.video_id = f.video_id AND c.seq = f.cue_no""",
}


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    f = film(spark, d)
    tables = {"film": f, "clips": spark.sql(CLIPS, film=f)}
    t = {k: spark.sql(q, **{x: v for x, v in tables.items() if f"{{{x}}}" in q}) for k, q in REVIEW.items()}
    t["scenes"] = t["scenes"].withColumn("characters", F.array("one", F.lit("Bo")))
    r = Q.quality_report(t["videos"], t["segments"], t["events"], t["scenes"], t["decisions"])
    codes = F.array_join(F.array_sort(F.transform("issues", lambda x: F.concat_ws(":", x["severity"], x["code"], x["seq"].cast("string")))), ",")
    return r.select("video_id", *[micro(k).alias(k) for k in ("overall", *REPORT_WEIGHTS)], "passed", "meets_budget", "n_words", "n_sentences", F.md5(codes).alias("issues_md5"))


QUERIES = {f.__name__: f for f in (align_beats, replace_weak, repair_edit, caption_sync, balance_events, build_aliases, quality_report)}

_F = f"film AS ({FILM.format(conversations='conversations')})"
_B = f"beats AS ({BEATS.format(film='film')}), dur AS (SELECT video_id, max(end_ms) + 5000 AS duration_ms FROM film GROUP BY 1)"
_CL = f"clips AS ({CLIPS.format(film='film')})"


def _whole(source: str, keys: str, name: str) -> str:
    """Term weights in whole numbers, 20 for a term and 27 for a pair."""
    return f"""{name}_t AS (SELECT {keys}, {_TERMS} AS t FROM {source}),
{name}_e AS (SELECT {keys}, unnest(t) AS term, 20 AS w FROM {name}_t UNION ALL SELECT {keys}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])), 27 FROM {name}_t),
{name} AS (SELECT {keys}, term, sum(w)::BIGINT AS w FROM {name}_e GROUP BY ALL), {name}_n AS (SELECT {keys}, sum(w * w)::BIGINT AS n2 FROM {name} GROUP BY ALL)"""


ORACLE_SQL = {
    "align_beats": f"""WITH RECURSIVE {_F}, {_B},
z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cue_no) AS r, max(cue_no) OVER (PARTITION BY video_id) AS last FROM film WHERE trim(text) <> ''),
win AS (SELECT a.video_id, a.cue_no AS start_no, b.cue_no AS end_no, a.start_ms, b.end_ms, string_agg(c.text, ' ' ORDER BY c.r) AS text
  FROM z a JOIN z b ON b.video_id = a.video_id AND b.r BETWEEN a.r AND a.r + 7 JOIN z c ON c.video_id = a.video_id AND c.r BETWEEN a.r AND b.r
  WHERE b.end_ms - a.start_ms >= 5000 OR b.cue_no = b.last GROUP BY ALL HAVING max(c.start_ms) - a.start_ms <= 42000),
{_whole('beats', 'video_id, beat_no', 'x')}, {_whole('win', 'video_id, start_no, end_no, start_ms, end_ms', 'y')},
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY beat_no) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n, duration_ms / 1000.0::DOUBLE AS d,
  CASE WHEN hint_start_ms >= 0 THEN hint_start_ms / 1000.0::DOUBLE END AS h0, CASE WHEN hint_end_ms > hint_start_ms THEN hint_end_ms / 1000.0::DOUBLE ELSE hint_start_ms / 1000.0::DOUBLE + 18 END AS h1 FROM beats JOIN dur USING (video_id)),
p AS (SELECT *, d * (i / greatest(n - 1, 1)) AS even FROM b),
dot AS (SELECT x.video_id, beat_no, start_no, end_no, start_ms, end_ms, sum(x.w * y.w) AS dot FROM x JOIN y USING (video_id, term) GROUP BY ALL),
c0 AS (SELECT dot.*, dot / (sqrt(x_n.n2) * sqrt(y_n.n2)) AS cosine, i, n, d, even, coalesce(h0, even) AS pref, greatest(90000.0::DOUBLE, duration_ms * 0.18::DOUBLE) AS sigma
  FROM dot JOIN x_n USING (video_id, beat_no) JOIN y_n USING (video_id, start_no, end_no, start_ms, end_ms) JOIN p USING (video_id, beat_no)),
c AS (SELECT *, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e, cosine * 0.56::DOUBLE + exp(-pow(abs(start_ms - pref * 1000) / sigma, 2)) * 0.14::DOUBLE + exp(-pow(abs(start_ms - even * 1000) / sigma, 2)) * 0.26::DOUBLE
  + CASE WHEN end_ms - start_ms BETWEEN 8000 AND 36000 THEN 1 ELSE 0.75::DOUBLE END * 0.04::DOUBLE AS score FROM c0 WHERE start_ms / 1000.0::DOUBLE <= d * least(1, (i + 4) / n) + 30 OR cosine >= 0.55),
f(video_id, i, beat_no, last, s, e, score, source) AS (
  SELECT DISTINCT video_id, -1::BIGINT, -1::BIGINT, -1::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, '' FROM beats
  UNION ALL
  SELECT video_id, i, beat_no, greatest(last, s), s, greatest(s + 3, least(e, d)), score, source FROM (
    SELECT * REPLACE (greatest(0, least(s, greatest(0, d - 1))) AS s) FROM (
      SELECT * REPLACE (CASE WHEN near THEN least(greatest(0, d - 3), last + 6) ELSE s END AS s, CASE WHEN near THEN greatest(e, least(greatest(0, d - 3), last + 6) + 3) ELSE e END AS e) FROM (
        SELECT *, last >= 0 AND s <= last + 6 AS near FROM (
          SELECT video_id, i, beat_no, last, d, CASE WHEN best.score >= 0.08 THEN best.s WHEN h0 IS NOT NULL THEN h0 ELSE least(room, room * i / greatest(n - 1, 1)) END AS s,
            CASE WHEN best.score >= 0.08 THEN best.e WHEN h0 IS NOT NULL THEN h1 ELSE least(room, room * i / greatest(n - 1, 1)) + wide END AS e,
            CASE WHEN best.score >= 0.08 THEN best.score ELSE 0 END AS score, CASE WHEN best.score >= 0.08 THEN 'transcript_match' WHEN h0 IS NOT NULL THEN 'ai_hint' ELSE 'chronological_fallback' END AS source
          FROM (SELECT *, greatest(0, d - wide) AS room FROM (
            SELECT f.video_id, p.i, p.beat_no, f.last, p.d, p.n, p.h0, p.h1, least(24, greatest(8, p.d / greatest(p.n * 3, 1))) AS wide, arg_max({{'s': c.s, 'e': c.e, 'score': c.score}}, (c.score, -c.start_no, -c.end_no)) AS best
            FROM f JOIN p ON p.video_id = f.video_id AND p.i = f.i + 1 LEFT JOIN c ON c.video_id = p.video_id AND c.beat_no = p.beat_no AND c.s >= CASE WHEN f.last < 0 THEN 0 ELSE least(p.d, f.last + 6) END
            GROUP BY f.video_id, p.i, p.beat_no, f.last, p.d, p.n, p.h0, p.h1)))))))
SELECT video_id, beat_no, floor(s * 1000 + 0.5)::BIGINT AS start_ms, floor(e * 1000 + 0.5)::BIGINT AS end_ms, floor(score * 10000 + 0.5)::BIGINT AS score_e4, source FROM f WHERE i >= 0""",
    "replace_weak": f"""WITH RECURSIVE {_F}, {_CL}, now AS (SELECT f.video_id, f.cue_no AS seq, candidate_id, c.start_ms, score FROM film f LEFT JOIN (SELECT * FROM clips WHERE pos = 0) c ON c.video_id = f.video_id AND c.seq = f.cue_no),
d AS (SELECT n.*, (SELECT arg_min(m.start_ms, m.seq) FROM now m WHERE m.video_id = n.video_id AND m.seq > n.seq AND m.start_ms IS NOT NULL) AS nxt FROM now n),
f(video_id, seq, candidate_id, start_ms, score, replaced) AS (
  SELECT DISTINCT video_id, -1::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, FALSE FROM film
  UNION ALL
  SELECT video_id, seq, CASE WHEN best IS NULL THEN candidate_id ELSE best.id END, CASE WHEN best IS NULL THEN start_ms ELSE best.s END, CASE WHEN best IS NULL THEN score ELSE best.score END, best IS NOT NULL FROM (
    SELECT d.video_id, d.seq, d.candidate_id, d.start_ms, d.score, arg_min({{'id': a.candidate_id, 's': a.start_ms, 'score': a.score}}, (-a.score, a.pos)) FILTER (a.candidate_id IS NOT NULL) AS best
    FROM f JOIN d ON d.video_id = f.video_id AND d.seq = f.seq + 1
    LEFT JOIN clips a ON a.pos > 0 AND a.video_id = d.video_id AND a.seq = d.seq AND d.score < 0.75 AND a.score >= 0.75 AND a.supports AND a.candidate_id <> d.candidate_id
      AND (f.start_ms IS NULL OR a.start_ms + 250 >= f.start_ms) AND (d.nxt IS NULL OR a.start_ms <= d.nxt + 250)
    GROUP BY ALL))
SELECT video_id, seq, candidate_id, start_ms, floor(score * 1000000 + 0.5)::BIGINT AS score, replaced FROM f WHERE seq >= 0""",
    "repair_edit": rf"""WITH RECURSIVE {_F}, {_CL}, t AS (SELECT video_id, count(*) AS n, sum(len(regexp_extract_all(text, '[\pL\pN\pM_]+')))::BIGINT AS words, (video_id % 3 + 1) * 205 AS target FROM film GROUP BY ALL),
w AS (SELECT *, CASE WHEN words > round_even(target * 1.15, 0) THEN greatest(6, least(n, round_even(target / greatest(1.0, words / n), 0)))::BIGINT ELSE n END AS wanted FROM t),
k AS (SELECT DISTINCT video_id, CASE WHEN wanted >= n THEN i ELSE round_even(i * (n - 1) / (wanted - 1), 0)::BIGINT END AS seq FROM w, range(1000000) r(i) WHERE i < least(n, wanted)),
kept AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS new_seq FROM k),
pool AS (SELECT video_id, seq, candidate_id, min(pos) AS at, max(score) AS score, arg_min(start_ms, (-score, pos)) AS start_ms, arg_min(pos, (-score, pos)) AS pos FROM clips GROUP BY ALL),
f(video_id, seq, new_seq, last, candidate_id, start_ms, score, replaced) AS (
  SELECT DISTINCT video_id, -1::BIGINT, 0::BIGINT, -1e18::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, FALSE FROM film
  UNION ALL
  SELECT video_id, seq, new_seq, coalesce(took.s::DOUBLE, last), took.id, took.s, took.score, took IS NOT NULL AND (cur IS NULL OR took.id <> cur.id) FROM (
    SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN best IS NOT NULL THEN best ELSE cur END AS took FROM (
      SELECT j.video_id, j.seq, j.new_seq, j.last, j.cur, arg_min({{'id': p.candidate_id, 's': p.start_ms, 'score': p.score}}, (-p.score, p.start_ms, p.at)) FILTER (p.candidate_id IS NOT NULL) AS best,
        any_value({{'id': p.candidate_id, 's': p.start_ms, 'score': p.score}}) FILTER (p.pos = 0 AND p.score >= 0.75) AS own
      FROM (SELECT k.*, f.last, CASE WHEN c.candidate_id IS NOT NULL THEN {{'id': c.candidate_id, 's': c.start_ms, 'score': c.score}} END AS cur FROM f JOIN kept k ON k.video_id = f.video_id AND k.new_seq = f.new_seq + 1 LEFT JOIN (SELECT * FROM clips WHERE pos = 0) c ON c.video_id = k.video_id AND c.seq = k.seq) j
      LEFT JOIN pool p ON p.video_id = j.video_id AND p.seq = j.seq AND p.start_ms + 250 >= j.last GROUP BY ALL)))
SELECT video_id, seq, new_seq, candidate_id, start_ms, floor(score * 1000000 + 0.5)::BIGINT AS score, replaced FROM f WHERE new_seq > 0""",
    "quality_report": rf"""WITH {_F}, {_CL}, {', '.join(f"{k} AS ({q.format(film='film', clips='clips')})" for k, q in REVIEW.items())},
bu AS (SELECT *, minutes * 205 AS target, round_even(minutes * 205 * 0.9, 0) AS lo_w, round_even(minutes * 205 * 1.15, 0) AS hi_w, greatest(8, round_even(minutes * 205 / CASE style WHEN 'story' THEN 16.0 ELSE 14.0 END, 0)) AS n_seg FROM videos),
sg AS (SELECT *, len(regexp_extract_all(narration, '[\pL\pN\pM_]+')) AS words, len(list_filter(string_split(regexp_replace(narration, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sents,
  regexp_replace(lower(regexp_extract(narration, '(?i)^\s*["''“”‘’(\[]*\s*({OPENERS})(?:$|[^\pL\pN_])', 1)), '\s+', ' ', 'g') AS marker FROM segments),
mk AS (SELECT video_id, seq, marker, lead(marker) OVER w AS m1, lead(marker, 2) OVER w AS m2, count(*) OVER (PARTITION BY video_id) AS n, count(*) OVER (PARTITION BY video_id, marker) AS k FROM sg WINDOW w AS (PARTITION BY video_id ORDER BY seq)),
li AS (SELECT video_id, bool_or(n >= 4 AND marker <> '' AND (k > greatest(2, floor(n * 0.1)) OR coalesce(m1 = marker AND m2 = marker, FALSE))) AS listed FROM mk GROUP BY 1),
sw AS (SELECT video_id, count(*) AS n_seg_rows, sum(words)::BIGINT AS n_words, sum(sents)::BIGINT AS n_sentences FROM sg GROUP BY 1),
ro AS (SELECT *, coalesce(list_position(['hook', 'context', 'conflict', 'climax', 'resolution'], story_role), 999) AS pl FROM sg), rn AS (SELECT *, lead(pl) OVER (PARTITION BY video_id ORDER BY seq) AS nx FROM ro), rd AS (SELECT video_id, bool_and(nx IS NULL OR pl <= nx) AS ordered FROM rn GROUP BY 1),
ev AS (SELECT *, bool_or(verified) OVER (PARTITION BY video_id) AS any_ok FROM events), et AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM ev WHERE verified OR NOT any_ok WINDOW w AS (PARTITION BY video_id ORDER BY order_index, start_ms, event_no)),
need AS (SELECT DISTINCT video_id, CASE WHEN i = 0 THEN 'hook' WHEN i = n - 1 THEN 'resolution' WHEN i / (n - 1) <= 0.25 THEN 'context' WHEN i / (n - 1) <= 0.65 THEN 'conflict' WHEN i / (n - 1) <= 0.85 THEN 'climax' ELSE 'resolution' END AS role FROM et),
wh AS (SELECT video_id, bool_and((video_id, role) IN (SELECT (video_id, story_role) FROM segments)) AS whole FROM need GROUP BY 1),
de AS (SELECT d.*, coalesce(e.order_index, 999999) AS ord FROM decisions d LEFT JOIN events e USING (video_id, event_no)), dn AS (SELECT *, lead(ord) OVER (PARTITION BY video_id ORDER BY seq) AS nx FROM de),
cn AS (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY seq) AS nx FROM decisions WHERE start_ms IS NOT NULL),
ah AS (SELECT v.video_id, NOT EXISTS (SELECT 1 FROM dn WHERE dn.video_id = v.video_id AND ord > nx) AND NOT EXISTS (SELECT 1 FROM cn WHERE cn.video_id = v.video_id AND start_ms > nx + 250) AS ahead FROM videos v),
di AS (SELECT video_id, count(*) FILTER (match_score >= 0.75) AS good FROM cn GROUP BY 1),
vf AS (SELECT video_id, 100.0::DOUBLE * count(*) FILTER (verified) / count(*) AS evidence, bool_and(NOT verified OR (video_id, event_no) IN (SELECT (video_id, event_no) FROM segments)) AS all_told FROM events GROUP BY 1),
ch AS (SELECT video_id, CASE WHEN count(*) FILTER (upper(one) = 'UNKNOWN') = 0 THEN 100 ELSE greatest(60, 100 - 4.0::DOUBLE * count(*) FILTER (upper(one) = 'UNKNOWN') / (2 * count(*))) END AS character FROM scenes GROUP BY 1),
us AS (SELECT s.*, row_number() OVER (PARTITION BY s.video_id ORDER BY start_ms, end_ms, scene_id) - 1 AS i, count(*) OVER (PARTITION BY s.video_id) AS n, minutes, (s.video_id, scene_id) IN (SELECT (video_id, scene_id) FROM cn) AS chosen FROM scenes s JOIN videos USING (video_id) WHERE usable AND n_evidence > 0),
ub AS (SELECT *, least(n, greatest(4, least(minutes * 4, n))) AS b FROM us), uc AS (SELECT *, CASE WHEN i < n % b * (n // b + 1) THEN i // (n // b + 1) ELSE n % b + (i - n % b * (n // b + 1)) // (n // b) END AS run FROM ub),
co AS (SELECT video_id, round_even(coalesce(least(100, 100 * (count(DISTINCT run) FILTER (chosen) / any_value(b) * 0.65::DOUBLE + least(1, greatest(0, (max(end_ms) FILTER (chosen) - min(start_ms) FILTER (chosen)) / (max(end_ms) - min(start_ms)))) * 0.35::DOUBLE)), 0), 2) AS coverage FROM uc GROUP BY 1),
p AS (SELECT bu.*, n_words, n_sentences, n_seg_rows, listed, ordered, coalesce(whole, TRUE) AS whole, ahead, all_told, 100.0::DOUBLE * coalesce(good, 0) / n_seg_rows AS direct, CASE WHEN ahead THEN 100.0 ELSE 60.0 END AS chronology, evidence, character,
  greatest(0, 100 - abs(n_words - target) / target * 250.0::DOUBLE) AS duration, least(CASE WHEN NOT ordered THEN 30 WHEN coalesce(whole, TRUE) THEN 100 ELSE 60 END, coalesce(coherence, 100)) AS story, coalesce(coverage, 0) AS coverage, CASE WHEN listed THEN least(84, coalesce(style_score, 100)) ELSE coalesce(style_score, 100) END AS style_part
  FROM bu JOIN sw USING (video_id) JOIN li USING (video_id) JOIN rd USING (video_id) LEFT JOIN wh USING (video_id) JOIN ah USING (video_id) LEFT JOIN di USING (video_id) JOIN vf USING (video_id) JOIN ch USING (video_id) LEFT JOIN co USING (video_id)),
o AS (SELECT *, {' + '.join(f"{'style_part' if k == 'style' else k}::DECIMAL(12,6) * {w}" for k, w in REPORT_WEIGHTS.items())} AS total FROM p),
iss AS (SELECT s.video_id, 'error:' || CASE WHEN start_ms IS NULL THEN 'NO_CLIP' WHEN match_score < 0.75 THEN 'LOW_VISUAL_MATCH' ELSE 'UNSUPPORTED_NARRATION' END || ':' || s.seq AS x FROM segments s LEFT JOIN decisions d USING (video_id, seq) WHERE start_ms IS NULL OR match_score < 0.75 OR NOT supported
  UNION ALL SELECT video_id, unnest(list_filter([CASE WHEN NOT ahead THEN 'error:CHRONOLOGY' END, CASE WHEN evidence < 95 THEN 'warning:UNVERIFIED_EVENT' END, CASE WHEN n_words NOT BETWEEN lo_w AND hi_w THEN 'error:NARRATION_DURATION_MISMATCH' END, CASE WHEN NOT (whole AND ordered) THEN 'error:STORY_ARC_INCOMPLETE' END,
    CASE WHEN NOT logic_passed THEN 'error:NARRATIVE_LOGIC' END, CASE WHEN NOT style_passed THEN 'error:STYLE_MISMATCH' END, CASE WHEN listed THEN 'error:REPETITIVE_TRANSITIONS' END, CASE WHEN coverage < 85 THEN 'error:SOURCE_COVERAGE' END], lambda x: x IS NOT NULL)) FROM p),
il AS (SELECT video_id, string_agg(x, ',' ORDER BY x) AS codes, bool_or(x LIKE 'error%') AS bad FROM iss GROUP BY 1)
SELECT video_id, cast(floor(round_even(total, 2)::DOUBLE * 1000000 + 0.5) AS BIGINT) AS overall, {', '.join(f"cast(floor(round_even({'style_part' if k == 'style' else k}::DECIMAL(12,6), 2)::DOUBLE * 1000000 + 0.5) AS BIGINT) AS {k}" for k in REPORT_WEIGHTS)},
  total >= 90 AND NOT coalesce(bad, FALSE) AS passed, n_words BETWEEN lo_w AND hi_w AND n_sentences BETWEEN greatest(6, floor(n_seg * 0.8)) AND greatest(10, ceil(n_seg * 1.2)) AND whole AND all_told AS meets_budget, n_words, n_sentences, md5(coalesce(codes, '')) AS issues_md5
FROM o LEFT JOIN il USING (video_id)""",
}
