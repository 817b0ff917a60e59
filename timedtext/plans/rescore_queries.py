"""Queries over scores that are taken again, and over cues that are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.scores import micro
from ..operators import rescoring as R
from ..operators import splitting
from . import views as V


def _part(k: int) -> str:
    """A score of 60 to 100 of each part number."""
    return f"60 + (p_partkey * {2 * k + 3} + p_size * {k + 1}) % 41"


_PARTS = ("chronology", "evidence", "character", "story", "coverage", "style", "timeline", "readability", "sync", "duration")


def _videos(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("video_id"), "p_size", "p_retailprice", *[F.expr(_part(k)).cast("double").alias(n) for k, n in enumerate(_PARTS)])


def dubbing_baselines(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("video_id")
    s = _videos(spark, d).withColumns({
        "subtitles_expected": v % 5 > 0, "translation_required": v % 3 > 0, "narration_expected": v % 2 == 0, "media_ok": v % 7 > 1, "has_video": F.when(v % 4 > 0, v % 4 > 1),
        "has_audio": F.when(v % 9 > 0, v % 9 > 3), "source_count": v % 6, "target_count": F.col("p_size"), "n_empty": F.least(F.col("p_size"), v % 8),
    })
    return R.dubbing_baselines(s).select("video_id", "key", micro("baseline").alias("baseline_micro"))


def _post_render(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Line items of a part as segments; one verdict in five is of a segment that no video has, and some are not plain."""
    li = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("video_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), "l_orderkey", "l_suppkey", "l_quantity")
    li = li.groupBy("video_id", "seq", "l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("q"))
    seg = li.select("video_id", "seq", F.when(F.col("l_suppkey") % 6 > 0, 0.70 + F.col("q") / 200).alias("match_score"))
    judged = li.select("video_id", F.expr("if(l_orderkey % 5 = 0, -seq - 1, seq)").alias("seq"), (0.6 + F.col("q") / 125).alias("score"), F.when(F.col("l_suppkey") % 4 > 0, F.col("q") > 4).alias("direct_match"))
    black = li.where("(l_orderkey + l_suppkey) % 97 = 0").select("video_id", "seq")
    v = _videos(spark, d).withColumn("minutes", (F.col("p_size") % 9).cast("int"))
    v = v.withColumn("measured_s", F.greatest(F.lit(1), "minutes") * 60.0 + F.col("video_id") % 13 - 6).withColumn("expected_s", F.col("measured_s") + (F.col("video_id") % 10) / 4)
    return R.post_render_report(v, R.rendered_scores(seg, judged, black))


def post_render_report(spark: SparkSession, d: str) -> DataFrame:
    r, _ = _post_render(spark, d)
    return r.select("video_id", micro("overall").alias("overall_micro"), micro("direct").alias("direct_micro"), micro("chronology").alias("chronology_micro"), micro("duration").alias("duration_micro"), "n_mismatches", "passed")


def post_render_issues(spark: SparkSession, d: str) -> DataFrame:
    return _post_render(spark, d)[1]


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents in the role of edited scripts: their sentences are the beats."""
    docs = V.table(spark, d, "documents").where("doc_id is not null")
    k = F.col("video_id")
    s = docs.select(F.col("doc_id").alias("video_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?…]+[.!?…]*"), F.lit(0))).alias("seq", "narration"))
    n = F.col("seq")
    beats = s.select("video_id", n.cast("long").alias("seq"), "narration", F.when((k + n) % 9 > 0, 1 - (k * 3 + n) % 50 / 180).alias("match_score"), F.when((k + n) % 7 > 0, n * 1000 - F.when((k % 4 == 0) & (n % 11 == 10), 5000).otherwise(0)).alias("start_ms"))
    old = s.where("(video_id + seq) % 3 = 0").select("video_id", n.cast("long").alias("seq"), F.when((k + n) % 2 == 0, "error").otherwise("warning").alias("severity"), F.element_at(F.array(*map(F.lit, (*_ISSUES,))), ((k + n) / 3 % len(_ISSUES) + 1).cast("int")).alias("code"))
    part = lambda f: (F.lit(70) + (k * f) % 31).cast("double")
    v = docs.select(F.col("doc_id").alias("video_id")).withColumns({
        "minutes": (k % 4).cast("int"), "wanted_style": F.when(k % 2 == 0, "fast").otherwise("story"), "evidence": part(3), "character": part(5), "story": part(7), "coverage": part(11), "style": part(13),
        "edited_seq": F.when(k % 3 > 0, k % 5), "reassessed": F.when(k % 5 > 0, k % 5 > 2),
    })
    return R.rescore_after_edit(v, beats, old)


_ISSUES = ("NO_CLIP", "CHRONOLOGY", "POST_RENDER_VISUAL_MISMATCH", "NARRATIVE_LOGIC", "SOURCE_COVERAGE", "STYLE_MISMATCH", "UNVERIFIED_EVENT", "LOW_VISUAL_MATCH", "OTHER")


def edit_report(spark: SparkSession, d: str) -> DataFrame:
    r, _ = _edited(spark, d)
    return r.select("video_id", micro("overall").alias("overall_micro"), micro("direct").alias("direct_micro"), "chronology", micro("duration").alias("duration_micro"), "passed", "may_render")


def edit_issues(spark: SparkSession, d: str) -> DataFrame:
    return _edited(spark, d)[1]


def refresh_requirements(spark: SparkSession, d: str) -> DataFrame:
    """The document before is the scene of each document: its words are what is seen."""
    docs = V.table(spark, d, "documents").where("doc_id is not null")
    seg = docs.select((F.col("doc_id") % 40).alias("video_id"), F.col("doc_id").alias("seq"), (F.col("doc_id") - 1).alias("scene_id"), F.col("text").alias("narration"))
    w = F.split("text", " ")
    phrase = lambda m: F.transform(F.filter(w, lambda x, i: i % 9 == m), lambda x: x)
    lines = F.split("text", "\n")
    scenes = docs.select(((F.col("doc_id") + 1) % 40).alias("video_id"), F.col("doc_id").alias("scene_id"), phrase(1).alias("characters"), lines.alias("actions"), phrase(4).alias("objects"), F.get(lines, F.lit(0)).alias("location"))
    out = R.refresh_requirements(seg, scenes)
    digest = lambda c: F.md5(F.array_join(c, "|")).alias(f"{c}_md5")
    return out.select("video_id", "seq", *[digest(c) for c in ("characters", "actions", "objects", "locations")])


def split_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues of the conversations in parts of at most 42 characters and 3.2 s."""
    out = splitting.split_cues(V.cues(spark, d))
    return out.select("video_id", "cue_no", "source_no", "start_ms", "end_ms", F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (dubbing_baselines, post_render_report, post_render_issues, edit_report, edit_issues, refresh_requirements, split_cues)}

_MICRO = "cast(floor({} * 1000000 + 0.5) AS BIGINT)"
_V = "v AS (SELECT p_partkey AS video_id, p_size, " + ", ".join(f"({_part(k)})::DOUBLE AS {n}" for k, n in enumerate(_PARTS)) + " FROM part)"


def _sum(parts: str) -> str:
    """Weighted parts in units of 1e-8."""
    p = parts.split()
    return " + ".join(f"{w} * cast(cast({c} AS DECIMAL(18,6)) * 1000000 AS BIGINT)" for c, w in zip(p[::2], p[1::2]))


#: Millionths of a total that is rounded to two places, halves to the even one.
_ROUNDED = "(({0}) // 1000000 + CASE WHEN ({0}) % 1000000 > 500000 OR (({0}) % 1000000 = 500000 AND ({0}) // 1000000 % 2 = 1) THEN 1 ELSE 0 END) * 10000"
_CLAMP = "least(100, greatest(0, {}))"
_DUB = f"""{_V}, s AS (SELECT *, video_id % 5 > 0 AS subs, CASE WHEN video_id % 4 > 0 THEN video_id % 4 > 1 END AS pic, CASE WHEN video_id % 9 > 0 THEN video_id % 9 > 3 END AS snd,
  100.0::DOUBLE * (1 - least(p_size, video_id % 8) / greatest(p_size, 1)) AS e FROM v),
t AS (SELECT *, timeline * 0.45::DOUBLE + CASE WHEN video_id % 6 > 0 THEN timeline ELSE 45 END * 0.35::DOUBLE + e * 0.2::DOUBLE AS c, e * 0.45::DOUBLE + timeline * 0.3::DOUBLE + readability * 0.25::DOUBLE AS h,
  duration * 0.55::DOUBLE + CASE WHEN video_id % 7 > 1 THEN 25 ELSE 0 END + CASE WHEN pic IS NULL THEN 70 ELSE CASE WHEN pic THEN 55 ELSE 0 END + CASE WHEN snd THEN 45 ELSE 0 END END * 0.2::DOUBLE AS q FROM s),
u AS (SELECT video_id, [CASE WHEN subs THEN c ELSE 100 END, CASE WHEN subs AND video_id % 3 > 0 THEN least(c, 60) ELSE 100 END, sync, CASE WHEN subs THEN h ELSE 100 END, CASE WHEN video_id % 2 = 0 AND snd = FALSE THEN least(q, 50) ELSE q END, 100] AS b FROM t)"""
_POST = f"""{_V}, one AS (SELECT l_partkey, l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3), li AS (SELECT l_partkey AS video_id, l_orderkey * 8 + l_linenumber AS seq, l_orderkey % 5 > 0 AS judged, 0.6::DOUBLE + l_quantity / 125 AS s, coalesce(CASE WHEN l_suppkey % 4 > 0 THEN l_quantity > 4 END, 0.6::DOUBLE + l_quantity / 125 >= 0.75::DOUBLE) AS d,
  CASE WHEN l_suppkey % 6 > 0 THEN 0.7::DOUBLE + l_quantity / 200 ELSE 0 END AS old, (l_orderkey + l_suppkey) % 97 = 0 AS black FROM one),
g AS (SELECT video_id, seq, CASE WHEN black THEN 0 WHEN NOT judged THEN old WHEN d THEN greatest(0.75::DOUBLE, s) ELSE least(0.74::DOUBLE, s) END AS score, NOT black AND CASE WHEN judged THEN d ELSE old >= 0.75::DOUBLE END AS direct FROM li),
h AS (SELECT video_id, count(*) FILTER (score >= 0.75::DOUBLE) AS good, count(*) AS n, count(*) FILTER (NOT (score >= 0.75::DOUBLE AND direct)) AS bad FROM g GROUP BY 1),
m AS (SELECT *, greatest(1, p_size % 9) * 60.0::DOUBLE AS want, greatest(1, p_size % 9) * 60.0::DOUBLE + video_id % 13 - 6 AS got, (video_id % 10) / 4 AS drift FROM v),
r AS (SELECT m.* EXCLUDE (chronology, duration), 100.0::DOUBLE * coalesce(good, 0) / coalesce(n, 1) AS direct, coalesce(bad, 0) AS bad, least(chronology, CASE WHEN drift <= 0.5 THEN 100 ELSE greatest(0, 100 - drift * 15) END) AS chronology, round_even(greatest(0, 100 - abs(got - want) / want * 250), 2) AS duration, abs(got - want) / want <= 0.1::DOUBLE AS ok FROM m LEFT JOIN h USING (video_id)),
z AS (SELECT *, {_sum("direct 43 chronology 16 evidence 9 character 6 duration 10 story 7 coverage 5 style 4")} AS total FROM r)"""
_SENT = r"regexp_extract_all(text, '[^.!?…]+[.!?…]*', 0)"
_W = r"len(regexp_extract_all(narration, '[\pL\pN\pM_]+', 0))"
_CODES = "[" + ", ".join(f"'{c}'" for c in _ISSUES) + "]"
_EDIT = rf"""x AS (SELECT doc_id AS k, unnest({_SENT}) AS narration, generate_subscripts({_SENT}, 1) - 1 AS n FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT k AS video_id, n AS seq, {_W} AS words, CASE WHEN (k + n) % 9 > 0 THEN 1 - ((k * 3 + n) % 50) / 180 END AS score, CASE WHEN (k + n) % 7 > 0 THEN n * 1000 - CASE WHEN k % 4 = 0 AND n % 11 = 10 THEN 5000 ELSE 0 END END AS start FROM x),
a AS (SELECT video_id, seq, start, lag(start) OVER (PARTITION BY video_id ORDER BY seq) AS last FROM b WHERE start IS NOT NULL),
c AS (SELECT video_id, bool_or(coalesce(last > start + 250, FALSE)) AS back FROM a GROUP BY 1),
g AS (SELECT video_id, count(*) FILTER (score >= 0.75::DOUBLE) AS good, count(*) AS n, sum(words) AS words FROM b GROUP BY 1),
v AS (SELECT doc_id AS video_id, doc_id AS k, greatest(1, doc_id % 4) * 205 AS target, (70 + doc_id * 3 % 31)::DOUBLE AS evidence, (70 + doc_id * 5 % 31)::DOUBLE AS character, (70 + doc_id * 7 % 31)::DOUBLE AS story, (70 + doc_id * 11 % 31)::DOUBLE AS coverage, (70 + doc_id * 13 % 31)::DOUBLE AS style,
  CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 END AS edited, doc_id % 5 > 2 AS again FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT v.*, 100.0::DOUBLE * coalesce(good, 0) / coalesce(n, 1) AS direct, CASE WHEN coalesce(back, FALSE) THEN 60.0::DOUBLE ELSE 100 END AS chronology, coalesce(words, 0) AS words, greatest(0, 100 - abs(coalesce(words, 0) - target) / target * 250) AS duration FROM v LEFT JOIN g USING (video_id) LEFT JOIN c USING (video_id)),
i AS (SELECT k AS video_id, n AS seq, CASE WHEN (k + n) % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, {_CODES}[((k + n) // 3) % {len(_ISSUES)} + 1] AS code FROM x WHERE (k + n) % 3 = 0),
kept AS (SELECT i.* FROM i JOIN v USING (video_id) WHERE code NOT IN ('LOW_VISUAL_MATCH', 'CHRONOLOGY') AND NOT (code = 'POST_RENDER_VISUAL_MISMATCH' AND coalesce(seq = edited, FALSE)) AND NOT (again AND code IN ('NARRATIVE_LOGIC', 'STYLE_MISMATCH'))),
low AS (SELECT video_id, 'NARRATIVE_LOGIC' AS code FROM v WHERE story < 85 UNION ALL SELECT video_id, 'SOURCE_COVERAGE' FROM v WHERE coverage < 85 UNION ALL SELECT video_id, 'STYLE_MISMATCH' FROM v WHERE style < 85),
every AS (SELECT * FROM kept UNION ALL SELECT video_id, NULL, 'error', code FROM low WHERE (video_id, code) NOT IN (SELECT (video_id, code) FROM kept)
UNION ALL SELECT video_id, NULL, 'error', 'CHRONOLOGY' FROM r WHERE chronology < 100 UNION ALL SELECT video_id, NULL, 'error', 'NARRATION_DURATION_MISMATCH' FROM r WHERE words NOT BETWEEN round_even(target * 0.9::DOUBLE, 0) AND round_even(target * 1.15::DOUBLE, 0)
UNION ALL SELECT video_id, seq, 'error', 'LOW_VISUAL_MATCH' FROM b WHERE score < 0.75::DOUBLE),
e AS (SELECT video_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'error' AND code NOT IN ('STYLE_MISMATCH', 'UNVERIFIED_EVENT', 'OTHER')) AS hard FROM every GROUP BY 1)"""
_OVER = _sum("direct 38 chronology 16 evidence 12 character 7 duration 8 story 8 coverage 6 style 5")
_TOK = r"list_distinct(regexp_extract_all(strip_accents(lower({})), '[\pL\pN\pM_]{{2,}}', 0))"
_SHARE = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / len({0}) ELSE 0 END"
ORACLE_SQL = {
    "dubbing_baselines": f"WITH {_DUB} SELECT video_id, unnest([{', '.join(repr(k) for k in S.CRITERIA)}]) AS key, {_MICRO.format(_CLAMP.format('unnest(b)'))} AS baseline_micro FROM u",
    "post_render_report": f"WITH {_POST} SELECT video_id, {_ROUNDED.format('total')} AS overall_micro, {_MICRO.format('round_even(direct, 2)')} AS direct_micro, {_MICRO.format('round_even(chronology, 2)')} AS chronology_micro, {_MICRO.format('duration')} AS duration_micro, bad AS n_mismatches, total >= 9000000000 AND bad = 0 AND drift <= 0.5 AND ok AND story >= 85 AND style >= 85 AS passed FROM z",
    "post_render_issues": f"""WITH {_POST} SELECT video_id, seq, 'POST_RENDER_VISUAL_MISMATCH' AS code FROM g WHERE NOT (score >= 0.75::DOUBLE AND direct)
UNION ALL SELECT video_id, NULL, 'VOICE_VIDEO_DRIFT' FROM z WHERE drift > 0.5 UNION ALL SELECT video_id, NULL, 'TARGET_DURATION_MISMATCH' FROM z WHERE NOT ok UNION ALL SELECT video_id, NULL, 'NARRATIVE_LOGIC' FROM z WHERE story < 85 UNION ALL SELECT video_id, NULL, 'STYLE_MISMATCH' FROM z WHERE style < 85""",
    "edit_report": f"WITH {_EDIT} SELECT video_id, {_ROUNDED.format(_OVER)} AS overall_micro, {_MICRO.format('round_even(direct, 2)')} AS direct_micro, chronology, {_MICRO.format('round_even(duration, 2)')} AS duration_micro, {_OVER} >= 9000000000 AND coalesce(errors, 0) = 0 AS passed, coalesce(hard, 0) = 0 AS may_render FROM r LEFT JOIN e USING (video_id)",
    "edit_issues": f"WITH {_EDIT} SELECT video_id, seq, CASE WHEN code IN ('STYLE_MISMATCH', 'UNVERIFIED_EVENT') THEN 'warning' ELSE severity END AS severity, code FROM every",
    "refresh_requirements": f"""WITH d AS (SELECT a.doc_id AS seq, a.text AS narration, lower(a.text) AS said, {_TOK.format('a.text')} AS heard, string_split(b.text, ' ') AS w, string_split(b.text, chr(10)) AS lines FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1),
f AS (SELECT seq, said, heard, lines, list_filter(w, lambda x, i: (i - 1) % 9 = 1 AND contains(said, lower(x))) AS characters, list_filter(w, lambda x, i: (i - 1) % 9 = 4 AND (contains(said, lower(x)) OR {_SHARE.format(_TOK.format('x'), 'heard')} >= 0.8::DOUBLE)) AS objects, {_TOK.format('lines[1]')} AS place FROM d),
l AS (SELECT seq, heard, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM f), m AS (SELECT seq, x, i, {_SHARE.format('heard', _TOK.format('x'))} AS share FROM l WHERE x <> ''), best AS (SELECT seq, arg_max(x, (share, -i)) AS action FROM m WHERE share >= 0.35::DOUBLE GROUP BY 1)
SELECT seq % 40 AS video_id, seq, md5(array_to_string(characters, '|')) AS characters_md5, md5(coalesce(action, '')) AS actions_md5, md5(array_to_string(objects, '|')) AS objects_md5,
  md5(CASE WHEN lines[1] <> '' AND {_SHARE.format('place', 'heard')} >= 0.4::DOUBLE THEN lines[1] ELSE '' END) AS locations_md5 FROM f LEFT JOIN best USING (seq)""",
}
