"""Queries over scenes and quality reports, built from conversations and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import fingerprint, micro
from ..operators import reports as P
from . import views as V

#: Frequent syllables of the test texts, in the role of credit markers and of verbs of speech.
MARKERS = ("tion", "ung", "eau")
VERBS = "the|die|la|of|en"


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    """A document is a scene: its words are dealt in turn to summary, dialogue, actions, seen and heard."""
    s = V.table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.split("text", " ").alias("w"))
    every = lambda r: F.filter("w", lambda x, i: i % 5 == r)
    said = lambda r: F.array_join(every(r), " ")
    none = F.array().cast("array<string>")
    return s.select((F.col("k") % 40).alias("video_id"), F.col("k").alias("scene_id"), (F.col("k") % 3 == 0).alias("credits"), (F.col("k") % 11 == 0).alias("black"), F.when(F.col("k") % 5 < 3, "UNKNOWN").otherwise(said(0)).alias("summary"), F.when(F.col("k") % 4 > 0, "").otherwise(said(1)).alias("dialogue"), F.when(F.col("k") % 2 == 1, F.array(said(2))).otherwise(none).alias("actions"), F.array(said(3)).alias("visual"), F.when(F.col("k") % 7 < 4, F.array(F.lit("unknown"))).otherwise(every(4)).alias("spoken"), F.array(F.lit(" ")).alias("subtitle"))


def credits_only(spark: SparkSession, d: str) -> DataFrame:
    return _scenes(spark, d).select("scene_id", P.is_credits_only(MARKERS).alias("credits_only"))


def usable_scenes(spark: SparkSession, d: str) -> DataFrame:
    return P.usable_scenes(_scenes(spark, d).withColumn("credits", F.col("credits") | (F.col("video_id") < 3)).withColumn("black", F.col("black") | (F.col("video_id") == 5)), MARKERS).select("video_id", "scene_id")


def unsupported_dialogue(spark: SparkSession, d: str) -> DataFrame:
    s = _scenes(spark, d)
    seg = V.table(spark, d, "documents").select((F.col("doc_id") % 40).alias("video_id"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("scene_id"), F.col("text").alias("narration"))
    return P.unsupported_dialogue(seg, s, VERBS)


def untranslated(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d).withColumn("translation", F.when(F.col("cue_no") % 5 == 1, F.lit("  ")).when(F.col("cue_no") % 5 == 2, F.concat("text", F.lit("字"))).otherwise(F.col("text")))
    return P.untranslated(c, "vi").select("video_id", "cue_no")


def same_transcript(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    return P.same_transcript(c, c.withColumn("text", F.when(F.col("video_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("-"))).otherwise(F.concat("text", F.lit("x")))))


def cjk_share(spark: SparkSession, d: str) -> DataFrame:
    return V.cues(spark, d).select("video_id", "cue_no", micro(T.cjk_ratio(F.concat("text", F.repeat(F.lit("字 "), F.col("cue_no").cast("int"))))).alias("share_micro"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    names = ("direct", "chronology", "evidence", "character", "duration", "story", "coverage", "style", "text_match", "subtitle_sync", "technical", "health")
    p = V.table(spark, d, "part")
    cols = [((F.col("p_partkey") * (2 * k + 3) + F.col("p_size") * (k + 1)) % 101).cast("double").alias(n) for k, n in enumerate(names)]
    return p.select(F.col("p_partkey").alias("video_id"), *cols, F.when(F.col("p_size") % 5 > 0, F.col("p_size") / 20).alias("drift"), (F.col("p_retailprice") / 4).alias("measured_s"), (F.col("p_size") % 9).alias("minutes"))


def report_scores(spark: SparkSession, d: str) -> DataFrame:
    r = _report(spark, d).withColumn("overall", P.report_overall()).withColumn("passed", F.col("direct") > 40)
    g = P.duration_gate(r)
    return r.select("video_id", micro("overall").alias("overall_micro")).join(g.select("video_id", micro("overall").alias("gated_micro"), "passed", "mismatch").hint("merge"), "video_id")


def review_baselines(spark: SparkSession, d: str) -> DataFrame:
    return P.review_baselines(_report(spark, d)).select("video_id", "key", micro("baseline").alias("baseline_micro"))


def sync_scores(spark: SparkSession, d: str) -> DataFrame:
    r = _report(spark, d).select("video_id", F.col("direct").alias("bounds"), F.col("story").alias("voice"), F.col("style").alias("agreement"), F.col("health").alias("slots"), (F.col("video_id") % 3 > 0).alias("matched"), F.when(F.col("video_id") % 4 > 0, F.col("video_id") % 4 > 1).alias("has_audio"), (F.col("video_id") % 6).alias("n_cues"))
    return P.sync_score(r).select("video_id", micro("sync").alias("sync_micro"), "sync_source")


def character_consistency(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.array(F.when(F.col("l_suppkey") % 3 == 0, "unknown").otherwise(F.col("l_returnflag")), F.col("l_linestatus")).alias("characters"))
    return P.character_consistency(s).select("video_id", micro("score").alias("score_micro"))


def black_segments(spark: SparkSession, d: str) -> DataFrame:
    f = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") % 2).alias("seq"), F.when(F.col("l_partkey") % 10 > 0, F.col("l_quantity")).alias("mean"), (F.col("l_suppkey") % 9).cast("double").alias("std"))
    return P.black_segments(f)


def sample_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", " ")).alias("cue_no", "text"))
    return P.sample_blocks(s, 60)


def verified_windows(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d).withColumn("at", F.col("start_ms") + F.length("text") * 13)
    first, last = P.verified_window("start_ms", "end_ms", "at")
    return c.select("video_id", "cue_no", first.alias("from_ms"), last.alias("to_ms"))


def with_profile(spark: SparkSession, d: str) -> DataFrame:
    j = V.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, " Best ").when(F.col("o_orderkey") % 5 == 1, "FAST").when(F.col("o_orderkey") % 5 == 2, "odd").when(F.col("o_orderkey") % 5 == 3, "quality").alias("mode"))
    return P.with_profile(j).drop("mode")


def merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    out = docs.select("doc_id", P.merge_evidence(F.filter("w", lambda x, i: i % 3 < 2), F.filter("w", lambda x, i: i % 3 > 0)).alias("e"))
    return out.select("doc_id", F.size("e").alias("n"), F.md5(F.array_join("e", "|")).alias("evidence_md5"))


def segment_issues(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("video_id"), F.col("l_partkey").alias("seq")).agg(F.max(F.when(F.col("l_suppkey") % 6 > 0, F.col("l_linenumber") / 4)).alias("match_score"), F.bool_or(F.col("l_quantity") > 20).alias("supported"))
    return P.segment_issues(s)


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select("n_nationkey", fingerprint("n_name", "n_regionkey").alias("fingerprint"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") % 40).alias("seq"), (F.col("l_partkey") % 12).alias("scene_id")).agg((F.sum("l_linenumber") * 37 % 1000).alias("score"))
    return li.select("video_id", "seq", F.floor(F.col("seq") / 5).alias("event_no"), "scene_id", (F.col("scene_id") * 700 % 4900 + F.col("scene_id")).alias("start_ms"), "score")


def assign_scenes(spark: SparkSession, d: str) -> DataFrame:
    return P.assign_scenes(_candidates(spark, d))


QUERIES = {f.__name__: f for f in (credits_only, usable_scenes, unsupported_dialogue, untranslated, same_transcript, cjk_share, report_scores, review_baselines, sync_scores, character_consistency, black_segments, sample_blocks, verified_windows, with_profile, merged_evidence, segment_issues, fingerprints, assign_scenes)}

_M = "regexp_matches({}, '(?i)" + "|".join(MARKERS) + "')"
_C = f"c AS ({V.CUES_DUCK})"
_S = f"""x AS (SELECT doc_id AS k, string_split(text, ' ') AS w FROM documents),
e AS (SELECT k, w, {", ".join(f"list_filter(w, lambda x, i: (i - 1) % 5 = {r}) AS w{r}" for r in range(5))} FROM x),
s AS (SELECT k % 40 AS video_id, k AS scene_id, k % 3 = 0 AS credits, k % 11 = 0 AS black, CASE WHEN k % 5 < 3 THEN 'UNKNOWN' ELSE array_to_string(w0, ' ') END AS summary, CASE WHEN k % 4 > 0 THEN '' ELSE array_to_string(w1, ' ') END AS dialogue,
  CASE WHEN k % 2 = 1 THEN array_to_string(w2, ' ') ELSE '' END AS action, array_to_string(w3, ' ') AS visual, list_filter(CASE WHEN k % 7 < 4 THEN ['unknown'] ELSE w4 END, lambda x: trim(x) <> '' AND upper(trim(x)) <> 'UNKNOWN') AS spoken FROM e),
p AS (SELECT *, (trim(summary) <> '' AND upper(trim(summary)) <> 'UNKNOWN' AND NOT {_M.format('summary')}) OR (trim(dialogue) <> '' AND NOT {_M.format('dialogue')}) OR (trim(action) <> '' AND NOT {_M.format('action')})
  OR (trim(visual) <> '' AND upper(trim(visual)) <> 'UNKNOWN' AND NOT {_M.format('visual')}) OR len(list_filter(spoken, lambda x: NOT {_M.format('x')})) > 0 AS plot FROM s)"""
_NAMES = ("direct", "chronology", "evidence", "character", "duration", "story", "coverage", "style", "text_match", "subtitle_sync", "technical", "health")
_R = "r AS (SELECT p_partkey AS video_id, " + ", ".join(f"((p_partkey * {2 * k + 3} + p_size * {k + 1}) % 101)::DOUBLE AS {n}" for k, n in enumerate(_NAMES)) + ", CASE WHEN p_size % 5 > 0 THEN p_size / 20.0::DOUBLE END AS drift, p_retailprice / 4 AS measured_s, p_size % 9 AS minutes FROM part)"
_OVERALL = "round_even(" + " + ".join(f"{n} * {w}::DOUBLE" for n, w in P.REPORT_WEIGHTS.items()) + ", 2)"
_BASE = {
    "content_fidelity": "evidence * 0.38 + direct * 0.34 + character * 0.16 + coverage * 0.12",
    "translation_accuracy": "evidence * 0.42 + character * 0.18 + story * 0.15 + text_match * 0.25",
    "av_subtitle_sync": "subtitle_sync * 0.72 + CASE WHEN drift IS NULL THEN 50 ELSE least(100, greatest(0, 100 - greatest(0, drift - 0.1) * 40)) END * 0.2 + chronology * 0.08",
    "narrative_coherence": "story * 0.62 + style * 0.2 + chronology * 0.18",
    "technical_quality": "technical * 0.42 + health * 0.28 + duration * 0.2 + direct * 0.1",
    "safety_compliance": "100",
}
_PROFILE = "CASE WHEN m = 'best' THEN 'quality' WHEN m IN ('fast', 'balanced', 'quality') THEN m ELSE 'balanced' END"
ORACLE_SQL = {
    "credits_only": f"WITH {_S} SELECT scene_id, credits AND NOT plot AS credits_only FROM p",
    "usable_scenes": f"WITH {_S}, q AS (SELECT *, NOT (black OR video_id = 5) AND NOT ((credits OR video_id < 3) AND NOT plot) AS ok FROM p) SELECT video_id, scene_id FROM q WHERE ok OR video_id NOT IN (SELECT video_id FROM q WHERE ok)",
    "unsupported_dialogue": f"WITH {_S} SELECT video_id, scene_id AS seq FROM s JOIN documents ON doc_id = scene_id WHERE regexp_matches(text, '(?i)(^|[^\\pL\\pN\\pM_])({VERBS})([^\\pL\\pN\\pM_]|$)') AND len(spoken) = 0",
    "untranslated": f"WITH {_C} SELECT video_id, cue_no FROM c WHERE cue_no % 5 IN (1, 2) OR trim(text) = ''",
    "same_transcript": rf"WITH {_C}, k AS (SELECT video_id, string_agg(regexp_replace(lower(text), '[^\pL\pN]', '', 'g'), '' ORDER BY cue_no) AS a, string_agg(regexp_replace(lower(CASE WHEN video_id % 3 = 0 THEN replace(text, ' ', '-') ELSE text || 'x' END), '[^\pL\pN]', '', 'g'), '' ORDER BY cue_no) AS b FROM c GROUP BY 1) SELECT video_id, a = b AS same FROM k",
    "cjk_share": rf"WITH {_C}, k AS (SELECT video_id, cue_no, cue_no AS n, length(regexp_replace(text || repeat('字 ', cue_no), '\s', '', 'g')) AS t FROM c) SELECT video_id, cue_no, cast(floor(CASE WHEN t > 0 THEN n / t ELSE 0 END * 1000000 + 0.5) AS BIGINT) AS share_micro FROM k",
    "report_scores": f"""WITH {_R}, o AS (SELECT *, {_OVERALL} AS overall, greatest(1, least(30, minutes)) * 60.0::DOUBLE AS t FROM r), a AS (SELECT *, round_even(greatest(0, 100 - abs(measured_s - t) / t * 250), 2) AS s, abs(measured_s - t) / t <= 0.1::DOUBLE AS ok FROM o)
SELECT video_id, cast(floor(overall * 1000000 + 0.5) AS BIGINT) AS overall_micro, cast(floor(round_even(least(100, greatest(0, overall - duration * 0.08::DOUBLE + s * 0.08::DOUBLE)), 2) * 1000000 + 0.5) AS BIGINT) AS gated_micro, direct > 40 AND ok AS passed, NOT ok AS mismatch FROM a""",
    "review_baselines": f"WITH {_R} " + " UNION ALL ".join(f"SELECT video_id, '{k}' AS key, cast(floor(least(100, greatest(0, {e})) * 1000000 + 0.5) AS BIGINT) AS baseline_micro FROM r" for k, e in _BASE.items()),
    "sync_scores": f"""WITH {_R}, z AS (SELECT video_id, video_id % 3 > 0 AS matched, CASE WHEN video_id % 4 > 0 THEN video_id % 4 > 1 END AS has_audio, video_id % 6 AS n, direct * 0.45 + story * 0.25 + style * 0.05 + health * 0.25 AS v FROM r)
SELECT video_id, cast(floor(CASE WHEN n = 0 THEN 0 ELSE least(v, CASE WHEN matched THEN 100 ELSE 70 END, CASE WHEN has_audio = FALSE THEN 40 ELSE 100 END) END * 1000000 + 0.5) AS BIGINT) AS sync_micro, CASE WHEN n = 0 THEN 'missing_subtitles' WHEN matched THEN 'per_cue' ELSE 'unverified' END AS sync_source FROM z""",
    "character_consistency": "SELECT l_orderkey AS video_id, cast(floor(CASE WHEN count(*) FILTER (l_suppkey % 3 = 0) = 0 THEN 100 ELSE greatest(60, 100 - 4.0::DOUBLE * count(*) FILTER (l_suppkey % 3 = 0) / (2 * count(*))) END * 1000000 + 0.5) AS BIGINT) AS score_micro FROM lineitem GROUP BY 1",
    "black_segments": "SELECT l_orderkey AS video_id, l_linenumber % 2 AS seq, count(*) FILTER (l_partkey % 10 = 0 OR l_quantity < 7 OR l_suppkey % 9 < 2) AS votes FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_partkey % 10 = 0 OR l_quantity < 7 OR l_suppkey % 9 < 2) >= 2",
    "sample_blocks": """WITH s AS (SELECT doc_id AS video_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS cue_no FROM documents), k AS (SELECT video_id, count(*) AS k FROM s GROUP BY 1),
b AS (SELECT video_id, greatest(0, least(k - 5, round_even(b * (k - 1) / 11.0::DOUBLE, 0)::BIGINT - 2)) AS lo FROM k, range(12) r(b)),
h AS (SELECT s.video_id, s.cue_no FROM s JOIN k USING (video_id) WHERE k <= 60 OR EXISTS (SELECT 1 FROM b WHERE b.video_id = s.video_id AND s.cue_no >= lo AND s.cue_no < lo + 5)) SELECT video_id, cue_no::INT AS cue_no FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cue_no) AS j FROM h) WHERE j <= 60""",
    "verified_windows": f"""WITH {_C}, z AS (SELECT *, start_ms + length(text) * 13 AS tm, least(2500, greatest(700, cast(floor(greatest(800, end_ms - start_ms) * 0.3::DOUBLE + 0.5) AS BIGINT))) AS n FROM c), f AS (SELECT *, greatest(start_ms, least(tm - n // 2, end_ms - n)) AS from_ms FROM z)
SELECT video_id, cue_no, from_ms, least(end_ms, from_ms + n) AS to_ms FROM f""",
    "with_profile": f"""WITH j AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'best' WHEN 1 THEN 'fast' WHEN 2 THEN 'odd' WHEN 3 THEN 'quality' END AS m FROM orders), p AS (SELECT o_orderkey, {_PROFILE} AS profile FROM j)
SELECT o_orderkey, profile, CASE profile WHEN 'fast' THEN 32 WHEN 'balanced' THEN 28 ELSE 20 END AS batch_items, CASE profile WHEN 'fast' THEN 6000 WHEN 'balanced' THEN 5400 ELSE 4600 END AS batch_chars, CASE profile WHEN 'fast' THEN 72 WHEN 'balanced' THEN 192 ELSE 300 END AS max_scenes FROM p""",
    "merged_evidence": """WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 3 < 2) || list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 3 > 0) AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY 1, 2)
SELECT doc_id, count(*)::INT AS n, md5(string_agg(x, '|' ORDER BY i)) AS evidence_md5 FROM f GROUP BY 1""",
    "segment_issues": """WITH s AS (SELECT l_orderkey AS video_id, l_partkey AS seq, max(CASE WHEN l_suppkey % 6 > 0 THEN l_linenumber / 4.0 END) AS m, bool_or(l_quantity > 20) AS ok FROM lineitem GROUP BY 1, 2)
SELECT * FROM (SELECT video_id, seq, CASE WHEN m IS NULL THEN 'NO_CLIP' WHEN m < 0.75 THEN 'LOW_VISUAL_MATCH' WHEN NOT ok THEN 'UNSUPPORTED_NARRATION' END AS code FROM s) WHERE code IS NOT NULL""",
    "fingerprints": """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS fingerprint FROM nation""",
    "assign_scenes": """WITH RECURSIVE c AS (SELECT l_suppkey AS video_id, l_orderkey % 40 AS seq, (l_orderkey % 40) // 5 AS event_no, l_partkey % 12 AS scene_id, l_partkey % 12 * 700 % 4900 + l_partkey % 12 AS start_ms, (sum(l_linenumber) * 37 % 1000)::BIGINT AS score FROM lineitem GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT video_id, event_no, seq, row_number() OVER (PARTITION BY video_id, event_no ORDER BY seq) - 1 AS p, count(*) OVER (PARTITION BY video_id, event_no) AS t, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS i FROM (SELECT DISTINCT video_id, event_no, seq FROM c)),
f(video_id, i, seq, scene_id, last, r1, r2) AS (SELECT DISTINCT video_id, 0::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT FROM c
UNION ALL SELECT video_id, i, seq, scene_id, greatest(last, start_ms), scene_id, r1 FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY abs(rank - ideal), -score, start_ms, scene_id) AS o FROM (
    SELECT *, CASE WHEN t <= 1 THEN (n - 1) / 2.0::DOUBLE ELSE p * (n - 1) / (t - 1.0::DOUBLE) END AS ideal, max(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS any_fresh FROM (
      SELECT *, scene_id <> r1 AND scene_id <> r2 AS fresh FROM (
        SELECT *, max(score) OVER (PARTITION BY video_id) AS best, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, scene_id) - 1 AS rank, count(*) OVER (PARTITION BY video_id) AS n FROM (
          SELECT *, max(CASE WHEN ahead THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS any_ahead FROM (
            SELECT f.video_id, e.i, e.seq, e.p, e.t, f.last, f.r1, f.r2, c.scene_id, c.start_ms, c.score, c.start_ms + 250 >= f.last AS ahead FROM f JOIN e ON e.video_id = f.video_id AND e.i = f.i + 1 JOIN c ON c.video_id = e.video_id AND c.seq = e.seq))
        WHERE ahead OR any_ahead = 0) WHERE score >= best - 60))
    WHERE fresh OR any_fresh = 0) WHERE o = 1)
SELECT video_id, seq, scene_id FROM f WHERE i > 0""",
}
