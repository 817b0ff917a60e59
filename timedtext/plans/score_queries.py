"""Queries over scorecards, gates, budgets, jobs and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.scores import micro
from ..operators import scorecards as C
from . import views as V



def _criteria(spark: SparkSession, d: str) -> DataFrame:
    return V.scores(spark, d).withColumn("key", F.element_at(F.array(*map(F.lit, S.CRITERIA)), F.col("k").cast("int")))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?…]+[.!?…]*"), F.lit(0))).alias("seq", "narration"))


def blend_scores(spark: SparkSession, d: str) -> DataFrame:
    out = C.blend(_criteria(spark, d), "review")
    return out.select("video_id", "key", micro("score").alias("score_micro"), "fallback", "passed")


def blend_dubbing(spark: SparkSession, d: str) -> DataFrame:
    c, v = _criteria(spark, d), F.col("video_id")
    c = c.withColumns({"translation_required": v % 2 == 0, "identical_text": v % 3 == 0, "narration_expected": v % 5 != 0, "slots_matched": v % 7 > 2, "has_audio": F.when(v % 13 > 0, v % 11 != 4)})
    out = C.blend(c, "dubbing")
    return out.select("video_id", "key", micro("score").alias("score_micro"), "fallback", "passed")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    c = C.blend(_criteria(spark, d).withColumn("baseline", 70 + F.floor(F.col("baseline") * 0.3)).withColumn("judge", 70 + F.floor(F.col("judge") * 0.3)))
    flags = c.select("video_id").distinct().withColumn("ok", F.col("video_id") % 7 != 3)
    return C.verdict(c, flags).select("video_id", micro("overall").alias("overall_micro"), "passed", "verdict")


def fallback_criteria(spark: SparkSession, d: str) -> DataFrame:
    orders = V.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    return C.fallback_criteria(orders, V.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("video_id")))


def job_history(spark: SparkSession, d: str) -> DataFrame:
    jobs = C.current_jobs(_updates(spark, d)).withColumn("completed_at", F.when(F.col("job_id") % 3 > 0, F.col("updated_at") + F.expr("make_dt_interval(0, job_id % 50)")))
    return C.job_history(jobs).select("job_id", F.unix_micros(F.coalesce("completed_at", "updated_at").cast("timestamp")).alias("newest_micro"))


def highlights(spark: SparkSession, d: str) -> DataFrame:
    return C.highlights(C.blend(_criteria(spark, d)))


def hard_gate(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (*C.HARD_CODES, *C.SOFT_CODES, "OTHER"))), (F.col("l_partkey") % 15 + 1).cast("int"))
    severity = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("info")
    issues = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), code.alias("code"), severity.alias("severity"))
    return C.hard_gate(issues)


def budgets(spark: SparkSession, d: str) -> DataFrame:
    style = F.element_at(F.array(*[F.lit(s) for s in (*C.STYLES, "other")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = V.table(spark, d, "part").select("p_partkey", (F.col("p_size") - 3).alias("minutes"), style.alias("style"))
    return p.select("p_partkey", *[c.alias(k) for k, c in C.budget("minutes", "style").items()])


def meets_budget(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    b = s.select("video_id").distinct().withColumn("minutes", F.col("video_id") % 5).withColumn("style", F.lit("fast"))
    return C.meets_budget(s, b.select("video_id", *[c.alias(k) for k, c in C.budget("minutes", "style").items()]))


def durations_ok(spark: SparkSession, d: str) -> DataFrame:
    """Adherence, tempo factor and drift of measured durations."""
    p = V.table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 0.37713).alias("actual"), (F.col("p_size") % 12).alias("minutes"))
    score, ok = S.duration_adherence("actual", "minutes")
    drift = S.drift_score("actual", F.col("minutes") * 60.0, 0.15, 35.0, 70.0)
    return p.select("p_partkey", micro(score).alias("score_micro"), ok.alias("ok"), micro(S.tempo_factor("actual", "minutes")).alias("tempo_micro"), micro(drift).alias("drift_micro"))


def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = V.spans(spark, d).select("video_id", F.col("cue_no").alias("scene_no"), "start_ms", "end_ms", (F.col("track") == "click").alias("chosen"))
    return C.source_coverage(s).select("video_id", micro("coverage").alias("coverage_micro"))


RULES = {"quantity": "l_quantity between 1 and 45", "discount": "l_discount <= 0.08", "flag": "l_returnflag in ('A', 'N')", "line": "l_linenumber >= 1"}


def validate(spark: SparkSession, d: str) -> DataFrame:
    return C.validate(V.table(spark, d, "lineitem"), RULES)


def _updates(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    return e.select(F.col("user_id").alias("job_id"), "event_id", F.col("event_type").alias("status"), (F.floor("value") % 101).alias("progress"), F.col("ts").alias("updated_at"))


def current_jobs(spark: SparkSession, d: str) -> DataFrame:
    return C.current_jobs(_updates(spark, d))


def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    return C.recent_jobs(_updates(spark, d)).select("job_id", "status", "progress", "n_updates")


def expire_jobs(spark: SparkSession, d: str) -> DataFrame:
    u = _updates(spark, d)
    now = F.timestamp_seconds(F.lit(u.agg(F.max(F.unix_seconds(F.col("updated_at").cast("timestamp")))).first()[0]))
    return C.expire_jobs(u, now, 7200, ("view", "click")).select("job_id", "status")


def reconcile_ids(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("item_id"), "l_suppkey", "l_partkey")
    return C.reconcile_ids(li.withColumn("item_id", F.expr("if(l_suppkey % 3 = 0, item_id + 10, item_id)")), li.withColumn("item_id", F.expr("if(l_partkey % 4 = 0, item_id + 20, item_id)")))


def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.withColumn("o_orderkey", F.expr("if(o_orderkey % 11 = 0, -2 * o_orderkey, o_orderkey)")).withColumn("o_orderstatus", F.when(F.col("o_custkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return C.changed_rows(new, o.withColumn("o_orderkey", F.expr("if(o_orderkey % 7 = 0, -2 * o_orderkey - 1, o_orderkey)")), ["o_orderkey"], ["o_orderstatus", "o_custkey"])


def pending_items(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    items = s.select("video_id", F.col("seq").alias("item_no"), F.floor(F.col("seq") / 4).alias("batch_no"), F.when(F.col("video_id") % 3 == 0, "old").otherwise("new").alias("fingerprint"))
    points = s.select("video_id").distinct().select("video_id", F.lit("new").alias("fingerprint"), F.when(F.col("video_id") % 2 == 0, 8).otherwise(7).alias("done_items"))
    return C.pending(items, points).select("video_id", "item_no")


QUERIES = {f.__name__: f for f in (blend_scores, blend_dubbing, verdicts, fallback_criteria, job_history, highlights, hard_gate, budgets, meets_budget, durations_ok, source_coverage, validate, current_jobs, recent_jobs, expire_jobs, reconcile_ids, changed_rows, pending_items)}

_KEYS = "[" + ", ".join(f"'{k}'" for k in S.CRITERIA) + "]"
_arr = lambda v: "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "][k]"


def _blend(kind: str, source: str = "v") -> str:
    return f"""b AS (SELECT video_id, k, {_KEYS}[k] AS key, {_arr(S.WEIGHTS)} AS weight, judge IS NULL AS fallback,
  round_even(least(100, greatest(0, CASE WHEN judge IS NULL THEN CASE WHEN k = 2 THEN least(baseline, 60.0::DOUBLE) ELSE baseline END WHEN k = 6 THEN judge ELSE baseline * (1 - {_arr(S.INFLUENCE[kind])}) + judge * {_arr(S.INFLUENCE[kind])} END)), 2) AS score FROM {source}),
p AS (SELECT *, score >= {_arr(S.PASS_MARKS)} AS passed FROM b)"""


_DUB = f"""b AS (SELECT video_id, k, {_KEYS}[k] AS key, judge IS NULL AS fallback, CASE
  WHEN judge IS NULL AND video_id % 2 = 0 THEN least(baseline, [65.0::DOUBLE, CASE WHEN video_id % 3 = 0 THEN 35 ELSE 60 END, 100, 70, 100, 75][k])
  WHEN judge IS NULL OR k = 5 THEN baseline WHEN k = 6 THEN judge ELSE baseline * (1 - {_arr(S.INFLUENCE['dubbing'])}) + judge * {_arr(S.INFLUENCE['dubbing'])} END AS x,
  video_id % 13 > 0 AND video_id % 11 = 4 AS silent FROM v),
p AS (SELECT video_id, key, fallback, round_even(CASE WHEN video_id % 5 = 0 THEN x WHEN k = 3 AND silent THEN least(x, 40.0) WHEN k = 3 AND video_id % 7 <= 2 THEN least(x, 70.0) WHEN k = 5 AND silent THEN least(x, 50.0) ELSE x END, 2) AS score, {_arr(S.PASS_MARKS)} AS pass_mark FROM b)"""
_V = f"v AS ({V.SCORES_DUCK})"
_MICRO = "cast(floor({} * 1000000 + 0.5) AS BIGINT)"
_S = r"s AS (SELECT doc_id AS video_id, unnest(regexp_extract_all(text, '[^.!?…]+[.!?…]*', 0)) AS narration, generate_subscripts(regexp_extract_all(text, '[^.!?…]+[.!?…]*', 0), 1) - 1 AS seq FROM documents)"
_U = "u AS (SELECT user_id AS job_id, event_id, event_type AS status, cast(floor(value) AS BIGINT) % 101 AS progress, ts AS updated_at FROM events), j AS (SELECT job_id, arg_max(status, (updated_at, event_id)) AS status, arg_max(progress, (updated_at, event_id)) AS progress, max(updated_at) AS updated_at, min(updated_at) AS created_at, count(*) AS n_updates FROM u GROUP BY 1)"
_PER = "CASE style WHEN 'story' THEN 16 WHEN 'fast' THEN 14 WHEN 'emotional' THEN 18 WHEN 'funny' THEN 15 ELSE 16 END"


def _budget(source: str, key: str) -> str:
    return f"""m AS (SELECT {key}, greatest(1, least(30, minutes)) * 205 AS w, {_PER} AS per FROM {source}), g AS (SELECT *, greatest(8, round_even(w / per, 0)::BIGINT) AS seg FROM m),
q AS (SELECT {key}, w::BIGINT AS target_words, round_even(w * 0.9::DOUBLE, 0)::BIGINT AS min_words, round_even(w * 1.15::DOUBLE, 0)::BIGINT AS max_words, seg AS target_segments, greatest(6, floor(seg * 0.8::DOUBLE))::BIGINT AS min_segments, greatest(10, ceil(seg * 1.2::DOUBLE))::BIGINT AS max_segments FROM g)"""


ORACLE_SQL = {
    "blend_scores": f"WITH {_V}, {_blend('review')} SELECT video_id, key, {_MICRO.format('score')} AS score_micro, fallback, passed FROM p",
    "blend_dubbing": f"WITH {_V}, {_DUB} SELECT video_id, key, {_MICRO.format('score')} AS score_micro, fallback, score >= pass_mark AS passed FROM p",
    "verdicts": f"""WITH {_V}, y AS (SELECT video_id, k, 70 + floor(baseline * 0.3::DOUBLE) AS baseline, 70 + floor(judge * 0.3::DOUBLE) AS judge FROM v), {_blend('review', 'y')},
t AS (SELECT video_id, sum(round(score * 100)::BIGINT * weight::BIGINT)::BIGINT AS c, greatest(sum(weight::BIGINT), 1)::BIGINT AS w, bool_and(passed) AND any_value(video_id) % 7 <> 3 AS ok FROM p GROUP BY 1),
o AS (SELECT video_id, (c // w + CASE WHEN 2 * (c % w) > w OR (2 * (c % w) = w AND (c // w) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS overall, ok FROM t)
SELECT video_id, {_MICRO.format('overall')} AS overall_micro, overall >= 80 AND ok AS passed, CASE WHEN overall >= 90 AND ok THEN 'excellent' WHEN overall >= 80 AND ok THEN 'good' WHEN overall >= 65 THEN 'needs_improvement' ELSE 'poor' END AS verdict FROM o""",
    "fallback_criteria": f"SELECT c_custkey AS video_id, unnest({_KEYS}) AS key, 0.0::DOUBLE AS score, FALSE AS passed FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "job_history": f"WITH {_U} SELECT job_id, (epoch_us(updated_at) + CASE WHEN job_id % 3 > 0 THEN job_id % 50 * 3600000000 ELSE 0 END)::BIGINT AS newest_micro FROM j",
    "highlights": f"""WITH {_V}, {_blend('review')}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, k) AS b, row_number() OVER (PARTITION BY video_id ORDER BY score, k) AS w FROM p)
SELECT video_id, coalesce(string_agg(key, ',' ORDER BY b) FILTER (b <= 2), '') AS strengths, coalesce(string_agg(key, ',' ORDER BY w) FILTER (w <= 4 AND score < 85), '') AS recommendations FROM r GROUP BY 1""",
    "hard_gate": f"""WITH i AS (SELECT l_orderkey AS video_id, ['NO_CLIP', 'CHRONOLOGY', 'NARRATION_DURATION_MISMATCH', 'TARGET_DURATION_MISMATCH', 'VOICE_VIDEO_DRIFT', 'STORY_ARC_INCOMPLETE', 'NARRATIVE_LOGIC', 'SOURCE_COVERAGE', 'LOW_VISUAL_MATCH', 'POST_RENDER_VISUAL_MISMATCH', 'UNSUPPORTED_NARRATION', 'STYLE_MISMATCH', 'REPETITIVE_TRANSITIONS', 'UNVERIFIED_EVENT', 'OTHER'][l_partkey % 15 + 1] AS code, CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END AS s FROM lineitem),
g AS (SELECT video_id, code, CASE WHEN code IN ('STYLE_MISMATCH', 'REPETITIVE_TRANSITIONS', 'UNVERIFIED_EVENT') THEN 'warning' ELSE s END AS severity FROM i)
SELECT video_id, count(*) AS n_issues, count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'error' AND code <> 'OTHER') AS n_blocking, count(*) FILTER (severity = 'error' AND code <> 'OTHER') = 0 AS passed FROM g GROUP BY 1""",
    "budgets": f"WITH x AS (SELECT p_partkey, p_size - 3 AS minutes, ['story', 'fast', 'emotional', 'funny', 'other'][p_partkey % 5 + 1] AS style FROM part), {_budget('x', 'p_partkey')} SELECT * FROM q",
    "meets_budget": rf"""WITH {_S}, x AS (SELECT DISTINCT video_id, video_id % 5 AS minutes, 'fast' AS style FROM s), {_budget('x', 'video_id')}, n AS (SELECT video_id, sum(len(regexp_extract_all(narration, '[\pL\pN\pM_]+', 0)))::BIGINT AS n_words, sum(len(list_filter(string_split(regexp_replace(narration, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')))::BIGINT AS n_segments FROM s GROUP BY 1)
SELECT video_id, n_words, n_segments, n_words BETWEEN min_words AND max_words AND n_segments BETWEEN min_segments AND max_segments AS ok FROM n JOIN q USING (video_id)""",
    "durations_ok": """WITH x AS (SELECT p_partkey, p_retailprice * 0.37713::DOUBLE AS a, p_size % 12 AS m, greatest(1, least(30, p_size % 12)) * 60.0::DOUBLE AS t FROM part)
SELECT p_partkey, cast(floor(CASE WHEN a <= 0 THEN 0 ELSE round_even(greatest(0, 100 - abs(a - t) / t * 250), 2) END * 1000000 + 0.5) AS BIGINT) AS score_micro, a > 0 AND abs(a - t) / t <= 0.1::DOUBLE AS ok,
  cast(floor(CASE WHEN a > 0 AND a / t BETWEEN 0.9::DOUBLE AND 1.15::DOUBLE THEN round_even(a / t, 6) END * 1000000 + 0.5) AS BIGINT) AS tempo_micro,
  cast(floor(CASE WHEN a > 0 AND m > 0 THEN least(100, greatest(0, 100 - greatest(0, abs(a - m * 60.0) - 0.15) * 35)) ELSE 70 END * 1000000 + 0.5) AS BIGINT) AS drift_micro FROM x""",
    "source_coverage": f"""WITH s AS ({V.SPANS_DUCK}), b AS (SELECT *, track = 'click' AS chosen, row_number() OVER w AS i, count(*) OVER (PARTITION BY video_id) AS n FROM s WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, cue_no)),
c AS (SELECT *, CASE WHEN i <= (n % 10) * (n // 10 + 1) THEN (i - 1) // (n // 10 + 1) ELSE (n % 10) + (i - 1 - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) END AS k FROM b),
h AS (SELECT video_id, k, bool_or(chosen)::INT AS hit FROM c GROUP BY 1, 2), r AS (SELECT video_id, avg(hit) AS hit FROM h GROUP BY 1),
p AS (SELECT video_id, coalesce(max(end_ms) FILTER (chosen) - min(start_ms) FILTER (chosen), 0) / greatest(max(end_ms) - min(start_ms), 1) AS span FROM b GROUP BY 1)
SELECT video_id, cast(floor(least(100, 100 * (0.65::DOUBLE * hit + 0.35::DOUBLE * span)) * 1000000 + 0.5) AS BIGINT) AS coverage_micro FROM r JOIN p USING (video_id)""",
    "validate": " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n_rows, count(*) FILTER (NOT coalesce({e}, FALSE)) AS n_failed FROM lineitem" for k, e in RULES.items()),
    "current_jobs": f"WITH {_U} SELECT job_id, status, progress, updated_at, created_at, n_updates FROM j",
    "recent_jobs": f"WITH {_U} SELECT job_id, status, progress, n_updates FROM j ORDER BY updated_at DESC, job_id LIMIT 8",
    "expire_jobs": f"WITH {_U} SELECT job_id, CASE WHEN status IN ('view', 'click') AND (SELECT max(epoch_us(updated_at) // 1000000) FROM u) - epoch_us(updated_at) // 1000000 > 7200 THEN 'failed' ELSE status END AS status FROM j",
    "reconcile_ids": """WITH e AS (SELECT l_orderkey AS video_id, l_linenumber + CASE WHEN l_suppkey % 3 = 0 THEN 10 ELSE 0 END AS id, count(*) AS e FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey AS video_id, l_linenumber + CASE WHEN l_partkey % 4 = 0 THEN 20 ELSE 0 END AS id, count(*) AS r FROM lineitem GROUP BY 1, 2)
SELECT video_id, count(*) FILTER (r IS NULL) AS n_missing, count(*) FILTER (e IS NULL) AS n_unexpected, count(*) FILTER (r > 1) AS n_duplicate, coalesce(sum(e), 0) <> coalesce(sum(r), 0) AS count_differs FROM e FULL JOIN r USING (video_id, id) GROUP BY 1""",
    "changed_rows": """WITH n AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -2 * o_orderkey ELSE o_orderkey END AS o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders), o AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -2 * o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_orderstatus AS t FROM orders)
SELECT o_orderkey, CASE WHEN t IS NULL THEN 'added' WHEN s IS NULL THEN 'removed' WHEN s = t THEN 'same' ELSE 'changed' END AS change FROM n FULL JOIN o USING (o_orderkey)""",
    "pending_items": f"""WITH {_S}, e AS (SELECT video_id, max(seq) + 1 AS done FROM s GROUP BY video_id, seq // 4)
SELECT video_id, seq::INT AS item_no FROM s WHERE seq >= CASE WHEN video_id % 3 <> 0 AND (video_id, CASE WHEN video_id % 2 = 0 THEN 8 ELSE 7 END) IN (SELECT (video_id, done) FROM e) THEN CASE WHEN video_id % 2 = 0 THEN 8 ELSE 7 END ELSE 0 END""",
}
