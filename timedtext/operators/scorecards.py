"""Scorecards: blending measured baselines with a judge, verdicts, gates, budgets and history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T

# Styles with their words per segment, issue codes that block and codes that the gate softens.
STYLES = {"story": 16, "fast": 14, "emotional": 18, "funny": 15}
HARD_CODES = (
    "NO_CLIP", "CHRONOLOGY", "NARRATION_DURATION_MISMATCH", "TARGET_DURATION_MISMATCH", "VOICE_VIDEO_DRIFT", "STORY_ARC_INCOMPLETE", "NARRATIVE_LOGIC",
    "SOURCE_COVERAGE", "LOW_VISUAL_MATCH", "POST_RENDER_VISUAL_MISMATCH", "UNSUPPORTED_NARRATION",
)
SOFT_CODES = ("STYLE_MISMATCH", "REPETITIVE_TRANSITIONS", "UNVERIFIED_EVENT")
# Bounds of a dubbed video's scores without a judge, and with a voice-over whose sound is doubtful.
DUBBING_CAPS = {"content_fidelity": 65.0, "translation_accuracy": 60.0, "narrative_coherence": 70.0, "safety_compliance": 75.0}
IDENTICAL_TEXT_CAP, SLOTS_UNKNOWN_CAP, SILENT_SYNC_CAP, SILENT_TECHNICAL_CAP = 35.0, 70.0, 40.0, 50.0


def blend(criteria: DataFrame, kind: str = "review") -> DataFrame:
    """Score and pass mark of every criterion: ``criteria(video_id, key, baseline, judge)``.

    The judge moves a baseline by the criterion's influence, and replaces that of safety. Without a judge's score the
    baseline stands, held to 60 for translation. For ``kind`` dubbing the rows also have the signals ``translation_required,
    identical_text, narration_expected, slots_matched`` and ``has_audio`` (null: unknown): without a judge the caps of translated
    videos hold, technical quality is the baseline alone, and doubtful slots or missing sound hold down two scores.
    """
    base, influence = S.clamp("baseline"), S.by_criterion("key", S.INFLUENCE[kind])
    key, on = F.col("key"), lambda c: F.coalesce(F.col(c), F.lit(False))
    judged = F.when(key == "safety_compliance", S.clamp("judge")).otherwise(base * (1 - influence) + S.clamp("judge") * influence)
    if kind == "dubbing":
        cap = F.when((key == "translation_accuracy") & on("identical_text"), IDENTICAL_TEXT_CAP)
        for k, most in DUBBING_CAPS.items():
            cap = cap.when(key == k, most)
        alone = F.when(on("translation_required"), F.least(base, cap.otherwise(100.0))).otherwise(base)
        score = F.when(F.col("judge").isNull(), alone).when(key == "technical_quality", base).otherwise(judged)
        silent, sync = ~F.coalesce("has_audio", F.lit(True)), key == "av_subtitle_sync"
        most = F.least(F.when(sync & ~on("slots_matched"), SLOTS_UNKNOWN_CAP), F.when(sync & silent, SILENT_SYNC_CAP), F.when((key == "technical_quality") & silent, SILENT_TECHNICAL_CAP))
        score = F.when(on("narration_expected"), F.least(score, most)).otherwise(score)
    else:
        alone = F.when(key == "translation_accuracy", F.least(base, F.lit(60.0))).otherwise(base)
        score = F.when(F.col("judge").isNull(), alone).otherwise(judged)
    score = F.bround(S.clamp(score), 2)
    d = criteria.withColumn("score", score).withColumn("weight", S.by_criterion("key", S.WEIGHTS))
    return d.withColumn("fallback", F.col("judge").isNull()).withColumn("passed", F.col("score") >= S.by_criterion("key", S.PASS_MARKS))


def verdict(blended: DataFrame, flags: DataFrame) -> DataFrame:
    """Overall score, pass and verdict of each video; ``flags(video_id, ok)`` are critical checks, missing ones fail.

    Scores have two places and weights none: sums are decimals, so that the order of the rows cannot move a rounding tie.
    """
    weight = F.col("weight").cast("decimal(5,0)")
    mean = F.sum(F.col("score").cast("decimal(7,2)") * weight) / F.greatest(F.sum(weight), F.lit(1))
    g = blended.groupBy("video_id").agg(F.bround(mean, 2).cast("double").alias("overall"), F.bool_and("passed").alias("__all"))
    g = g.join(flags.hint("merge"), "video_id", "left").withColumn("passed", (F.col("overall") >= 80) & F.col("__all") & F.coalesce("ok", F.lit(False)))
    word = F.when((F.col("overall") >= 90) & F.col("passed"), "excellent").when((F.col("overall") >= 80) & F.col("passed"), "good").when(F.col("overall") >= 65, "needs_improvement").otherwise("poor")
    return g.select("video_id", "overall", "passed", word.alias("verdict"))


def fallback_criteria(videos: DataFrame, evidence: DataFrame) -> DataFrame:
    """Six criteria of score 0 for every video that has no evidence row."""
    lone = videos.select("video_id").distinct().join(evidence.select("video_id").distinct().hint("merge"), "video_id", "left_anti")
    return lone.select("video_id", F.explode(F.array(*map(F.lit, S.CRITERIA))).alias("key"), F.lit(0.0).alias("score"), F.lit(False).alias("passed"))


def job_history(jobs: DataFrame) -> DataFrame:
    """``jobs`` newest first: by the time of completion, or of the last update where there is none; ties by id."""
    return jobs.orderBy(F.coalesce("completed_at", "updated_at").desc_nulls_last(), "job_id")


def highlights(blended: DataFrame) -> DataFrame:
    """Keys of the two best criteria and of the four lowest under 85, joined by commas."""
    best = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "k"))
    worst = F.row_number().over(Window.partitionBy("video_id").orderBy("score", "k"))
    d = blended.withColumn("__b", best).withColumn("__w", worst)
    pick = lambda c, n, cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col(c) <= n) & cond, F.struct(c, "key")))), lambda x: x["key"]), ",")
    return d.groupBy("video_id").agg(pick("__b", 2, F.lit(True)).alias("strengths"), pick("__w", 4, F.col("score") < 85).alias("recommendations"))


def hard_gate(issues: DataFrame) -> DataFrame:
    """Issues with soft codes lowered to warnings, and per video whether no error with a blocking code is left."""
    d = issues.withColumn("severity", F.when(F.col("code").isin(*SOFT_CODES), "warning").otherwise(F.col("severity")))
    blocking = (F.col("severity") == "error") & F.col("code").isin(*HARD_CODES)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return d.groupBy("video_id").agg(F.count("*").alias("n_issues"), n(F.col("severity") == "warning").alias("n_warnings"), n(blocking).alias("n_blocking")).withColumn("passed", F.col("n_blocking") == 0)


def budget(minutes: str, style: str) -> dict[str, Column]:
    """Word and segment budget for wanted minutes (1..30) in a style."""
    m = F.greatest(F.lit(1), F.least(F.lit(30), F.col(minutes)))
    words, per = m * 205, F.lit(16)
    for name, n in STYLES.items():
        per = F.when(F.col(style) == name, F.lit(n)).otherwise(per)
    segments = F.greatest(F.lit(8), F.bround(words / per, 0).cast("long"))
    return {
        "target_words": words.cast("long"),
        "min_words": F.bround(words * F.lit(0.90), 0).cast("long"),
        "max_words": F.bround(words * F.lit(1.15), 0).cast("long"),
        "target_segments": segments,
        "min_segments": F.greatest(F.lit(6), F.floor(segments * F.lit(0.80))).cast("long"),
        "max_segments": F.greatest(F.lit(10), F.ceil(segments * F.lit(1.20))).cast("long"),
    }


def meets_budget(segments: DataFrame, budgets: DataFrame) -> DataFrame:
    """Words and sentences of a script held against ``budgets(video_id, min_words, ...)``; ``n_segments`` counts sentences.

    Whether the script also has all roles and verified events is a part of ``quality.quality_report``.
    """
    g = segments.groupBy("video_id").agg(F.sum(T.word_count("narration")).cast("long").alias("n_words"), F.sum(T.sentences("narration")).cast("long").alias("n_segments"))
    ok = F.col("n_words").between(F.col("min_words"), F.col("max_words")) & F.col("n_segments").between(F.col("min_segments"), F.col("max_segments"))
    return g.join(budgets.hint("merge"), "video_id").select("video_id", "n_words", "n_segments", ok.alias("ok"))


def source_coverage(scenes: DataFrame, buckets: int = 10) -> DataFrame:
    """How evenly chosen scenes cover the source: ``scenes(video_id, scene_no, start_ms, end_ms, chosen)``.

    Scenes in order of time fall into near-equal buckets; 0.65 of the share of buckets with a chosen scene, 0.35 of the
    share of the source's span that the chosen ones reach over.
    """
    w = Window.partitionBy("video_id").orderBy("start_ms", "scene_no")
    d = scenes.withColumn("b", F.ntile(buckets).over(w))
    g = d.groupBy("video_id", "b").agg(F.max(F.col("chosen").cast("int")).alias("hit"), F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"), F.min(F.when(F.col("chosen"), F.col("start_ms"))).alias("clo"), F.max(F.when(F.col("chosen"), F.col("end_ms"))).alias("chi"))
    g = g.groupBy("video_id").agg((F.sum("hit") / F.count("*")).alias("hit"), (F.coalesce(F.max("chi") - F.min("clo"), F.lit(0)) / F.greatest(F.max("hi") - F.min("lo"), F.lit(1))).alias("span"))
    return g.select("video_id", S.clamp(100 * (0.65 * F.col("hit") + 0.35 * F.col("span"))).alias("coverage"))


def validate(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(rule, n_rows, n_failed)`` for boolean SQL expressions that every row must satisfy; null fails."""
    checks = [F.sum(F.when(F.coalesce(F.expr(e), F.lit(False)), 0).otherwise(1)).cast("long").alias(name) for name, e in rules.items()]
    one = df.agg(F.count("*").alias("__n"), *checks)
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(name), F.lit(0)).alias("n_failed")) for name in rules])
    return one.select("__n", F.explode(pairs).alias("x")).select("x.rule", F.col("__n").alias("n_rows"), "x.n_failed")


def current_jobs(updates: DataFrame) -> DataFrame:
    """Latest status and progress of each job, its first time and the number of updates; ties go to the higher event."""
    last = F.max(F.struct("updated_at", "event_id", "status", "progress")).alias("x")
    return updates.groupBy("job_id").agg(last, F.min("updated_at").alias("created_at"), F.count("*").alias("n_updates")).select("job_id", "x.status", "x.progress", "x.updated_at", "created_at", "n_updates")


def recent_jobs(updates: DataFrame, n: int = 8) -> DataFrame:
    return current_jobs(updates).orderBy(F.desc("updated_at"), "job_id").limit(n)


def expire_jobs(updates: DataFrame, now: Column, timeout_s: int, open_states: tuple[str, ...] = ("queued", "processing")) -> DataFrame:
    """Jobs whose last state is one of ``open_states``, without an update for more than ``timeout_s`` seconds, become failed."""
    d = current_jobs(updates)
    stale = F.col("status").isin(*open_states) & (F.unix_seconds(now) - F.unix_seconds(F.col("updated_at").cast("timestamp")) > timeout_s)
    return d.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def reconcile_ids(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Per video: missing, unexpected and duplicate ids, and whether the counts differ. Both have ``(video_id, item_id)``."""
    # One group over both sides counts what a join of two grouped tables would sort twice. Null ids equal nothing, so that the sides stay apart there.
    side = lambda d, k: d.select("video_id", "item_id", F.lit(k).cast("long").alias("e"), F.lit(1 - k).cast("long").alias("r"))
    apart = F.when(F.col("video_id").isNull() | F.col("item_id").isNull(), F.col("e")).alias("apart")
    j = side(expected, 1).unionByName(side(returned, 0)).groupBy("video_id", "item_id", apart).agg(F.sum("e").alias("e"), F.sum("r").alias("r"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return j.groupBy("video_id").agg(n(F.col("r") == 0).alias("n_missing"), n(F.col("e") == 0).alias("n_unexpected"), n(F.col("r") > 1).alias("n_duplicate"), (F.sum("e") != F.sum("r")).alias("count_differs"))


def changed_rows(new: DataFrame, old: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """``key`` and ``change`` (added, changed, same, removed) between two versions of a table, by a hash of the payload."""
    h = F.xxhash64(*payload)
    a, b = new.select(*key, h.alias("a")), old.select(*key, h.alias("b"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b.hint("merge"), key, "full").select(*key, change.alias("change"))


def pending(items: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Items not done yet: ``checkpoints(video_id, fingerprint, done_items)`` count only with the items' fingerprint and at a
    batch end of ``items(video_id, item_no, batch_no, fingerprint)``."""
    last = items.groupBy("video_id", "batch_no").agg(F.max("item_no").alias("m")).select("video_id", (F.col("m") + 1).alias("done_items"))
    valid = checkpoints.join(last.hint("merge"), ["video_id", "done_items"], "left_semi")
    j = items.join(valid.hint("merge"), ["video_id", "fingerprint"], "left")
    return j.where(F.col("item_no") >= F.coalesce("done_items", F.lit(0))).select(*items.columns)
