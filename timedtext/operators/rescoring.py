"""Scores that are taken again: after rendering, after an edit, and from the signals of a dubbed video."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from .folding import bind
from .reports import REPORT_WEIGHTS
from .scorecards import HARD_CODES, SOFT_CODES, budget

# Weights of a rendered video's report, marks of the parts, and codes that an edit takes back.
RENDERED_WEIGHTS = {"direct": 0.43, "chronology": 0.16, "evidence": 0.09, "character": 0.06, "duration": 0.10, "story": 0.07, "coverage": 0.05, "style": 0.04}
MATCH, PART_MARK, REPORT_MARK = 0.75, 85.0, 90.0
EDIT_CODES = ("LOW_VISUAL_MATCH", "VOICE_VIDEO_DRIFT", "NARRATION_DURATION_MISMATCH", "TARGET_DURATION_MISMATCH", "CHRONOLOGY")


def _weighted(weights: dict[str, float]) -> Column:
    """Weighted sum of parts in decimals, so that a tie of rounding doesn't hang on the order of a sum."""
    total = F.lit(Decimal(0))
    for name, w in weights.items():
        total = total + F.col(name).cast("decimal(12,6)") * F.lit(Decimal(str(w)))
    return total


def _codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds; a null condition doesn't."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull())


def dubbing_baselines(d: DataFrame) -> DataFrame:
    """Six baselines of a dubbed video in long form: ``(video_id, key, baseline)``.

    Over ``subtitles_expected, translation_required, narration_expected, media_ok, has_video, has_audio`` (null: unknown) ``, timeline,
    readability, sync, duration, source_count, target_count`` and ``n_empty``. What does not apply is 100; without source cues their share counts 45.
    """
    c, on = F.col, lambda name: F.coalesce(F.col(name), F.lit(False))
    filled = 100.0 * (1 - c("n_empty") / F.greatest(c("target_count"), F.lit(1)))
    content = c("timeline") * 0.45 + F.when(c("source_count") > 0, c("timeline")).otherwise(45.0) * 0.35 + filled * 0.20
    coherence = filled * 0.45 + c("timeline") * 0.30 + c("readability") * 0.25
    streams = F.when(c("has_video").isNull(), 70.0).otherwise(F.when(c("has_video"), 55.0).otherwise(0.0) + F.when(on("has_audio"), 45.0).otherwise(0.0))
    technical = c("duration") * 0.55 + F.when(on("media_ok"), 25.0).otherwise(0.0) + streams * 0.20
    silent = on("narration_expected") & ~F.coalesce("has_audio", F.lit(True))
    subtitled = lambda x: F.when(on("subtitles_expected"), x).otherwise(100.0)
    values = (
        subtitled(content),
        subtitled(F.when(on("translation_required"), F.least(content, F.lit(60.0))).otherwise(100.0)),
        c("sync"),
        subtitled(coherence),
        F.when(silent, F.least(technical, F.lit(50.0))).otherwise(technical),
        F.lit(100.0),
    )
    rows = F.array(*[F.struct(F.lit(k).alias("key"), S.clamp(v).alias("baseline")) for k, v in zip(S.CRITERIA, values)])
    return d.select("video_id", F.explode(rows).alias("x")).select("video_id", "x.key", "x.baseline")


def rendered_scores(segments: DataFrame, judged: DataFrame, black: DataFrame) -> DataFrame:
    """``(video_id, seq, score, direct)`` of every segment of a rendered video.

    ``judged(video_id, seq, score, direct_match)``: a segment's verdict, or a score of 0.75, decides on which side of 0.75 the score is
    held; of repeated rows the lowest score counts. A segment without one keeps ``match_score`` (none: 0) of ``segments``; those in ``black`` are 0.
    """
    s = F.coalesce("score", F.lit(0.0))
    j = judged.groupBy("video_id", "seq").agg(F.min(F.struct(s.alias("s"), F.coalesce("direct_match", s >= MATCH).alias("d"))).alias("x"))
    j = j.select("video_id", "seq", F.col("x.s").alias("__s"), F.col("x.d").alias("__d"))
    b = black.select("video_id", "seq", F.lit(True).alias("__black")).distinct()
    d = segments.select("video_id", "seq", F.coalesce("match_score", F.lit(0.0)).alias("__old"))
    d = d.join(j.hint("merge"), ["video_id", "seq"], "left").join(b.hint("merge"), ["video_id", "seq"], "left")
    held = F.when(F.col("__d"), F.greatest(F.lit(MATCH), "__s")).otherwise(F.least(F.lit(0.74), "__s"))
    # The least of 0.74 and a null would be 0.74.
    score = F.when(F.col("__black"), 0.0).when(F.col("__s").isNull(), F.col("__old")).otherwise(held)
    direct = F.coalesce(~F.col("__black"), F.lit(True)) & F.coalesce("__d", F.col("__old") >= MATCH)
    return d.select("video_id", "seq", score.alias("score"), direct.alias("direct"))


def post_render_report(videos: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(report, issues)`` of rendered videos from ``rendered_scores`` and ``videos(video_id, measured_s, expected_s, minutes, chronology,
    evidence, character, story, coverage, style)``, whose parts come from the report before rendering.

    A drift over half a second costs 15 a second and holds chronology down. ``issues(video_id, seq, code)`` are all errors.
    """
    good = scored.groupBy("video_id").agg(F.sum((F.col("score") >= MATCH).cast("int")).alias("__good"), F.count("*").alias("__n"), F.sum((~((F.col("score") >= MATCH) & F.col("direct"))).cast("int")).alias("__bad"))
    d = videos.join(good.hint("merge"), "video_id", "left")
    drift = F.abs(F.col("measured_s") - F.col("expected_s"))
    duration, in_time = S.duration_adherence("measured_s", "minutes")
    d = d.withColumns({"direct": 100.0 * F.coalesce("__good", F.lit(0)) / F.coalesce("__n", F.lit(1)), "__drift": drift, "duration": duration, "__ok": in_time})
    sync = F.when(F.col("__drift") <= 0.5, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.col("__drift") * 15))
    codes = _codes(
        (F.col("__drift") > 0.5, "VOICE_VIDEO_DRIFT"), (~F.col("__ok"), "TARGET_DURATION_MISMATCH"), (F.col("story") < PART_MARK, "NARRATIVE_LOGIC"), (F.col("style") < PART_MARK, "STYLE_MISMATCH")
    )
    d = d.withColumn("chronology", F.least("chronology", sync)).withColumn("__codes", codes).withColumn("__overall", _weighted(RENDERED_WEIGHTS))
    clean = (F.size("__codes") == 0) & (F.coalesce("__bad", F.lit(0)) == 0)
    two = lambda c: F.bround(c, 2).alias(c)
    report = d.select("video_id", two("__overall").cast("double").alias("overall"), two("direct"), two("chronology"), "duration", F.coalesce("__bad", F.lit(0)).cast("long").alias("n_mismatches"), ((F.col("__overall") >= REPORT_MARK) & clean).alias("passed"))
    mismatch = scored.where(~((F.col("score") >= MATCH) & F.col("direct"))).select("video_id", "seq", F.lit("POST_RENDER_VISUAL_MISMATCH").alias("code"))
    issues = d.select("video_id", F.lit(None).cast(scored.schema["seq"].dataType).alias("seq"), F.explode("__codes").alias("code"))
    return report, mismatch.unionByName(issues)


def rescore_after_edit(videos: DataFrame, beats: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(report, issues)`` after an edit: five parts are taken again, the others stay.

    ``videos(video_id, minutes, wanted_style, evidence, character, story, coverage, style, edited_seq, reassessed)`` holds the parts as they
    are now; ``beats(video_id, seq, narration, match_score, start_ms)``; ``issues(video_id, seq, severity, code)`` are those before.
    Issues that the edit may have settled go and are raised again where they hold; soft codes become warnings. ``passed`` asks for 90
    and no error, ``may_render`` for no error with a blocking code.
    """
    last = F.last("start_ms", True).over(Window.partitionBy("video_id").orderBy("seq").rowsBetween(-(1 << 31), -1))
    b = beats.withColumn("__back", F.coalesce(last > F.col("start_ms") + 250, F.lit(False)))
    g = b.groupBy("video_id").agg(
        F.sum(F.coalesce((F.col("match_score") >= MATCH).cast("int"), F.lit(0))).alias("__good"),
        F.count("*").alias("__n"),
        F.max("__back").alias("__back"),
        F.sum(F.coalesce(T.word_count("narration"), F.lit(0))).alias("__words"),
    )
    d = videos.join(g.hint("merge"), "video_id", "left").withColumns({f"__{k}": c for k, c in budget("minutes", "wanted_style").items()})
    words, back = F.coalesce("__words", F.lit(0)), F.coalesce("__back", F.lit(False))
    d = d.withColumns({
        "direct": 100.0 * F.coalesce("__good", F.lit(0)) / F.coalesce("__n", F.lit(1)),
        "chronology": F.when(back, 60.0).otherwise(100.0),
        "duration": F.greatest(F.lit(0.0), 100 - F.abs(words - F.col("__target_words")) / F.greatest("__target_words", F.lit(1)) * 250),
    })
    kept = issues.join(d.select("video_id", "edited_seq", "reassessed").hint("merge"), "video_id").where(~F.col("code").isin(*EDIT_CODES))
    kept = kept.where(~((F.col("code") == "POST_RENDER_VISUAL_MISMATCH") & F.col("seq").eqNullSafe(F.col("edited_seq")) & F.col("edited_seq").isNotNull()))
    kept = kept.where(~(F.coalesce("reassessed", F.lit(False)) & F.col("code").isin("NARRATIVE_LOGIC", "STYLE_MISMATCH"))).select("video_id", "seq", "severity", "code")
    # A low part is raised once: not where an issue of its code was kept.
    had = kept.where(F.col("code").isin("NARRATIVE_LOGIC", "SOURCE_COVERAGE", "STYLE_MISMATCH")).groupBy("video_id").agg(F.collect_set("code").alias("__had"))
    new = d.join(had.hint("merge"), "video_id", "left")
    low = _codes((F.col("story") < PART_MARK, "NARRATIVE_LOGIC"), (F.col("coverage") < PART_MARK, "SOURCE_COVERAGE"), (F.col("style") < PART_MARK, "STYLE_MISMATCH"))
    low = F.array_except(low, F.coalesce("__had", F.array().cast("array<string>")))
    sure = _codes((~words.between(F.col("__min_words"), F.col("__max_words")), "NARRATION_DURATION_MISMATCH"), (back, "CHRONOLOGY"))
    seq = F.lit(None).cast(issues.schema["seq"].dataType).alias("seq")
    raised = new.select("video_id", seq, F.lit("error").alias("severity"), F.explode(F.concat(sure, low)).alias("code"))
    weak = beats.where(F.col("match_score") < MATCH).select("video_id", "seq", F.lit("error").alias("severity"), F.lit("LOW_VISUAL_MATCH").alias("code"))
    every = kept.unionByName(raised).unionByName(weak)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    error = F.col("severity") == "error"
    soft = F.col("code").isin(*SOFT_CODES)
    counts = every.groupBy("video_id").agg(n(error).alias("__errors"), n(error & ~soft & F.col("code").isin(*HARD_CODES)).alias("__hard"))
    r = d.withColumn("__overall", _weighted(REPORT_WEIGHTS)).join(counts.hint("merge"), "video_id", "left")
    two = lambda c: F.bround(c, 2).alias(c)
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    report = r.select("video_id", two("__overall").cast("double").alias("overall"), two("direct"), "chronology", two("duration"), ((F.col("__overall") >= REPORT_MARK) & none("__errors")).alias("passed"), none("__hard").alias("may_render"))
    return report, every.withColumn("severity", F.when(soft, "warning").otherwise(F.col("severity")))


def refresh_requirements(segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """``(video_id, seq, characters, actions, objects, locations)``: what a narration asks of the scene chosen for it.

    ``segments(video_id, seq, scene_id, narration)``, ``scenes(video_id, scene_id, characters, actions, objects, location)``. Characters and objects named
    in the narration, the action that the narration overlaps most (0.35 or more; the first of equals) and the location (0.4 or more).
    Segments whose scene is missing are left out, as their requirements stay as they were.
    """
    d = segments.join(scenes.hint("merge"), ["video_id", "scene_id"])

    def asked(n: Column) -> Column:
        """All fields for a narration ``n`` in lower case with its tokens, which are found once for all phrases."""
        said, heard = n["said"], n["heard"]
        named = lambda x: F.contains(said, F.lower(x))
        # Shared tokens are no more than a phrase's: a phrase that is too short needs no comparison.
        short = lambda t: F.size(t) / F.size(heard) < 0.35
        share = lambda x: bind(T.tokens(x), lambda t: F.when((F.size(heard) == 0) | short(t), 0.0).otherwise(T.shared_tokens(heard, t)))
        # Negative positions, so that the greatest struct of equal shares is the first action.
        ranked = F.transform("actions", lambda x, i: F.struct(share(x).alias("share"), (-i).alias("i"), x.alias("action")))
        best = F.array_max(F.filter(ranked, lambda x: (x["share"] >= 0.35) & (x["action"] != "")))
        within = lambda x: bind(T.tokens(x), lambda t: T.shared_tokens(t, heard))
        where = (F.col("location") != "") & (within(F.col("location")) >= 0.4)
        none = F.array().cast("array<string>")
        return F.struct(
            F.filter("characters", named).alias("characters"),
            bind(best, lambda b: F.when(b.isNull(), none).otherwise(F.array(b["action"]))).alias("actions"),
            F.filter("objects", lambda x: named(x) | (within(x) >= 0.8)).alias("objects"),
            F.when(where, F.array("location")).otherwise(none).alias("locations"),
        )

    narration = F.struct(F.lower("narration").alias("said"), T.tokens("narration").alias("heard"))
    return d.select("video_id", "seq", F.explode(F.array(bind(narration, asked))).alias("x")).select("video_id", "seq", "x.*")
