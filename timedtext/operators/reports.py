"""Scene predicates and quality reports: which scenes carry plot, how reports are weighted, gated and updated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from .folding import bind, fold

# Markers of credits, and verbs that claim that somebody speaks.
CREDIT_MARKERS = ("credit", "staff", "cast list", "production list", "end card", "ending card", "title card", "illustration", "poster", "teaser", "logo", "rolling text", "static text", "are shown", "is shown", "displayed", "scrolling names", "character still", "montage still", "片尾", "制作", "字幕")
SPEECH_VERBS = "nói|kể|hỏi|trả\\s+lời|giải\\s+thích|tiết\\s+lộ|đề\\s+nghị|cảnh\\s+báo|thông\\s+báo|thừa\\s+nhận|hứa|ra\\s+lệnh|cho\\s+biết|tranh\\s+cãi|gọi|quyết\\s+định"
# Weights of the parts of a report, and of the report's parts in each baseline.
REPORT_WEIGHTS = {"direct": 0.38, "chronology": 0.16, "evidence": 0.12, "character": 0.07, "duration": 0.08, "story": 0.08, "coverage": 0.06, "style": 0.05}
# Processing profiles by mode; batch items, batch characters, scenes.
PROFILES = (("fast", 32, 6000, 72), ("balanced", 28, 5400, 192), ("quality", 20, 4600, 300))


def _credits_like(c: Column, markers: tuple[str, ...]) -> Column:
    return c.rlike("(?i)" + "|".join(markers))


def _meaningful(c: Column, markers: tuple[str, ...], unknown_counts: bool = False) -> Column:
    plain = (F.trim(c) != "") & ~_credits_like(c, markers)
    return F.coalesce(plain if unknown_counts else plain & (F.upper(F.trim(c)) != "UNKNOWN"), F.lit(False))


def is_credits_only(markers: tuple[str, ...] = CREDIT_MARKERS) -> Column:
    """Flagged as credits, and no field of the scene tells plot; over ``credits, summary, dialogue, actions, visual, spoken, subtitle``."""
    acts = F.filter("actions", lambda a: F.trim(a) != "")
    plot = _meaningful(F.col("summary"), markers) | _meaningful(F.col("dialogue"), markers, True) | (F.size(F.filter(acts, lambda a: ~_credits_like(a, markers))) > 0)
    for name in ("visual", "spoken", "subtitle"):
        plot = plot | F.exists(name, lambda x: _meaningful(x, markers))
    return F.col("credits") & ~plot


def usable_scenes(scenes: DataFrame, markers: tuple[str, ...] = CREDIT_MARKERS) -> DataFrame:
    """Scenes that are neither black nor credits; all scenes of a video where none remains."""
    d = scenes.withColumn("__ok", ~F.col("black") & ~is_credits_only(markers))
    any_ = F.max(F.col("__ok").cast("int")).over(Window.partitionBy("video_id"))
    return d.withColumn("__any", any_).where("__ok or __any = 0").drop("__ok", "__any")


def unsupported_dialogue(segments: DataFrame, scenes: DataFrame, verbs: str = SPEECH_VERBS) -> DataFrame:
    """Segments that claim speech while their scene has no dialogue evidence; ``segments(video_id, seq, scene_id, narration)``."""
    heard = F.size(F.filter(F.array_distinct("spoken"), lambda x: (F.trim(x) != "") & (F.upper(F.trim(x)) != "UNKNOWN"))) > 0
    j = segments.join(scenes.select("video_id", "scene_id", heard.alias("heard")).hint("merge"), ["video_id", "scene_id"], "left")
    return j.where(F.col("narration").rlike("(?iU)\\b(" + verbs + ")\\b") & ~F.coalesce("heard", F.lit(False))).select("video_id", "seq")


def untranslated(pairs: DataFrame, target: str) -> DataFrame:
    """Rows whose translation is empty, or still has CJK characters while the target is not Chinese."""
    left = T.has_cjk("translation") if target != "zh" else F.lit(False)
    return pairs.where(F.coalesce((F.trim("translation") == "") | left, F.lit(True)))


def same_transcript(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per video with both tracks: whether the letters of the whole transcripts are equal."""

    def key(d: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("cue_no", T.alignment_key("text").alias("k"))))
        return d.groupBy("video_id").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["k"]), ""), 256).alias(name))

    return key(source, "a").join(key(target, "b").hint("merge"), "video_id").select("video_id", (F.col("a") == F.col("b")).alias("same"))


def sync_score(d: DataFrame) -> DataFrame:
    """Sync of dubbed speech: bounds .45, voice length .25, agreement .05, slots .25; held to 70 without an exact slot match
    and to 40 without sound. Over ``bounds, voice, agreement, slots, matched, has_audio, n_cues``."""
    score = S.clamp(F.col("bounds") * 0.45 + F.col("voice") * 0.25 + F.col("agreement") * 0.05 + F.col("slots") * 0.25)
    score = F.when(F.col("matched"), score).otherwise(F.least(score, F.lit(70.0)))
    score = F.when(F.col("has_audio") == F.lit(False), F.least(score, F.lit(40.0))).otherwise(score)
    label = F.when(F.col("n_cues") == 0, "missing_subtitles").when(F.col("matched"), "per_cue").otherwise("unverified")
    return d.withColumn("sync", F.when(F.col("n_cues") == 0, 0.0).otherwise(score)).withColumn("sync_source", label)


def report_overall() -> Column:
    total = F.lit(0.0)
    for name, w in REPORT_WEIGHTS.items():
        total = total + F.col(name) * w
    return F.bround(total, 2)


def review_baselines(d: DataFrame) -> DataFrame:
    """Six baselines of a report in long form: ``(video_id, key, baseline)``; a missing drift counts as 50."""
    voice = F.when(F.col("drift").isNull(), 50.0).otherwise(S.clamp(100 - F.greatest(F.lit(0.0), F.col("drift") - 0.10) * 40))
    c = F.col
    values = (
        c("evidence") * 0.38 + c("direct") * 0.34 + c("character") * 0.16 + c("coverage") * 0.12,
        c("evidence") * 0.42 + c("character") * 0.18 + c("story") * 0.15 + c("text_match") * 0.25,
        c("subtitle_sync") * 0.72 + voice * 0.20 + c("chronology") * 0.08,
        c("story") * 0.62 + c("style") * 0.20 + c("chronology") * 0.18,
        c("technical") * 0.42 + c("health") * 0.28 + c("duration") * 0.20 + c("direct") * 0.10,
        F.lit(100.0),
    )
    rows = F.array(*[F.struct(F.lit(k).alias("key"), S.clamp(v).alias("baseline")) for k, v in zip(S.CRITERIA, values)])
    return d.select("video_id", F.explode(rows).alias("x")).select("video_id", "x.key", "x.baseline")


def duration_gate(d: DataFrame) -> DataFrame:
    """A report after the voice was measured: the duration part of the overall score is replaced, and a miss fails it.

    Over ``overall, duration, passed, measured_s, minutes``.
    """
    score, ok = S.duration_adherence("measured_s", "minutes")
    d = d.withColumn("__s", score).withColumn("__ok", ok)
    overall = F.bround(S.clamp(F.col("overall") - F.col("duration") * 0.08 + F.col("__s") * 0.08), 2)
    return d.withColumn("overall", overall).withColumn("duration", F.col("__s")).withColumn("passed", F.col("passed") & F.col("__ok")).withColumn("mismatch", ~F.col("__ok")).drop("__s", "__ok")


def character_consistency(scenes: DataFrame) -> DataFrame:
    """100, or 100 less 4 times the share of unknown characters, not under 60; ``scenes(video_id, characters)``."""
    n = F.sum(F.size("characters"))
    unknown = F.sum(F.size(F.filter("characters", lambda x: F.upper(x) == "UNKNOWN")))
    g = scenes.groupBy("video_id").agg(n.alias("n"), unknown.alias("u"))
    return g.select("video_id", F.when(F.col("u") == 0, 100.0).otherwise(F.greatest(F.lit(60.0), 100 - 4.0 * F.col("u") / F.greatest("n", F.lit(1)))).alias("score"))


def black_segments(frames: DataFrame) -> DataFrame:
    """Segments with two or more black frames: missing, mean under 7 or deviation under 2; ``frames(video_id, seq, mean, std)``."""
    dark = F.coalesce((F.col("mean") < 7) | (F.col("std") < 2), F.lit(True))
    return frames.groupBy("video_id", "seq").agg(F.sum(dark.cast("int")).cast("long").alias("votes")).where("votes >= 2")


def sample_blocks(rows: DataFrame, most: int = 240, blocks: int = 12) -> DataFrame:
    """Rows of ``blocks`` centred blocks over each video, at most ``most``: ``(video_id, cue_no)``; all if there are no more."""
    per = max(4, most // blocks)
    # The blocks are placed once a video, on its sorted numbers: rounding doubles for each row would take nearly all of the time.
    d = rows.groupBy("video_id").agg(F.count("*").cast("int").alias("k"), F.array_sort(F.collect_list("cue_no")).alias("no"))
    null = F.lit(None).cast(rows.schema["cue_no"].dataType)
    d = d.withColumn("no", F.concat(F.array_repeat(null, F.col("k") - F.size("no")), "no"))
    last = F.col("k") - 1

    def block(b: int) -> Column:
        centre = F.bround(F.lit(b) * last / F.lit(max(blocks - 1, 1)), 0).cast("int")
        start = F.greatest(F.lit(0), F.least(F.col("k") - per, centre - per // 2))
        return F.sequence(start, F.least(last, start + per - 1))

    inside = F.array_sort(F.array_distinct(F.flatten(F.array(*[block(b) for b in range(blocks)]))))
    at = F.slice(F.when(F.col("k") <= most, F.sequence(F.lit(0), last)).otherwise(inside), 1, most)
    return d.withColumn("at", at).select("video_id", F.explode(F.transform("at", lambda i: F.get("no", i))).alias("cue_no"))


def verified_window(start: str, end: str, at: str) -> tuple[Column, Column]:
    """Clip of 0.3 of a scene (0.7 to 2.5 s) around a verified time, inside the scene; milliseconds."""
    span = F.greatest(F.lit(800), F.col(end) - F.col(start))
    size = F.least(F.lit(2500), F.greatest(F.lit(700), F.floor(span * F.lit(0.30) + F.lit(0.5)))).cast("long")
    first = F.greatest(F.col(start), F.least(F.col(at) - F.floor(size / 2), F.col(end) - size))
    return first, F.least(F.col(end), first + size)


def keyframe_from_text(reason: str, keyframes: str, slack_s: float = 0.06) -> Column:
    """The first keyframe time (seconds) that a text mentions, decimal commas allowed."""
    said = F.transform(F.regexp_extract_all(reason, F.lit("[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    return F.get(F.filter(keyframes, lambda k: F.exists(said, lambda v: F.abs(k - v) <= slack_s + 1e-9)), F.lit(0))


def with_profile(jobs: DataFrame, profiles: tuple = PROFILES) -> DataFrame:
    """Jobs with their profile; ``best`` is quality, an unknown or missing mode balanced. The table is a literal of fixed size."""
    mode = F.lower(F.trim("mode"))
    mode = F.when(mode == "best", "quality").when(mode.isin(*[p[0] for p in profiles]), mode).otherwise("balanced")
    d = jobs.withColumn("profile", mode)
    for k, name in enumerate(("batch_items", "batch_chars", "max_scenes"), start=1):
        value = F.lit(None).cast("int")
        for p in profiles:
            value = F.when(F.col("profile") == p[0], F.lit(p[k])).otherwise(value)
        d = d.withColumn(name, value)
    return d


def merge_evidence(a: Column | str, b: Column | str) -> Column:
    """Both lists, old first, each entry once."""
    return F.array_distinct(F.concat(a, b))


def segment_issues(segments: DataFrame, least: float = 0.75) -> DataFrame:
    """One issue per failing segment, by the first rule that fails: no clip, weak match, unsupported narration.

    ``segments(video_id, seq, match_score, supported)``; a null score is a missing clip.
    """
    code = F.when(F.col("match_score").isNull(), "NO_CLIP").when(F.col("match_score") < least, "LOW_VISUAL_MATCH").when(~F.col("supported"), "UNSUPPORTED_NARRATION")
    return segments.select("video_id", "seq", code.alias("code")).where("code is not null")


def assign_scenes(candidates: DataFrame, slack_ms: int = 250, close: int = 60) -> DataFrame:
    """``(video_id, seq, scene_id)``: a scene for each segment in order, never far back in source time.

    ``candidates(video_id, seq, event_no, scene_id, start_ms, score)`` with the score in thousandths. Of the candidates that do not
    go back (all, if all do), those within ``close`` of the best count, without the last two scenes if others remain;
    taken is the one nearest to the segment's place in its event, then the better, then the earlier. What is taken depends
    on what was taken before, so that this is a fold inside the JVM; its state is three numbers.
    """
    event = Window.partitionBy("video_id", "event_no")
    seqs = candidates.select("video_id", "event_no", "seq").distinct()
    seqs = seqs.withColumn("p", F.row_number().over(event.orderBy("seq")) - 1).withColumn("t", F.count("*").over(event))
    g = candidates.groupBy("video_id", "event_no", "seq").agg(F.array_sort(F.collect_list(F.struct("start_ms", "scene_id", "score"))).alias("c"))
    g = g.join(seqs.hint("merge"), ["video_id", "event_no", "seq"])

    def step(acc: Column, r: Column) -> Column:
        ahead = F.filter(r["c"], lambda x: x["start_ms"] + slack_ms >= acc["last"])
        pool = F.when(F.size(ahead) > 0, ahead).otherwise(r["c"])
        best = F.array_max(F.transform(pool, lambda x: x["score"]))
        near = F.filter(pool, lambda x: x["score"] >= best - close)
        fresh = F.filter(near, lambda x: (x["scene_id"] != acc["r1"]) & (x["scene_id"] != acc["r2"]))
        pick = F.when(F.size(fresh) > 0, fresh).otherwise(near)
        # Twice the distance of ranks, in units of the event's steps, keeps the comparison in whole numbers.
        n, t = F.size(pool) - 1, F.greatest(r["t"] - 1, F.lit(1))
        ideal = F.when(r["t"] <= 1, n * t).otherwise(2 * r["p"] * n)
        ranked = F.transform(pick, lambda x: F.struct(F.abs(2 * t * (F.array_position(pool, x) - 1) - ideal).alias("d"), (-x["score"]).alias("s"), x["start_ms"].alias("start_ms"), x["scene_id"].alias("scene_id")))
        return bind(F.array_min(ranked), lambda took: F.struct(F.greatest(acc["last"], took["start_ms"]).alias("last"), took["scene_id"].alias("r1"), acc["r1"].alias("r2")))

    none = F.lit(-1).cast("long")
    zero = F.struct(none.alias("last"), none.alias("r1"), none.alias("r2"))
    return fold(g, ["seq"], ["p", "t", "c"], zero, step, lambda s: F.struct(s["r1"].alias("scene_id")))
