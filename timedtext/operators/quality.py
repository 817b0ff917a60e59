"""The quality report of a review before rendering: eight parts of unlike tables from one shuffle.

Every table gives narrow rows with its own field; one union is grouped by video once, and the parts are expressions over the sorted lists
of a video. A review has some hundreds of segments, events and scenes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .reports import REPORT_WEIGHTS
from .rescoring import MATCH, PART_MARK, REPORT_MARK, _weighted
from .scorecards import budget
from .segments import leading_marker

#: The parts of a story in their order, and the most that a list-like script scores for style.
ROLES = ("hook", "context", "conflict", "climax", "resolution")
LISTED_STYLE, VERIFIED_MARK = 84.0, 95.0


def _each_step(rows: Column, good: Callable[[Column, Column], Column]) -> Column:
    """``good`` holds for all neighbours of a list."""
    return F.when(F.size(rows) > 1, F.forall(F.sequence(F.lit(1), F.size(rows) - 1), lambda i: good(F.get(rows, i - 1), F.get(rows, i)))).otherwise(True)


def _role(i: Column, n: Column) -> Column:
    p = i / F.greatest(n - 1, F.lit(1))
    return F.when(i == 0, ROLES[0]).when(i == n - 1, ROLES[4]).when(p <= 0.25, ROLES[1]).when(p <= 0.65, ROLES[2]).when(p <= 0.85, ROLES[3]).otherwise(ROLES[4])


def _coverage(scenes: Column, chosen: Column, minutes: Column) -> Column:
    """0.65 of the near-equal runs of scenes with a chosen one, 0.35 of the span that the chosen ones reach over."""
    n = F.size(scenes)
    runs = F.least(n, F.greatest(F.lit(4), F.least(F.greatest(F.lit(1), minutes) * 4, n)))
    small, more = F.floor(n / F.greatest(runs, F.lit(1))), n % F.greatest(runs, F.lit(1))
    large = more * (small + 1)
    run = lambda i: F.when(i < large, F.floor(i / (small + 1))).otherwise(more + F.floor((i - large) / F.greatest(small, F.lit(1))))
    hit = F.filter(F.transform(scenes, lambda s, i: F.when(F.array_contains(chosen, s["scene_id"]), F.struct(run(i).alias("run"), s["start_ms"].alias("a"), s["end_ms"].alias("b")))), lambda x: x.isNotNull())
    full = F.array_max(F.transform(scenes, lambda s: s["end_ms"])) - F.get(scenes, F.lit(0))["start_ms"]
    reach = F.array_max(F.transform(hit, lambda x: x["b"])) - F.array_min(F.transform(hit, lambda x: x["a"]))
    span = F.when(full <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), reach / full)))
    share = F.size(F.array_distinct(F.transform(hit, lambda x: x["run"]))) / runs
    return F.when((n > 0) & (F.size(hit) > 0), F.bround(100 * (share * 0.65 + span * 0.35), 2)).otherwise(0.0)


def quality_report(videos: DataFrame, segments: DataFrame, events: DataFrame, scenes: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row a video: the eight parts, ``overall``, ``passed``, ``meets_budget``, ``n_words``, ``n_sentences`` and ``issues(severity, code, seq)``.

    ``videos(video_id, minutes, style, coherence, style_score, logic_passed, style_passed)``, the last four null without an assessment; ``segments(video_id, seq, event_no,
    story_role, narration, supported)``; ``events(video_id, event_no, order_index, start_ms, verified)``; ``scenes(video_id, scene_id, start_ms, end_ms, characters, n_evidence,
    usable)``; ``decisions(video_id, seq, event_no, scene_id, start_ms, match_score)``, with nulls where there is no clip. ``direct`` is the share of segments
    whose clip matches; ``chronology`` falls to 60 when events or clips go back; ``evidence`` is the share of verified events; ``story`` is 100, 60 for
    an incomplete and 30 for a disordered arc; a script that repeats its opening connectives scores 84 for style at most. Passing asks
    for 90 and no error. ``meets_budget`` asks for words and sentences in range, all roles of the story and all verified events.
    Defined cases: a video without rows in a table has none there, and its parts are what an empty list gives; null narrations have no
    words, null characters no names, a null role is outside the arc; of decisions for one segment the last counts; videos that are
    not in ``videos`` are left out, one that comes twice is taken once.
    """
    n = F.coalesce("n_evidence", F.lit(0))
    names = F.coalesce("characters", F.array().cast("array<string>"))
    unknown = F.size(F.filter(names, lambda x: F.upper(x) == "UNKNOWN"))
    b = budget("minutes", "style")
    fields = {
        "v": (videos, F.struct("minutes", *[b[k].alias(k) for k in ("target_words", "min_words", "max_words", "min_segments", "max_segments")], "coherence", "style_score", "logic_passed", "style_passed")),
        "seg": (segments, F.struct("seq", "event_no", F.col("story_role").alias("role"), F.coalesce(T.word_count("narration"), F.lit(0)).alias("words"), T.sentences("narration").alias("sentences"), F.coalesce(leading_marker("narration"), F.lit("")).alias("marker"), F.coalesce("supported", F.lit(True)).alias("supported"))),
        "ev": (events, F.struct("order_index", "start_ms", "event_no", F.coalesce("verified", F.lit(False)).alias("verified"))),
        "sc": (scenes, F.struct("start_ms", "end_ms", "scene_id", unknown.alias("unknown"), F.size(names).alias("named"), (F.coalesce("usable", F.lit(False)) & (n > 0)).alias("usable"))),
        "dec": (decisions, F.struct("seq", "event_no", "scene_id", "start_ms", F.col("match_score").cast("double").alias("score"))),
    }
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [d.select("video_id", f.alias(k)) for k, (d, f) in fields.items()])
    lists = [F.array_sort(F.collect_list(k)).alias(k) for k in ("seg", "ev", "sc", "dec")]
    g = rows.groupBy("video_id").agg(F.max("v").alias("v"), *lists).where("v IS NOT NULL")
    sum_of = lambda a, f: F.aggregate(F.transform(a, f), F.lit(0).cast("long"), lambda s, x: s + x)
    clips = F.filter("dec", lambda x: x["start_ms"].isNotNull())
    order_of = lambda no: F.coalesce(F.try_element_at(F.filter("ev", lambda e: e["event_no"] == no), F.lit(-1))["order_index"], F.lit(999_999))
    told = F.when(F.exists("ev", lambda e: e["verified"]), F.filter("ev", lambda e: e["verified"])).otherwise(F.col("ev"))
    place = lambda role: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), role), F.lit(0)), F.lit(999))
    g = g.withColumns({
        "orders": F.transform("dec", lambda x: order_of(x["event_no"])),
        "needed": F.array_distinct(F.transform(told, lambda e, i: _role(i, F.size(told)))),
        "roles": F.transform("seg", lambda s: F.coalesce(s["role"], F.lit(""))),
        "markers": F.transform("seg", lambda s: s["marker"]),
        "n_words": sum_of(F.col("seg"), lambda s: s["words"]),
        "n_sentences": sum_of(F.col("seg"), lambda s: s["sentences"]),
        "unknown": sum_of(F.col("sc"), lambda s: s["unknown"]),
        "named": sum_of(F.col("sc"), lambda s: s["named"]),
    })
    most = F.greatest(F.lit(2), F.floor(F.size("seg") * F.lit(0.10)))
    often = F.exists(F.array_distinct("markers"), lambda m: (m != "") & (F.size(F.filter("markers", lambda x: x == m)) > most))
    in_row = F.exists(F.transform("markers", lambda m, i: (m != "") & (m == F.get("markers", i + 1)) & (m == F.get("markers", i + 2))), lambda x: x)
    ahead = _each_step(F.col("orders"), lambda x, y: x <= y) & _each_step(clips, lambda x, y: x["start_ms"] <= y["start_ms"] + 250)
    whole = F.size(F.array_except("needed", "roles")) == 0
    ordered = _each_step(F.transform("roles", place), lambda x, y: x <= y)
    g = g.withColumns({"listed": (F.size("seg") >= 4) & F.coalesce(often | in_row, F.lit(False)), "ahead": ahead, "whole": whole, "ordered": ordered})
    arc = F.when(F.col("whole") & F.col("ordered"), 100.0).when(F.col("ordered"), 60.0).otherwise(30.0)
    style = F.coalesce(F.col("v.style_score").cast("double"), F.lit(100.0))
    covered = _coverage(F.filter("sc", lambda s: s["usable"]), F.transform(clips, lambda x: x["scene_id"]), F.col("v.minutes").cast("int"))
    some = lambda a: F.greatest(F.size(a), F.lit(1))
    g = g.withColumns({
        "direct": 100.0 * F.size(F.filter(clips, lambda x: x["score"] >= MATCH)) / some("seg"),
        "chronology": F.when(F.col("ahead"), 100.0).otherwise(60.0),
        "evidence": 100.0 * F.size(F.filter("ev", lambda e: e["verified"])) / some("ev"),
        "character": F.when(F.col("unknown") == 0, 100.0).otherwise(F.greatest(F.lit(60.0), 100 - 4.0 * F.col("unknown") / F.greatest("named", F.lit(1)))),
        "duration": F.greatest(F.lit(0.0), 100 - F.abs(F.col("n_words") - F.col("v.target_words")) / F.greatest("v.target_words", F.lit(1)) * 250.0),
        "story": F.least(arc, F.col("v.coherence").cast("double")),
        "coverage": covered,
        "style": F.when(F.col("listed"), F.least(style, F.lit(LISTED_STYLE))).otherwise(style),
    })
    words_ok = F.col("n_words").between(F.col("v.min_words"), F.col("v.max_words"))
    issue = lambda bad, severity, code: F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(None).cast(segments.schema["seq"].dataType).alias("seq")))

    def own(s: Column) -> Column:
        clip = F.try_element_at(F.filter("dec", lambda x: x["seq"] == s["seq"]), F.lit(-1))
        code = F.when(clip.isNull() | clip["start_ms"].isNull(), "NO_CLIP").when(clip["score"] < MATCH, "LOW_VISUAL_MATCH").when(~s["supported"], "UNSUPPORTED_NARRATION")
        return F.when(code.isNotNull(), F.struct(F.lit("error").alias("severity"), code.alias("code"), s["seq"].alias("seq")))

    whole_video = F.array(
        issue(~F.col("ahead"), "error", "CHRONOLOGY"),
        issue(F.col("evidence") < VERIFIED_MARK, "warning", "UNVERIFIED_EVENT"),
        issue(~words_ok, "error", "NARRATION_DURATION_MISMATCH"),
        issue(~(F.col("whole") & F.col("ordered")), "error", "STORY_ARC_INCOMPLETE"),
        issue(~F.col("v.logic_passed"), "error", "NARRATIVE_LOGIC"),
        issue(~F.col("v.style_passed"), "error", "STYLE_MISMATCH"),
        issue(F.col("listed"), "error", "REPETITIVE_TRANSITIONS"),
        issue(F.col("coverage") < PART_MARK, "error", "SOURCE_COVERAGE"),
    )
    g = g.withColumn("issues", F.filter(F.concat(F.transform("seg", own), whole_video), lambda x: x.isNotNull()))
    verified = F.transform(F.filter("ev", lambda e: e["verified"]), lambda e: e["event_no"])
    meets = words_ok & F.col("n_sentences").between(F.col("v.min_segments"), F.col("v.max_segments")) & F.col("whole") & (F.size(F.array_except(verified, F.transform("seg", lambda s: s["event_no"]))) == 0)
    overall = _weighted(REPORT_WEIGHTS)
    two = lambda c: F.bround(F.col(c).cast("decimal(12,6)"), 2).cast("double").alias(c)
    passed = (overall >= REPORT_MARK) & ~F.exists("issues", lambda x: x["severity"] == "error")
    return g.select("video_id", F.bround(overall, 2).cast("double").alias("overall"), *[two(k) for k in REPORT_WEIGHTS], passed.alias("passed"), meets.alias("meets_budget"), "n_words", "n_sentences", "issues")
