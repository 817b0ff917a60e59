"""Known values of the scores that are taken again."""

from timedtext.operators import rescoring as R

VIDEO = "video_id long, measured_s double, expected_s double, minutes int, chronology double, evidence double, character double, story double, coverage double, style double"


def test_rendered_segments_are_held_to_the_side_of_their_verdict(spark):
    seg = spark.createDataFrame([(1, i, m) for i, m in enumerate([0.9, 0.9, 0.5, 0.8, None, 0.9])], "video_id long, seq int, match_score double")
    judged = spark.createDataFrame([(1, 0, 0.2, True), (1, 1, 0.95, False), (1, 2, 0.76, None), (1, 5, 0.99, True), (1, 5, 0.3, None)], "video_id long, seq int, score double, direct_match boolean")
    black = spark.createDataFrame([(1, 3)], "video_id long, seq int")
    got = {r.seq: (r.score, r.direct) for r in R.rendered_scores(seg, judged, black).collect()}
    assert got == {0: (0.75, True), 1: (0.74, False), 2: (0.76, True), 3: (0.0, False), 4: (0.0, False), 5: (0.3, False)}


def test_a_good_render_passes_and_drift_fails_it(spark):
    scored = spark.createDataFrame([(1, 0, 0.9, True), (2, 0, 0.9, True)], "video_id long, seq int, score double, direct boolean")
    videos = spark.createDataFrame([(1, 60.0, 60.4, 1, *[100.0] * 6), (2, 60.0, 62.0, 1, *[100.0] * 6), (3, 60.0, 60.0, 1, *[100.0] * 6)], VIDEO)
    report, issues = R.post_render_report(videos, scored)
    got = {r.video_id: (r.overall, r.direct, r.chronology, r.passed) for r in report.collect()}
    assert got == {1: (100.0, 100.0, 100.0, True), 2: (95.2, 100.0, 70.0, False), 3: (57.0, 0.0, 100.0, False)}
    assert [tuple(r) for r in issues.collect()] == [(2, None, "VOICE_VIDEO_DRIFT")]
    empty = R.post_render_report(videos.limit(0), scored.limit(0))
    assert [d.count() for d in empty] == [0, 0]


def test_an_edit_settles_its_issues_and_keeps_the_others(spark):
    text = " ".join(["word"] * 205)
    beats = spark.createDataFrame([(1, 0, text, 0.9, 5000), (1, 1, None, 0.5, None), (1, 2, "", None, 4000)], "video_id long, seq int, narration string, match_score double, start_ms long")
    video = spark.createDataFrame([(1, 1, "story", 100.0, 100.0, 80.0, 100.0, 80.0, 7, False)], "video_id long, minutes int, wanted_style string, evidence double, character double, story double, coverage double, style double, edited_seq int, reassessed boolean")
    old = [(1, 7, "error", "POST_RENDER_VISUAL_MISMATCH"), (1, 8, "error", "POST_RENDER_VISUAL_MISMATCH"), (1, None, "error", "VOICE_VIDEO_DRIFT"), (1, None, "error", "STYLE_MISMATCH")]
    report, issues = R.rescore_after_edit(video, beats, spark.createDataFrame(old, "video_id long, seq int, severity string, code string"))
    r = report.first()
    assert (r.direct, r.chronology, r.duration, r.passed, r.may_render) == (33.33, 60.0, 100.0, False, False)
    want = {(8, "error", "POST_RENDER_VISUAL_MISMATCH"), (None, "warning", "STYLE_MISMATCH"), (None, "error", "NARRATIVE_LOGIC"), (None, "error", "CHRONOLOGY"), (1, "error", "LOW_VISUAL_MATCH")}
    got = [(r.seq, r.severity, r.code) for r in issues.collect()]
    assert set(got) == want and len(got) == 5


def test_baselines_of_a_video_without_subtitles(spark):
    row = (1, False, True, True, True, True, False, 0.0, 0.0, 80.0, 100.0, 0, 0, 0)
    d = spark.createDataFrame([row], "video_id long, subtitles_expected boolean, translation_required boolean, narration_expected boolean, media_ok boolean, has_video boolean, has_audio boolean, timeline double, readability double, sync double, duration double, source_count int, target_count int, n_empty int")
    got = {r.key: r.baseline for r in R.dubbing_baselines(d).collect()}
    assert got == {"content_fidelity": 100, "translation_accuracy": 100, "av_subtitle_sync": 80, "narrative_coherence": 100, "technical_quality": 50, "safety_compliance": 100}


def test_requirements_follow_the_chosen_scene(spark):
    seg = spark.createDataFrame([(1, 0, 4, "Nam opens the old gate in Hanoi"), (1, 1, 9, "x")], "video_id long, seq int, scene_id int, narration string")
    sc = spark.createDataFrame([(1, 4, ["Nam", "Lan"], ["runs away", "opens the old gate in Hanoi", "opens the old gate in Hanoi!"], ["gate", "car"], "Hanoi")], "video_id long, scene_id int, characters array<string>, actions array<string>, objects array<string>, location string")
    assert [tuple(r) for r in R.refresh_requirements(seg, sc).collect()] == [(1, 0, ["Nam"], ["opens the old gate in Hanoi"], ["gate"], ["Hanoi"])]


def test_long_narrations_are_split_once(spark):
    import time

    words = " ".join(f"wörd{i}" for i in range(20_000))
    seg = spark.createDataFrame([(1, 0, 4, words)], "video_id long, seq int, scene_id int, narration string")
    lines = [f"wörd{i} other{i}" for i in range(3_000)]
    sc = spark.createDataFrame([(1, 4, [], [*lines, words[:90_000]], ["nothing"], "wörd1 none at all")], "video_id long, scene_id int, characters array<string>, actions array<string>, objects array<string>, location string")
    start = time.monotonic()
    assert [tuple(r) for r in R.refresh_requirements(seg, sc).collect()] == [(1, 0, [], [words[:90_000]], [], [])]
    assert time.monotonic() - start < 20
