"""Given examples and edge cases of beats, weak clips, repair after an edit, the quality report, regions and names."""

from timedtext.operators import alignment as A
from timedtext.operators import matching as M
from timedtext.operators import quality as Q
from timedtext.operators import regions as R

BEAT = "video_id long, beat_no long, text string, hint_start_ms long, hint_end_ms long"
CUE = "video_id long, cue_no long, start_ms long, end_ms long, text string"
CLIP = "video_id long, seq long, pos long, candidate_id long, start_ms long, score double, supports boolean"
DEC = "video_id long, seq long, candidate_id long, start_ms long, score double"


def test_beats(spark):
    cues = [(1, 0, 0, 6000, "the red fox runs"), (1, 1, 6000, 12000, "a storm breaks over the harbour"), (1, 2, 12000, 20000, "the fox hides in the harbour"), (1, 3, 20000, 26000, None), (2, 0, 0, 1000, "lone")]
    beats = [(1, 0, "fox runs", None, None), (1, 1, "storm harbour", None, None), (1, 2, None, 70000, 65000), (1, 3, "no such words", -5, None), (2, 0, "", None, None), (3, 0, "x", None, None)]
    out = A.align_beats(spark.createDataFrame(beats, BEAT), spark.createDataFrame(cues, CUE), spark.createDataFrame([(1, 90_000), (2, 2_000)], "video_id long, duration_ms long"))
    got = {(r.video_id, r.beat_no): (r.start_ms, r.end_ms, r.source) for r in out.collect()}
    assert got[1, 0] == (0, 6000, "transcript_match") and got[1, 1][0] == 6000 and got[1, 1][2] == "transcript_match"
    assert got[1, 2] == (70000, 88000, "ai_hint") and got[1, 3][2] == "chronological_fallback" and got[1, 3][0] >= 76000
    assert got[2, 0] == (0, 3000, "chronological_fallback") and (3, 0) not in got
    none = A.align_beats(spark.createDataFrame([], BEAT), spark.createDataFrame([], CUE), spark.createDataFrame([], "video_id long, duration_ms long"))
    assert none.count() == 0


def test_weak_clips(spark):
    now = [(1, 0, 10, 5000, 0.9), (1, 1, 20, 9000, 0.5), (1, 2, None, None, None), (1, 3, 40, 8000, 0.2), (1, 4, 50, 20000, 0.8)]
    more = [(1, 1, 1, 21, 4000, 0.99, True), (1, 1, 2, 22, 4800, 0.8, True), (1, 1, 3, 23, 8200, 0.8, True), (1, 1, 4, 24, 6000, 0.9, False), (1, 1, 5, 20, 6000, 0.95, True), (1, 3, 1, 41, 100, 0.75, True), (1, 3, 2, 42, 20300, 0.9, True), (1, 0, 1, 11, 5000, 1.0, True), (9, 1, 1, 91, 1, 1.0, True)]
    out = A.replace_weak(spark.createDataFrame(now, DEC), spark.createDataFrame(more, CLIP))
    got = {r.seq: (r.candidate_id, r.replaced) for r in out.collect()}
    # The second starts before the first one does, the third no more than a quarter of a second before it and in time for the next clip.
    assert got == {0: (10, False), 1: (22, True), 2: (None, False), 3: (41, True), 4: (50, False)}
    assert A.replace_weak(spark.createDataFrame([], DEC), spark.createDataFrame([], CLIP)).count() == 0


def test_repair(spark):
    words = "one two three four five six seven eight nine ten"
    segments = [(1, k, words) for k in range(20)] + [(2, 0, None)]
    clips = [(1, k, 0, k * 10, k * 1000, 0.9) for k in range(20)] + [(1, 11, 1, 110, 11000, 0.95), (1, 11, 2, 112, 500, 1.0)]
    s = spark.createDataFrame(segments, "video_id long, seq long, narration string")
    c = spark.createDataFrame(clips, "video_id long, seq long, pos long, candidate_id long, start_ms long, score double")
    b = spark.createDataFrame([(1, 100, 120)], "video_id long, target_words long, max_words long")
    got = [(r.video_id, r.seq, r.new_seq, r.candidate_id, r.replaced) for r in A.repair_edit(s, c, b).orderBy("video_id", "seq").collect()]
    kept = [0, 2, 4, 6, 8, 11, 13, 15, 17, 19]
    assert got == [(1, k, i + 1, k * 10, False) for i, k in enumerate(kept)] + [(2, 0, 1, None, False)]
    assert A.repair_edit(s.limit(0), c, b).count() == 0


def test_quality_report_edges(spark):
    videos = spark.createDataFrame([(1, 1, "story", None, None, None, None), (2, 1, None, 50.0, 60.0, False, False)], "video_id long, minutes long, style string, coherence double, style_score double, logic_passed boolean, style_passed boolean")
    segments = spark.createDataFrame([(1, 0, 1, "hook", "Sau đó, a. b? c", None), (1, 1, 1, None, None, False), (9, 0, 1, "hook", "x", True)], "video_id long, seq long, event_no long, story_role string, narration string, supported boolean")
    events = spark.createDataFrame([(1, 1, 1, 0, None)], "video_id long, event_no long, order_index long, start_ms long, verified boolean")
    scenes = spark.createDataFrame([(1, 7, 0, 9000, None, 2, True), (1, 8, 9000, 9500, ["UNKNOWN", "Ann"], None, True)], "video_id long, scene_id long, start_ms long, end_ms long, characters array<string>, n_evidence long, usable boolean")
    decisions = spark.createDataFrame([(1, 0, 1, 7, 100, 0.9), (1, 1, 5, None, None, None)], "video_id long, seq long, event_no long, scene_id long, start_ms long, match_score double")
    got = {r.video_id: r for r in Q.quality_report(videos, segments, events, scenes, decisions).collect()}
    assert set(got) == {1, 2} and got[1].n_sentences == 3 and got[1].direct == 50.0 and got[1].coverage == 100.0 and got[1].character == 98.0 and got[1].story == 100.0
    codes = {(x.code, x.seq) for x in got[1].issues}
    assert codes == {("NO_CLIP", 1), ("UNVERIFIED_EVENT", None), ("NARRATION_DURATION_MISMATCH", None)}
    assert (got[2].story, got[2].style, got[2].n_words, got[2].passed) == (50.0, 60.0, 0, False) and {"NARRATIVE_LOGIC", "STYLE_MISMATCH", "SOURCE_COVERAGE"} <= {x.code for x in got[2].issues}


def test_covered_boxes(spark):
    rows = [(1, 1, None, None, None, 2.0, 10.0, 20.0, 20.0), (1, 2, True, None, None, 60.0, 78.0, 20.0, 8.0), (1, 3, False, 0, 1000, 60.0, 40.0, 10.0, 10.0), (1, 4, False, 500, 1500, 60.0, 40.0, 10.0, 9.0), (1, 5, False, 1000, 2000, 60.0, 40.0, 10.0, 8.0), (2, 6, False, None, None, 60.0, 78.0, 20.0, 8.0), (2, 7, False, None, None, None, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "video_id long, region_id long, validated boolean, start_ms long, end_ms long, x double, y double, w double, h double")
    band = spark.createDataFrame([(1, 5.0, 76.0, 90.0, 12.0), (1, 5.0, 10.0, 9.0, 2.0)], "video_id long, x double, y double, w double, h double")
    got = {r.region_id: (r.y, r.h) for r in R.blur_boxes(d, band).collect()}
    assert got == {1: (0.0, 13.0), 3: (40.0, 10.0), 5: (40.0, 8.0), 6: (78.0, 8.0), 7: (0.0, 1.0)}
    assert R.blur_boxes(d.limit(0), band).count() == 0


def test_called_names(spark):
    texts = ["Will, what are you doing? Come here, Mark.", "The captain saw Jean-Luc. Anna left.\nAnna came; Zoé and O'Brien too", None, "", "THE END ÉJohn xAnn"]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "video_id long, cue_no long, text string")
    got = {r.name: (r.n, r.n_inside, r.vocative) for r in M.mine_names(d, ["the", "will", "mark", "come"]).collect()}
    assert got == {"Will": (0, 0, True), "Mark": (0, 0, True), "Jean-Luc": (1, 1, False), "Anna": (2, 0, False), "Brien": (1, 1, False), "END": (1, 1, False)}
