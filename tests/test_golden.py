"""Known values, invariants, files and streaming twins of the timed-text operators."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from timedtext.functions import scores as S
from timedtext.functions import text as T
from timedtext.functions import times
from timedtext.operators import cues as C
from timedtext.operators import intervals as I
from timedtext.operators import matching as M
from timedtext.operators import scorecards as K
from timedtext.operators import segments as G
from timedtext.sources import subtitles as R
from timedtext.streaming import jobs as J


def cue_rows(spark, rows):
    return spark.createDataFrame([(1, i, int(a * 1000), int(b * 1000), t) for i, (a, b, t) in enumerate(rows)], "video_id long, cue_no long, start_ms long, end_ms long, text string")


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_budget(spark):
    d = spark.createDataFrame([(8, "story")], "m int, s string")
    r = d.select(*[c.alias(k) for k, c in K.budget("m", "s").items()]).first()
    assert (r.target_words, r.min_words, r.max_words) == (1640, 1476, 1886) and r.min_segments >= 60


def test_adherence_and_tempo(spark):
    d = spark.createDataFrame([(480.0, 8), (68.568, 8), (550.968, 8), (720.0, 8)], "a double, m int")
    score, ok = S.duration_adherence("a", "m")
    rows = d.select(score.alias("s"), ok.alias("o"), S.tempo_factor("a", "m").alias("t")).collect()
    assert (rows[0].s, rows[0].o) == (100, True) and rows[1].s < 10 and not rows[1].o
    assert [r.t for r in rows] == [1.0, None, 1.14785, None]


def test_timeline(spark):
    s, t = cue_rows(spark, [(0, 4, "a")]), cue_rows(spark, [(0, 1.8, "a"), (1.8, 4, "b")])
    r = I.timeline_score(s, t).first()
    assert r.score > 99 and r.mean_offset_ms == 0
    assert I.align_tracks(s, t).where("kind = 'overlap'").count() == 2


def test_audit(spark):
    slots = spark.createDataFrame([(1, 1, 950), (1, 2, 1000)], "video_id long, idx int, available_ms long")
    got = spark.createDataFrame([(1, 1, 1200), (1, 2, 1000)], "video_id long, idx int, duration_ms long")
    r = I.audit_slots(slots, got).first()
    assert (r.n_recorded, r.n_expected, r.n_overrun, r.matched) == (2, 2, 1, False) and r.coverage <= 50


def test_clamp_and_slots(spark):
    d = spark.createDataFrame([(1, 3200)], "video_id long, duration_ms long")
    assert [r.end_ms for r in C.clamp_cues(cue_rows(spark, [(0, 6, "a"), (3.15, 4, "b")]), d).collect()] == [3200]
    touching = C.speech_slots(cue_rows(spark, [(0, 0.2, "a"), (0.2, 0.4, "b")]), d.withColumn("duration_ms", F.lit(400))).collect()
    assert sum(r.available_ms + r.gap_ms for r in touching) == 400


def test_slots_do_not_overlap_and_normalising_looks_at_dropped_rows(spark):
    n = C.normalize_cues(cue_rows(spark, [(0, 5, "a"), (2, 2, "gone"), (3, 4, "b")])).orderBy("cue_no").collect()
    assert [(r.start_ms, r.end_ms) for r in n] == [(0, 1960), (3000, 4000)]


def test_caption_clean_up_and_words(spark):
    r = one(spark, a=T.clean_caption(F.lit("3, 5 ... trước,đã")), n=T.word_count(F.lit("trước đã a1")), v=T.voice_seconds(F.lit("x")))
    assert (r.a, r.n, r.v) == ("3,5... trước, đã", 3, 2.0)


def test_identical_windows_are_sliced(spark):
    p = spark.createDataFrame([(1, 0, 7000, 9000), (1, 1, 7000, 9000)], "video_id long, seq long, start_ms long, end_ms long")
    assert [(r.slice_start_ms, r.slice_end_ms) for r in G.partition_repeats(p).orderBy("seq").collect()] == [(7000, 8000), (8000, 9000)]


def test_frames_do_not_drift(spark):
    p = spark.createDataFrame([(1, i, 4752) for i in range(100)] + [(1, 100, 480000 - 475200)], "video_id long, seq long, length_ms long")
    assert G.quantize(p, 30).agg(F.max("frame_end")).first()[0] == 14400


def test_voice_ends_exactly(spark):
    d = spark.createDataFrame([(1, 0, 5), (1, 1, 20)], "video_id long, seq long, weight long")
    r = G.allocate_voice(d, spark.createDataFrame([(1, 12345)], "video_id long, duration_ms long")).orderBy("seq").collect()
    assert r[0].voice_end_ms == r[1].voice_start_ms < r[1].voice_end_ms - r[1].voice_start_ms and r[1].voice_end_ms == 12345


def test_roles(spark):
    e = spark.createDataFrame([(1, 0, 0, 0, False)] + [(1, i, i, i, True) for i in range(1, 6)], "video_id long, event_no int, order_index int, start_ms int, verified boolean")
    assert [(r.event_no, r.role) for r in G.story_roles(e).orderBy("event_no").collect()] == [(1, "hook"), (2, "context"), (3, "conflict"), (4, "climax"), (5, "resolution")]


def test_captions_from_words(spark):
    w = [(0.2, 0.4), (0.5, 0.6), (0.7, 0.8), (0.9, 0.98), (1.8, 2.0), (2.1, 2.3), (2.4, 2.6), (2.7, 2.98)]
    words = spark.createDataFrame([(1, i, x, int(a * 1000), round(b * 1000)) for i, (x, (a, b)) in enumerate(zip("one two three four five six seven eight".split(), w))], "video_id long, word_no int, word string, start_ms long, end_ms long")
    texts = spark.createDataFrame([(1, 0, "One two, three four."), (1, 1, "Five six seven eight!")], "video_id long, text_no int, text string")
    d = spark.createDataFrame([(1, 3200)], "video_id long, duration_ms long")
    assert [(r.start_ms, r.end_ms) for r in M.time_captions(texts, words, d).orderBy("text_no").collect()] == [(120, 1160), (1720, 3160)]
    assert [(r.start_ms, r.end_ms) for r in M.time_segments(texts, words, d).orderBy("text_no").collect()] == [(0, 1720), (1720, 3200)]


def test_failed_gate_never_passes(spark):
    c = spark.createDataFrame([(1, k, 100.0, 100.0) for k in S.CRITERIA], "video_id long, key string, baseline double, judge double")
    r = K.verdict(K.blend(c), spark.createDataFrame([(1, False)], "video_id long, ok boolean")).first()
    assert (r.overall, r.passed, r.verdict) == (100, False, "needs_improvement")


def test_names(spark):
    names = spark.createDataFrame([(1, "Cara"), (1, "Karla Jones"), (1, "Bob")], "video_id long, name string")
    canon = spark.createDataFrame([(1, "Carla"), (1, "Carla Jones"), (1, "Robert")], "video_id long, name string")
    assert {(r.name, r.canonical) for r in M.fuzzy_match(names, canon).collect()} == {("Cara", "Carla"), ("Karla Jones", "Carla Jones")}
    unclear = spark.createDataFrame([(1, "Carla"), (1, "Carlo")], "video_id long, name string")
    assert M.fuzzy_match(spark.createDataFrame([(1, "Carl")], "video_id long, name string"), unclear).count() == 0


def test_markers(spark):
    d = spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(["Sau đó, anh đi.", "“Sau  đó cô về.", "Rồi họ ăn.", "Chuyện sau đó kết thúc."])], "video_id long, seq long, event_no int, narration string")
    assert [r.m for r in d.select(G.leading_marker("narration").alias("m")).collect()] == ["sau đó", "sau đó", "rồi", ""]
    assert [r.narration for r in G.strip_markers(d).orderBy("seq").collect()] == ["Sau đó, anh đi.", "Cô về.", "Họ ăn.", "Chuyện sau đó kết thúc."]


def test_grouping_keeps_the_text_and_order_of_rows_does_not_matter(spark):
    rows = [(i, i + 0.9, t) for i, t in enumerate("This is it. and then we, went home to. Nobody saw it happen but. The end!".split(" "))]
    d = cue_rows(spark, rows)
    a = C.group_cues(d).orderBy("group_no").collect()
    b = C.group_cues(d.orderBy(F.desc("cue_no"))).orderBy("group_no").collect()
    assert a == b and " ".join(r.text for r in a) == " ".join(t for _, _, t in rows)


def test_srt_files(spark, tmp_path):
    d = tmp_path / "v1"
    d.mkdir()
    (d / "subtitles.en.srt").write_text("﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\nbroken\r\n\r\n2\r\n01:00:00.250 --> 01:00:01,000 align:start\r\nCafé\r\n")
    r = R.read_srt(spark, f"{tmp_path}/*/*.srt").orderBy("cue_no").collect()
    assert [(x.video_id, x.track, x.start_ms, x.end_ms, x.text) for x in r] == [("v1", "en", 1000, 2500, "Hello there"), ("v1", "en", 3600250, 3601000, "Café")]
    R.write_srt(R.read_srt(spark, f"{tmp_path}/*/*.srt"), str(tmp_path / "out"))
    text = next((tmp_path / "out").rglob("*.txt")).read_text()
    assert text.startswith("1\n00:00:01,000 --> 00:00:02,500\nHello there\n\n2\n")


def test_job_index(spark, tmp_path):
    (tmp_path / "jobs.json").write_text('[{"job_id": "a", "status": "completed", "updated_at": "2024-01-02T00:00:00Z"}, {"status": "failed"}, 3, {"job_id": "b", "status": "queued"}]')
    r = {x.job_id: x for x in R.read_jobs(spark, str(tmp_path / "jobs.json")).collect()}
    assert set(r) == {"a", "b"} and r["a"].completed_at == r["a"].updated_at and r["b"].completed_at is None


@pytest.mark.parametrize("text,ms,clock", [("00:00:01,5", 1500, 1500), ("bad", 0, None), ("1:02", 0, 62000), (None, 0, None), ("1:x:3", 0, None)])
def test_timestamps(spark, text, ms, clock):
    d = spark.createDataFrame([(text,)], "t string").select(times.parse_timestamp("t").alias("a"), times.parse_clock("t").alias("b")).first()
    assert (d.a, d.b) == (ms, clock)


def test_tracks_switch_only_when_a_box_persists(spark):
    boxes = [(0, 1.0), (1, 1.1), (2, 50.0), (3, 1.0), (4, 50.0), (5, 50.5), (6, 51.0), (7, None)]
    d = spark.createDataFrame([(1, f, x, *([1.0, 2.0, 2.0] if x is not None else [None] * 3)) for f, x in boxes], "video_id long, frame long, x double, y double, w double, h double")
    assert [r.x for r in J.track_boxes(d).orderBy("frame").collect()] == [1.0, 1.1, 1.1, 1.0, 1.0, 1.0, 51.0, 51.0]


def test_a_track_ends_after_misses_and_takes_what_comes_next(spark):
    boxes = [1.0, *[None] * 3, *[60.0] * 2, None, 60.0]
    d = spark.createDataFrame([(v, f, x, *([1.0, 2.0, 2.0] if x is not None else [None] * 3)) for v in (1, 2) for f, x in enumerate(boxes)], "video_id long, frame long, x double, y double, w double, h double")
    got = [r.x for r in J.track_boxes(d.unionByName(d), hold=4).where("video_id = 2").orderBy("frame").collect()]
    # Two boxes of another place are misses as well: the second of them ends the track.
    assert got == [1.0, 1.0, 1.0, 1.0, 1.0, None, None, 60.0]


def test_tracks_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(v, f, *((None,) * 4 if (f + v) % 7 == 3 else (float((f * v) % 40), 80.0, 20.0, 5.0))) for v in range(4) for f in range(40)]
    schema = "video_id long, frame long, x double, y double, w double, h double"
    for part in (rows[::-1][:80], rows[::-1][80:]):
        spark.createDataFrame(sorted(part, key=lambda r: r[1], reverse=True), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    q = J.track_boxes_stream(s).writeStream.outputMode("append").format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    _drain(q)
    want = J.track_boxes(spark.createDataFrame(rows, schema)).collect()
    assert len(want) == 160 and sorted(map(str, spark.table("tracks").collect())) == sorted(map(str, want))


def _feed(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "feed"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))


def _drain(query, limit=90):
    began = time.time()
    while query.isActive and time.time() - began < limit:
        query.awaitTermination(2)
    query.stop()


def test_current_jobs_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i % 5, i, ["queued", "processing", "completed"][i % 3], i % 101, at + dt.timedelta(minutes=(i * 7) % 50)) for i in range(60)]
    schema = "job_id long, event_id long, status string, progress long, updated_at timestamp"
    s = _feed(spark, tmp_path, rows, schema)
    q = J.current_jobs_stream(s).writeStream.outputMode("complete").format("memory").queryName("current").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    _drain(q)
    got = sorted(map(tuple, spark.table("current").collect()))
    assert got == sorted(map(tuple, K.current_jobs(spark.createDataFrame(rows, schema)).drop("created_at").collect()))


def test_stalled_jobs_expire(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "job_id long, status string, updated_at timestamp"
    s = _feed(spark, tmp_path, [(1, "processing", at), (2, "queued", at), (2, "completed", at + dt.timedelta(minutes=5)), (3, "queued", at + dt.timedelta(hours=3))], schema)
    out = J.expire_jobs_stream(s)
    start = lambda: out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    _drain(start())
    spark.createDataFrame([(9, "completed", at + dt.timedelta(hours=3, minutes=20))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    _drain(start())
    got = {(r.job_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (1, "failed") in got and (2, "failed") not in got and (3, "failed") not in got


def test_names_in_texts(spark):
    from timedtext.operators import texts as X

    a = spark.createDataFrame([(1, "Ann", "Anna", 1), (1, "Ann Lee", "Anna Lee", 1), (1, "Bob", "Robert", 2), (1, "Bob", "Bobby", 1)], "video_id long, alias string, canonical string, priority int")
    t = spark.createDataFrame([(1, "Ann  Lee met Ann; Annex, Anna and Bob."), (2, "Ann"), (1, None)], "video_id long, text string")
    once = X.replace_names(t, a)
    assert sorted(map(str, (r.text for r in once.collect()))) == ["Ann", "Anna Lee met Anna; Annex, Anna and Bobby.", "None"]
    assert sorted(map(str, (r.text for r in X.replace_names(once, a).collect()))) == sorted(map(str, (r.text for r in once.collect())))


def test_regions(spark):
    from timedtext.operators import regions as R

    rows = [(1, 1, True, None, 10.0, 10.0, 10.0, 10.0), (1, 2, False, None, 11.0, 11.0, 20.0, 20.0), (1, 3, False, None, 60.0, 60.0, 10.0, 10.0), (1, 4, False, None, 62.0, 62.0, 9.0, 9.0), (1, 5, False, 2000.0, 60.0, 60.0, 10.0, 10.0)]
    d = spark.createDataFrame(rows, "video_id long, region_id long, validated boolean, start_ms double, x double, y double, w double, h double").selectExpr("*", "start_ms + 1000 AS end_ms")
    got = {r.region_id: (r.x, r.w) for r in R.merge_regions(d).collect()}
    assert got == {1: (10.0, 10.0), 3: (60.0, 11.0), 5: (60.0, 10.0)}


def test_artifacts_round_trip(spark, tmp_path):
    from timedtext.operators import texts as X

    d = spark.createDataFrame([(1, [("a", 1.5)]), (2, [])], "video_id long, keyframes array<struct<path: string, time: double>>")
    X.write_artifacts({"scenes": d}, str(tmp_path))
    assert sorted(r.video_id for r in X.read_artifacts(spark, str(tmp_path), ("scenes",))["scenes"].where("exists(keyframes, k -> k.time > 1) or size(keyframes) = 0").collect()) == [1, 2]
