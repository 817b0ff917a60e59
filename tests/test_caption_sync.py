"""Matching blocks against the standard library; caption sync against given examples and a plain version over a registered query."""

import random
import re
from difflib import SequenceMatcher

import pytest

from timedtext.functions.blocks import block_ratio
from timedtext.operators.caption_sync import caption_sync

DATA = "/root/testdata/sf0.001"
CUE = "video_id long, cue_no long, start_ms long, end_ms long, text string"
WORD = "video_id long, word_no long, word string, start_ms long, end_ms long"
RANGE = "video_id long, seq long, narration string, start_ms long, end_ms long"


@pytest.mark.parametrize("seed", range(12))
def test_ratio_equals_standard_library(seed):
    rnd = random.Random(seed)
    letters = rnd.choice(["ab", "abcdefghij", "etaoinshrdlucmfwypvbgkqjxz0123456789éü字" * 3 + "etaoin" * 20])
    for _ in range(25):
        a = "".join(rnd.choices(letters, k=rnd.randrange(0, 700)))
        b = list(a if rnd.random() < 0.7 else "".join(rnd.choices(letters, k=rnd.randrange(0, 700))))
        for _ in range(rnd.randrange(12)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(9)] = rnd.choices(letters, k=rnd.randrange(9))
        b = "".join(b)
        assert block_ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_ratio_of_long_texts():
    rnd = random.Random(1)
    a = "".join(rnd.choices("etaoinshrdlu" * 6 + "cmfwypvbgkqjxz", k=40_000))
    assert block_ratio(a, a) == 1.0
    assert block_ratio(a, a[:10_000] + "zq" + a[10_000:]) == SequenceMatcher(None, a, a[:10_000] + "zq" + a[10_000:]).ratio()
    assert block_ratio("", "") == 1.0 and block_ratio("a", "") == 0.0


def rows(spark, captions, words, ranges, durations):
    out = caption_sync(spark.createDataFrame(captions, CUE), spark.createDataFrame(words, WORD), spark.createDataFrame(ranges, RANGE), spark.createDataFrame(durations, "video_id long, duration_ms long"))
    return {r.video_id: r for r in out.collect()}


def test_given_examples(spark):
    words = [(v, k, w, s, e) for v in (1, 2) for k, (w, s, e) in enumerate([("Xin", 100, 350), ("chào", 400, 750)])]
    captions = [(1, 0, 20, 930, "Xin chào"), (2, 0, 1020, 1930, "Xin chào"), (4, 0, 0, 900, "Xin chào bạn"), (5, 0, -500, 100, "hello"), (5, 1, 700, 600, "other words"), (6, 0, 0, 900, None), (6, 1, 0, 900, " "), (7, 0, 0, 900, "...")]
    ranges = [(v, 0, "Xin chào", 0, 900) for v in (1, 2, 4)] + [(5, 0, None, 0, 10), (5, 1, "Other, words", 2000, 3000)]
    got = rows(spark, captions, words, ranges, [(1, 2000), (2, 2000), (3, 2000), (4, None), (5, 0), (6, 1000), (7, 1000)])
    assert got[1].sync_score > 95 and got[1].source == "word_timings" and got[1].mean_offset == 0.0
    assert got[2].sync_score < 70 and got[2].mean_offset > 0.8
    assert (got[3].source, got[3].n_cues, got[3].sync_score) == ("missing", 0, 0.0) and got[3].mean_offset is None
    assert got[4].source == "voice_ranges" and got[4].mean_offset == 0.0 and 70 < got[4].text_match < 90
    assert (got[5].n_out_of_bounds, got[5].max_offset) == (2, 1.4)
    assert got[6].source == "missing" and got[7].text_match == 0.0
    assert rows(spark, [], [], [], []) == {}


def key(text):
    return re.sub(r"[\W_]", "", text.casefold())


def test_query_equals_plain(spark):
    from timedtext.plans import story_queries as Q

    captions, words, ranges, durations = (x.toPandas() for x in Q.caption_tables(spark, DATA))
    got = {r.video_id: r for r in Q.caption_sync(spark, DATA).collect()}
    assert set(got) == set(durations.video_id) and {r.source for r in got.values()} == {"word_timings", "voice_ranges"}
    for v, dur in zip(durations.video_id, durations.duration_ms):
        cues = captions[captions.video_id == v].sort_values("cue_no").to_dict("records")
        said, told = "".join(key(c["text"]) for c in cues), "".join(key(t) for t in ranges[ranges.video_id == v].sort_values("seq").narration)
        match = 100 * SequenceMatcher(None, said, told).ratio() if said and told else 0.0
        timed = [w | {"key": key(w["word"])} for w in words[words.video_id == v].sort_values("word_no").to_dict("records")]
        timed = [w for w in timed if w["key"]]
        offsets = []
        if all(key(c["text"]) for c in cues) and said == "".join(w["key"] for w in timed):
            letters = [w for w in timed for _ in w["key"]]
            at = 0
            for c in cues:
                own, at = letters[at : at + len(key(c["text"]))], at + len(key(c["text"]))
                offsets += [abs(c["start_ms"] - max(0, own[0]["start_ms"] - 80)) / 1000, abs(c["end_ms"] - min(dur, own[-1]["end_ms"] + 180)) / 1000]
            mean, most = sum(offsets) / len(offsets), max(offsets)
            score = max(0, min(100, 100 - max(0, mean - 0.12) * 85 - max(0, most - 0.3) * 20))
            assert got[v].source == "word_timings"
            assert abs(got[v].mean_offset - mean) < 2e-3 and abs(got[v].max_offset - most) < 2e-3
            bad = sum(c["start_ms"] < -10 or c["end_ms"] <= c["start_ms"] or c["end_ms"] > dur + 150 for c in cues)
            assert got[v].n_out_of_bounds == bad
            assert abs(got[v].sync_score - max(0, min(100, score * 0.72 + match * 0.2 + 8 * (1 - bad / len(cues))))) < 0.02
        else:
            assert got[v].source == "voice_ranges"
        assert abs(got[v].text_match - match) < 0.01
