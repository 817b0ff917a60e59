"""Long cues in parts against a plain version that moves one word at a time."""

import re

from timedtext.operators import cues as C
from timedtext.operators import splitting as P
from timedtext.plans import QUERIES
from timedtext.plans import views as V


def _fill(words, width):
    rows = []
    for w in words:
        if rows and len(" ".join([*rows[-1], w])) <= width:
            rows[-1].append(w)
        else:
            rows.append([w])
    return rows


def _words(text, width):
    rows = _fill(text.split(), width)
    for left, right in zip(rows[-2::-1], rows[:0:-1]):
        while len(left) > 1:
            gap = abs(len(" ".join(left)) - len(" ".join(right)))
            moved = [left[-1], *right]
            if len(" ".join(moved)) > width or abs(len(" ".join(left[:-1])) - len(" ".join(moved))) >= gap:
                break
            right.insert(0, left.pop())
    return [" ".join(r) for r in rows]


def _plain(text, ms, width=42, most_ms=3200):
    text = " ".join(text.split())
    if not text or (len(text) <= width and ms <= most_ms):
        return [text] if text else []
    clauses = [x for x in re.split(r"(?<=[,;:.!?…-])\s+", text) if x]
    out = [y for x in _fill(clauses, width) for y in ([" ".join(x)] if len(" ".join(x)) <= width else _words(" ".join(x), width))]
    while len(out) < max(-(-len(text) // width), -(-ms // most_ms)):
        k = max(range(len(out)), key=lambda i: len(out[i]))
        more = _words(out[k], max(12, min(width, len(out[k]) // 2)))
        if len(more) < 2:
            break
        out = out[:k] + more + out[k + 1 :]
    return out


def test_query_equals_plain_version(spark):
    cues = C.normalize_cues(V.cues(spark, "/root/testdata/sf0.001")).collect()
    want = {(r.video_id, r.cue_no): _plain(r.text, max(10, r.end_ms - r.start_ms)) for r in cues if r.text is not None}
    split = P.split_cues(V.cues(spark, "/root/testdata/sf0.001")).orderBy("video_id", "cue_no").collect()
    got = {}
    for r in split:
        got.setdefault((r.video_id, r.source_no), []).append(r.text)
    assert got == {k: v for k, v in want.items() if v} and len(split) > len(got)
    by_video = {}
    for r in split:
        by_video.setdefault(r.video_id, []).append(r)
    for rows in by_video.values():
        assert [r.cue_no for r in rows] == list(range(len(rows)))
        assert all(a.end_ms <= b.start_ms or a.end_ms == a.start_ms + 600 for a, b in zip(rows, rows[1:]))
    assert QUERIES["split_cues"](spark, "/root/testdata/sf0.001").count() == len(split)


def test_a_long_cue_has_no_short_tail(spark):
    text = "Em đã chờ anh ở đây từ rất lâu rồi, cuối cùng thì anh cũng đã quay về với em"
    rows = spark.createDataFrame([(1, 4, 76276, 79913, text), (1, 5, 90000, 90400, "  "), (1, 6, 91000, 91300, None), (1, 7, 92000, 92400, "x" * 90)], "video_id long, cue_no long, start_ms long, end_ms long, text string")
    out = P.split_cues(rows).orderBy("cue_no").collect()
    first = [r for r in out if r.source_no == 4]
    assert " ".join(r.text for r in first) == text and first[0].start_ms == 76276 and first[-1].end_ms == 79913
    assert all(r.end_ms - r.start_ms >= 600 and " " in r.text and len(r.text) <= 42 for r in first)
    assert all(a.end_ms == b.start_ms for a, b in zip(first, first[1:]))
    assert {r.source_no for r in out} == {4, 7} and P.split_cues(rows.limit(0)).count() == 0
