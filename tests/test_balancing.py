"""Balance of events: given examples, a plain version step by step, and edge cases."""

import math
import random

import pytest

from timedtext.operators.balancing import balance_events

EVENTS = "video_id long, event_no long, scene_ids array<long>"
SCENES = "video_id long, scene_id long, start_ms long, end_ms long, n_evidence long, confidence double"
COUNTS = "video_id long, target long, least long, most long"


def run(spark, events, scenes, counts):
    out = balance_events(spark.createDataFrame(events, EVENTS), spark.createDataFrame(scenes, SCENES), spark.createDataFrame(counts, COUNTS))
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.video_id, r.event_no)):
        got.setdefault(r.video_id, []).append(r)
    assert all([r.event_no for r in rows] == list(range(1, len(rows) + 1)) for rows in got.values())
    return got


def plain(events, scenes, target, least, most):
    """Lists of scene ids with the events at their ends, one change at a time."""
    at = {s[0]: s for s in scenes}
    order = sorted(scenes, key=lambda s: (s[1], s[2], s[0]))
    target = max(1, min(target, len(scenes)))
    least, most = max(1, min(least, target)), max(target, most)
    lo = lambda e: min(at[i][1] for i in e["ids"])
    hi = lambda e: max(at[i][2] for i in e["ids"])
    by_time = lambda ids: sorted(ids, key=lambda i: (at[i][1], i))
    now = [{"ids": by_time({i for i in ids if i in at}), "rank": k, "cause": no, "effect": no, "anchor": 0} for k, (no, ids) in enumerate(sorted(events), 1)]
    now = [e for e in now if e["ids"]]
    taken = {i for e in now for i in e["ids"]}
    k = 0
    for b in range(target):
        size = len(order) // target + (b < len(order) % target)
        run_, k = order[k : k + size], k + size
        if not taken & {s[0] for s in run_}:
            best = max(run_, key=lambda s: (s[3], s[4]))
            now.append({"ids": [best[0]], "rank": 1, "cause": None, "effect": None, "anchor": 1})
    now.sort(key=lambda e: (lo(e), e["rank"], e["anchor"]))
    span = max(1000, order[-1][2] - order[0][1])
    scene_cap, span_cap = max(2, math.ceil(len(order) / target * 1.5)), max(30_000.0, span / target * 1.75)

    def halve(i):
        e, m = now[i], max(1, len(now[i]["ids"]) // 2)
        now[i : i + 1] = [e | {"ids": e["ids"][:m], "effect": None}, e | {"ids": e["ids"][m:], "cause": None}]

    while len(now) < most:
        size = [max(len(e["ids"]) / scene_cap, (hi(e) - lo(e)) / span_cap) if len(e["ids"]) > 1 else 0 for e in now]
        if max(size) <= 1:
            break
        halve(size.index(max(size)))
    while len(now) < target and max(len(e["ids"]) for e in now) > 1:
        size = [len(e["ids"]) for e in now]
        halve(size.index(max(size)))
    if len(now) < least:
        taken = {i for e in now for i in e["ids"]}
        free = [s for s in sorted(scenes) if s[0] not in taken and s[3] > 0]
        n = min(least - len(now), len(free))
        places = {int(j * ((len(free) - 1) / (n - 1))) if j < n - 1 else len(free) - 1 for j in range(n)} if n > 1 else {0} if n == 1 else set()
        now += [{"ids": [free[p][0]], "rank": p + 1, "cause": None, "effect": None, "anchor": 0} for p in sorted(places)]
        now.sort(key=lambda e: (lo(e), e["rank"]))
    while len(now) > max(1, most):

        def cost(i):
            x, y = now[i], now[i + 1]
            n, long_ = len({*x["ids"], *y["ids"]}), max(hi(x), hi(y)) - min(lo(x), lo(y))
            return n > scene_cap or long_ > span_cap, long_ / span_cap + n / scene_cap, max(0, lo(y) - hi(x)) / span

        i = min(range(len(now) - 1), key=cost)
        x, y = now[i], now[i + 1]
        now[i : i + 2] = [x | {"ids": by_time({*x["ids"], *y["ids"]}), "effect": y["effect"]}]
    now.sort(key=lambda e: (lo(e), hi(e)))
    return [(e["ids"], lo(e), hi(e), sum(at[i][3] for i in e["ids"]), min(at[i][4] for i in e["ids"]), e["cause"], e["effect"]) for e in now]


def test_given_examples(spark):
    every = [(1, i, i * 10_000, i * 10_000 + 8_000, 1, 0.9) for i in range(32)]
    act = [(2, i, i * 30_000, i * 30_000 + 25_000, 1, 0.9) for i in range(12)]
    one = [(3, i, i * 10_000, i * 10_000 + 8_000, 1, 0.9) for i in range(12)]
    events = [(1, i, [i]) for i in range(8)] + [(2, 0, list(range(9))), (2, 1, [9]), (2, 2, [10]), (2, 3, [11])] + [(3, 0, list(range(12)))]
    got = run(spark, events, every + act + one, [(1, 8, 7, 9), (2, 4, 4, 6), (3, 6, 5, 7)])
    claimed = {i for r in got[1] for i in r.scene_ids}
    assert 8 <= len(got[1]) <= 9 and all(claimed & set(range(b, b + 4)) for b in range(0, 32, 4))
    assert 4 < len(got[2]) <= 6 and max(len(r.scene_ids) for r in got[2]) < 9
    assert len(got[3]) == 6 and {i for r in got[3] for i in r.scene_ids} == set(range(12))
    assert [r.cause_no for r in got[3]] == [0, None, None, None, None, None] and got[3][-1].effect_no == 0


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain(spark, seed):
    rnd, events, scenes, counts, want = random.Random(seed), [], [], [], {}
    for v in range(25):
        n, at, own = rnd.choice([1, 2, 5, 17, 40, 90]), 0, []
        for i in range(n):
            at += rnd.choice([0, 2_000, 9_000, 40_000])
            own.append((i, at, at + rnd.choice([500, 5_000, 20_000, 120_000]), rnd.choice([0, 0, 1, 3]), rnd.choice([0.2, 0.5, 0.9])))
        given, first = [], rnd.randrange(n)
        while first < n and len(given) < rnd.choice([1, 4, 30, 60]):
            more = rnd.choice([1, 1, 2, 5, 25])
            given.append((len(given), [*range(first, min(n, first + more)), *rnd.choice([[], [777], [first]])]))
            first += more if rnd.random() < 0.9 else max(1, more - 1)
        limits = rnd.choice([(6, 5, 7), (1, 1, 1), (12, 12, 12), (30, 25, 40), (4, 2, 3)])
        events += [(v, no, ids) for no, ids in given]
        scenes += [(v, *s) for s in own]
        counts.append((v, *limits))
        want[v] = plain(given, own, *limits)
    got = run(spark, events, scenes, counts)
    assert {v: [(r.scene_ids, r.start_ms, r.end_ms, r.evidence_count, r.confidence, r.cause_no, r.effect_no) for r in rows] for v, rows in got.items()} == want


def test_edges(spark):
    scenes = [(1, 1, 0, 5, None, None), (1, 1, 0, 5, None, None), (1, 2, 5, 9, 1, 0.5), (2, 1, 0, 9, 1, 0.5), (3, 1, 0, 9, 1, 0.5)]
    got = run(spark, [(1, 1, None), (1, 2, [9]), (1, 3, [2, 2]), (4, 1, [1])], scenes, [(1, 2, 1, 5), (2, 3, 1, None)])
    assert {v: [r.scene_ids for r in rows] for v, rows in got.items()} == {1: [[1], [2]], 2: [[1]]}
    assert [r.verified for r in got[1]] == [False, True]
    assert run(spark, [], [], []) == {}


def test_query_equals_plain(spark):
    from timedtext.plans import story_queries as Q

    events, scenes, counts = ([tuple(r) for r in x.collect()] for x in Q.event_tables(spark, "/root/testdata/sf0.001"))
    got, want = {}, {}
    for r in Q.balance_events(spark, "/root/testdata/sf0.001").orderBy("video_id", "event_no").collect():
        got.setdefault(r.video_id, []).append((r.scene_ids, r.start_ms, r.end_ms, r.evidence_count, r.confidence, r.cause_no, r.effect_no))
    for v, *limits in counts:
        want[v] = plain([e[1:] for e in events if e[0] == v], [x[1:] for x in scenes if x[0] == v], *limits)
    assert got == want
