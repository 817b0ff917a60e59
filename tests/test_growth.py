"""Plans and odd cases of the queries whose cost grew faster than their input."""

import random
import re

import duckdb
import pytest

from tests.oracle import _plain, rows_of_query
from timedtext.operators import alignment as A
from timedtext.operators import cues as C
from timedtext.operators import matching as M
from timedtext.operators import reports as P
from timedtext.operators import scorecards as K
from timedtext.operators import texts as X
from timedtext.plans import ORACLE_SQL, QUERIES, segment_queries

DATA = "/root/testdata/sf0.001"


def plan(capsys, df):
    df.explain()
    return capsys.readouterr().out


def test_blocks_are_placed_once_a_video(spark, capsys):
    assert "Window" not in plan(capsys, QUERIES["sample_blocks"](spark, DATA))


def test_blocks_of_numbers_that_are_null_or_come_twice(spark):
    rows = [(1, None), (1, 7), (1, 7), *[(2, i) for i in range(100, 0, -1)], (None, 5), (None, None)]
    got = [tuple(r) for r in P.sample_blocks(spark.createDataFrame(rows, "video_id long, cue_no int"), 6, 2).collect()]
    assert sorted(got, key=repr) == sorted([(1, None), (1, 7), (1, 7), (None, 5), (None, None), *[(2, i) for i in (1, 2, 3, 4, 97, 98)]], key=repr)


def test_words_are_packed_where_they_are_read(spark, capsys):
    shown = plan(capsys, QUERIES["pack_words"](spark, DATA))
    assert "Exchange" not in shown and "Aggregate" not in shown


def test_packed_words_of_odd_texts(spark):
    texts = [(1, "aa bb\t\ncc"), (2, " abcdefgh  a b \u2028 "), (3, ""), (4, None), (5, "\U0001f600\U0001f600 \U0001f600\U0001f600 x"), (6, " \n "), (7, "w" * 200_000), (8, "abcde\x85 a")]
    got = C.pack_words(spark.createDataFrame(texts, "video_id long, text string"), 5).collect()
    want = [(1, 1, "aa bb"), (1, 2, "cc"), (2, 1, "abcdefgh"), (2, 2, "a b \u2028"), (5, 1, "\U0001f600\U0001f600 \U0001f600\U0001f600"), (5, 2, "x"), (7, 1, "w" * 200_000), (8, 1, "abcde\x85"), (8, 2, "a")]
    assert sorted(tuple(r) for r in got) == want


def test_terms_are_counted_where_they_are_read(spark, capsys):
    shown = plan(capsys, QUERIES["term_weights"](spark, DATA))
    assert "Exchange" not in shown and "Aggregate" not in shown


def test_weights_of_odd_texts(spark):
    texts = [(1, 0, "aa bb aa bb x aa"), (1, 1, ""), (1, 2, None), (1, 3, "aa"), (None, None, "Aa, AA")]
    got = M.term_weights(spark.createDataFrame(texts, "video_id long, item_no long, text string")).collect()
    want = {(1, 0, "aa"): 3, (1, 0, "bb"): 2, (1, 0, "aa_bb"): 2.7, (1, 0, "bb_aa"): 2.7, (1, 3, "aa"): 1, (None, None, "aa"): 2, (None, None, "aa_aa"): 1.35}
    assert {(r[0], r[1], r[2]): round(r[3], 9) for r in got} == want and len(got) == len(want)


def test_ids_are_counted_without_a_join(spark, capsys):
    shown = plan(capsys, QUERIES["reconcile_ids"](spark, DATA))
    assert "Join" not in shown and "Sort" not in shown


def test_ids_that_are_null(spark):
    ids = lambda *x: spark.createDataFrame(list(x), "video_id long, item_id long")
    got = K.reconcile_ids(ids((1, None), (1, 2), (1, 3), (None, 4)), ids((1, None), (1, None), (1, 2), (1, 2), (1, 9), (None, 4))).collect()
    assert {tuple(r) for r in got} == {(1, 2, 2, 2, True), (None, 1, 1, 0, False)}


def test_rows_of_one_video_are_dealt_over_tasks(spark):
    rows = spark.range(4000).selectExpr("1L video_id", "id", "concat('the ', id) text", "map('k', 'the') m")
    aliases = spark.createDataFrame([(1, "the", "Theo", 0)], "video_id long, alias string, canonical string, priority int")
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for f in (X.replace_names, X.replace_names_nested):
            out = f(rows, aliases)
            assert out.columns == rows.columns and out.where("text = concat('Theo ', id)").count() == 4000
            assert max(len(p) for p in out.select("id").rdd.glom().collect()) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_context_of_batches(spark, capsys):
    rows = [(v, i, None if i == 4 else f"t{i}") for v, k in ((1, 11), (2, 3), (None, 4)) for i in range(k)]
    cues = spark.createDataFrame(rows, "video_id long, cue_no long, text string")
    for batch, before, after in ((3, 2, 1), (3, 8, 5), (20, 8, 4), (4, 0, 0)):
        got = {(r.video_id, r.batch_no): (r.n_items, r.prev, r.nxt) for r in C.with_context(cues, batch, before, after).collect()}
        want = {}
        for v in (1, 2, None):
            t = [x for w, _, x in rows if w == v]
            for b in range(-(-len(t) // batch)):
                lo, hi = b * batch, min(len(t), (b + 1) * batch)
                want[v, b] = hi - lo, [x for x in t[max(0, lo - before) : lo] if x], [x for x in t[hi : hi + after] if x]
        assert got == want
    shown = plan(capsys, C.with_context(cues))
    assert shown.count("collect_list") and shown.split("Window")[0].count("Aggregate") and "collect_list" not in "".join(shown.split("Window")[1:])


@pytest.mark.parametrize("name", ["time_segments", "time_captions"])
def test_words_bring_their_times(spark, capsys, name):
    # It was seven with a join back to the words.
    assert plan(capsys, QUERIES[name](spark, DATA)).count("SortMergeJoin") <= 6


def test_pairs_of_beats_and_windows_are_not_shuffled(spark, capsys):
    shown = plan(capsys, QUERIES["align_beats"](spark, DATA))
    assert not re.search(r"Exchange hashpartitioning\([^)]*start_no", shown) and not re.search(r"Exchange hashpartitioning\([^)]*term", shown)


def test_beats_of_a_film_of_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "_BEATS", 16)
    monkeypatch.setattr(A, "_SLAB", 64)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["a", "É", "naïve", "-"]
    text = lambda i: {5: None, 9: "", 30: " ", 31: "x . y"}.get(i, " ".join(rnd.choices(words, k=rnd.randint(1, 14))))
    rows = [(0, i, "user", text(i)) for i in range(70)] + [(8 + k, i, "user", text(i)) for k in range(3) for i in range(4)] + [(16, 0, "user", "w1 w2")]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    cols, got = rows_of_query(QUERIES["align_beats"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    rel = con.sql(ORACLE_SQL["align_beats"])
    want = sorted((tuple(_plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want and len(got) == len(rows)


def test_candidates_are_dealt_once_and_over_tasks_by_their_number(spark, capsys, monkeypatch):
    monkeypatch.setattr(segment_queries, "_ROWS", 100)
    shown = plan(capsys, QUERIES["top_candidates"](spark, DATA))
    tasks = spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 100
    assert shown.count("Exchange") == 1 and re.search(rf"Exchange hashpartitioning\(video_id#\d+L?, seq#\d+L?, {tasks}\)", shown)
