"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_simhash import groups
from timedtext.llm import chat_format, embedding_dedup, language_id, line_dedup, mixing, packing, quality_classifier, quality_rules, secret_scan, simhash
from timedtext.llm.embedding_dedup import near_vectors

ROWS = [(1, "plain words of a text " * 30, "a"), (1, "plain words of a text " * 30, "a"), (None, "some text", None), (3, None, "b"), (4, "", "b"), (5, " \n\t", "c"), (6, "z" * 200_000, "a"), (7, "w " * 60_000, "b")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("bucket", "score", "piece", "__row", "spans", "n_words", "rate"):
        d = d.withColumn(c, F.lit(9))
    return d


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (1, 1)], "doc_id long, quality int")
    w = quality_classifier.fit(docs, labels)
    out = quality_classifier.score(docs, w, ["doc_id"]).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.score(empty(spark), w, ["doc_id"]).count() == 0
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(docs, none, ["doc_id"]).collect()} == {0.5}


def test_ftrl_learns_and_regularises():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(400):
        label = int(rng.random() < 0.5)
        rows.append((np.array([1 + label, 10 + rng.integers(50)]), np.ones(2)))
        y.append(label)
    w = quality_classifier.train_ftrl(rows, np.array(y))
    assert w[2] > 0.5 and w[1] < -0.5 and (w == 0).sum() > len(w) - 60


def test_language(spark, docs):
    train = spark.createDataFrame([(i, "der und die das ist nicht", "de") for i in range(30)] + [(100 + i, "the and of that is not", "en") for i in range(30)] + [(999, None, "de"), (998, "123", "en")], "doc_id long, text string, lang string")
    names, w = language_id.fit(train, "doc_id", "text", "lang")
    assert names == ["de", "en"]
    out = {(r.doc_id, i): r for i, r in enumerate(language_id.predict(docs, names, w, ["doc_id"]).collect())}
    assert len(out) == len(ROWS)
    for (i, _), r in out.items():
        assert (r.lang_pred == "und") == (i in (3, 4, 5)) and 0 <= r.score <= 1
    assert language_id.predict(empty(spark), names, w, ["doc_id"]).count() == 0
    names, w = language_id.fit(empty(spark).withColumn("lang", F.lit("x")), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language_id.predict(docs, names, w, ["doc_id"]).collect()} == {"und"}


def test_kernel_is_the_folded_product():
    texts, langs = ["abc abd", "xyz xya", "abe abc", "xyw xyz"], ["a", "x", "a", "x"]
    names, w = language_id.fit_kernel_ridge([language_id.presence(t) for t in texts], langs)
    f = language_id._matrix(["abc", "xyz"]) @ w
    assert names == ["a", "x"] and f[0].argmax() == 0 and f[1].argmax() == 1


def test_rules(spark, docs):
    trusted = spark.createDataFrame([(1,), (None,), (1,)], "id long")
    out = quality_rules.apply_rules(docs, trusted).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[7].n_repeat_words == 60_000 and by[6].word_chars == 200_000
    assert quality_rules.apply_rules(empty(spark), trusted).count() == 0
    assert {r.llr for r in quality_rules.apply_rules(docs, trusted.limit(0)).collect()} == {0.0}


def test_packing(spark, docs):
    out = packing.pack(docs, ["doc_id"]).collect()
    assert sum(1 for r in out if r.doc_id == 3) == 1 and next(r for r in out if r.doc_id == 3).length == 1
    assert sum(r.length for r in out if r.doc_id == 1) % 2 == 0
    assert packing.pack(empty(spark), ["doc_id"]).count() == 0
    special = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    assert packing.pack(special, ["doc_id"], with_ids=True).first()["ids"] == [64, 50256, 65, 2]


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_is_a_packing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [20, 100, 1023, 600, 400, 1023][seed] + 1, 500)
    bins, offsets = packing.best_two_fit(lengths, 1024)
    total = np.bincount(bins, lengths)
    assert total.max() <= 1024 and (total > 0).all()
    for b in range(len(total)):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert (np.cumsum(lengths[at]) - lengths[at] == offsets[at]).all()
    assert len(total) <= math.ceil(lengths.sum() / 1024) * (1.01 if lengths.max() < 600 else 1.3) + 1


def test_two_for_one():
    """700 + 200 leaves 124; 300 fits nowhere, 150 + 160 fill the gap of 324 better than 200 does."""
    bins, _ = packing.best_two_fit(np.array([700, 200, 160, 150]), 1024)
    assert bins[0] == bins[2] == bins[3]


def test_secrets(spark, docs):
    out = secret_scan.find_secrets(docs, ["doc_id"]).collect()
    assert len(out) == len(ROWS) and all(r.spans == [] for r in out)
    assert secret_scan.find_secrets(empty(spark), ["doc_id"]).count() == 0
    rnd = random.Random(2)
    key = "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(40))
    spans = secret_scan.scan(f"the private key is {key} as said")
    assert [(s, e, k) for s, e, k in spans] == [(19, 59, "novel")]
    assert secret_scan.scan(f"{key} first, then the private key is {key} again") == []
    assert secret_scan.scan(f"an identifier {key} of no interest") == []
    assert secret_scan.scan("token = 'abcdefgh' password:short") == [(0, 17, "assign")]
    assert secret_scan.scan("é PASSWORD = abcdefgh1") == [(2, 22, "assign")]
    assert secret_scan.scan("api_key example_value_abc12 and the api-key configuration2") == []


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>hi<|end|>", "<\\|end|>", "<", "|>", "<\\", None, "", "a<|more|>b", "\n", "<<|end|>", "$1 \\1"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|end|>"]), rng.choice(nasty)) for c in (1, 2, None) for t in range(40)] + [(2, 3, "user", "tie"), (2, 3, "user", "tie"), (9, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(0))
    out = chat_format.format_conversations(df).select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), "segments").collect()
    assert {r.conv_id for r in out} == {1, 2, 9, None}
    for r in out:
        want = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id), key=lambda x: (x[0], x[1], x[2], x[3]))
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in want]
        assert r.loss == "".join(x[3] for x in want if x[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_mixing(spark, docs):
    out = mixing.mix_sources(docs, {"a": 1.0, "b": 3.0, "none": 5.0}, epochs=40.0).collect()
    assert {r.source for r in out} <= {"a", "b"}
    assert mixing.mix_sources(empty(spark), {"a": 1.0}).count() == 0
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    n = {r.source: r.n for r in mixing.mix_sources(big, {"a": 2.0, "b": 2.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] / sum(n.values()) - 0.5) < 0.02


def test_poisson_table():
    t = mixing.poisson_table(2.5)
    assert abs(t[0] - math.exp(-2.5)) < 1e-15 and t[-1] > 1 - 1e-12 and t == sorted(t)
    assert mixing.poisson_table(0) == [1.0]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    near = base[:20] + rng.normal(size=(20, 8)) * 0.1
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near, base[0] * 3, base[0], base[0]])]
    rows += [(100, None), (101, [0.0] * 8), (102, [None] + [1.0] * 7), (103, [math.nan] * 8), (104, [math.inf] + [0.0] * 7), (105, []), (106, [1.0, 2.0]), (107, [2.0, 4.0]), (None, rows[1][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1)).withColumn("node", F.lit("x"))
    got = near_vectors(df, leaf=7, draw=8, chunk=16).collect()
    assert len(got) == len(rows)

    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        return good(a) and good(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95

    want = []
    for k, (i, v) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            x = todo.pop()
            for y in range(len(rows)):
                if y not in reach and cos(rows[x][1], rows[y][1]):
                    reach.add(y)
                    todo.append(y)
        ids = [rows[x][0] for x in reach if rows[x][0] is not None]
        want.append((i, sum(1 for y in range(len(rows)) if y != k and cos(v, rows[y][1])), min(ids) if ids else None))
    assert sorted(map(str, ((r.id, r.n_links, r.component_id) for r in got))) == sorted(map(str, want))
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_of_extreme_size_and_many_lengths(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [2e-310, 2e-310]), (5, [-1e300, -1e300])]
    rows += [(100 + n, [1.0] * n) for n in range(3, 1203)] + [(5000 + n, [2.0] * n) for n in range(3, 1203)]
    got = {r.id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [(3, 1)] * 4 + [(0, 5)]
    assert all(got[100 + n] == got[5000 + n] == (1, 100 + n) for n in range(3, 1203))


def test_separated_centres():
    v = embedding_dedup._unit(np.random.default_rng(4).normal(size=(400, 6)))
    for radius in (1.0, 0.5, 0.25):
        kept = embedding_dedup.separated(v, radius)
        d = embedding_dedup._distance(v[kept], v[kept])
        assert (d + 9 * np.eye(len(kept)) > radius).all() and embedding_dedup._distance(v, v[kept]).min(axis=1).max() <= radius + 1e-9


@pytest.mark.parametrize("clusters,size,draw", [(300, 20, 512), (3000, 4, 256)])
def test_cover_tree_prunes_clusters(spark, clusters, size, draw):
    """More clusters than a round draws centres; few pairs of vectors are left to compare, and no link is lost."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(clusters, 16))
    v = np.concatenate([c + rng.normal(size=(size, 16)) * 0.05 for c in centre])
    points = embedding_dedup._unit(v)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    scratch = embedding_dedup.Scratch(spark, "cells")
    nodes = scratch.table(df.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("v"), F.lit(16).alias("dim")), "nodes")
    placed, pairs = embedding_dedup.cell_pairs(nodes, float(np.sqrt(0.1)), scratch, 64, draw, 1024)
    cell = {r.node: r.cell for r in placed.select("node", "cell").collect()}
    held, left = Counter(cell.values()), {(r.a, r.b) for r in pairs.collect()}
    assert len(cell) == len(v) and len(held) > 100
    work = sum(held[a] * held[b] for a, b in left)
    assert work < 0.3 * len(v) ** 2 / 2
    near = points @ points.T >= 0.95
    for i, j in np.argwhere(near).tolist():
        assert (min(cell[i], cell[j]), max(cell[i], cell[j])) in left
    got = {r.id: r for r in near_vectors(df, leaf=64, draw=draw, chunk=1024).collect()}
    root = groups(np.argwhere(near).tolist(), range(len(v)))
    assert all(got[i].n_links == near[i].sum() - 1 and got[i].component_id == root[i] for i in range(len(v)))


def test_text_ids_and_clashing_columns(spark):
    """Every added column's name, and some of the operators' own, as columns of the input."""
    clash = ("score", "lang_pred", "spans", "piece", "start", "length", "item", "shard", "rate", "copy", "shuffle_key", "__u", "__copies", "n_lines", "n_dropped", "gone", "__gone", "row", "th", "parts", "fp", "root", "low")
    text = "some words that are no secret at all\nand a second line"
    df = spark.createDataFrame([("b", text, "src", "en"), ("a", text, "src", "en"), (None, None, None, None)], "doc_id string, text string, source string, lang string")
    for c in clash:
        df = df.withColumn(c, F.lit(9))
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int")
    every = df.columns

    def held(out, own):
        assert len(set(out.columns)) == len(out.columns) and set(every) - {*own} <= set(out.columns)
        got = out.collect()
        assert all(r[c] == 9 for r in got for c in clash if c not in own)
        return got

    assert len(held(quality_classifier.score(df, quality_classifier.fit(df, labels), every), ["score"])) == 3
    names, w = language_id.fit(df, "doc_id", "text", "lang")
    assert {r.lang_pred for r in held(language_id.predict(df, names, w, every), ["lang_pred", "score"])} == {"en", "und"}
    assert len(held(secret_scan.find_secrets(df, every), ["spans"])) == 3
    assert len(held(packing.pack(df, every), packing._OWN)) == 3
    assert {r.doc_id for r in held(mixing.mix_sources(df, {"src": 1.0}, epochs=9.0), ["rate", "copy", "shuffle_key"])} == {"a", "b"}
    got = {r.doc_id: r.text for r in held(line_dedup.dedup_lines(df), ["n_lines", "n_dropped", "text"])}
    assert got == {"a": text, "b": "", None: None}
    assert {(r.id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {("a", "a"), ("b", "a"), (None, None)}
    vec = spark.createDataFrame([("y", [1.0, 2.0]), ("x", [1.0, 2.0])], "vec_id string, embedding array<double>").withColumn("dim", F.lit(9))
    assert {(r.id, r.component_id) for r in near_vectors(vec).collect()} == {("x", "x"), ("y", "x")}


def test_letters_are_category_l():
    assert not any(language_id.has_letter(t) for t in ("", "½ ² Ⅷ ⓐ 12 _", "\U0001f600"))
    assert all(language_id.has_letter(t) for t in ("1a", "…é", "中", "ªº"))


def test_many_languages_are_all_learned(spark):
    rows = [(i, chr(0x4E00 + i % 1200) * 3, f"l{i % 1200}") for i in range(2400)]
    names, w = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert len(names) == 1200 and w.shape[1] == 1200


def test_large_rates_are_sums_of_draws(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "rare").otherwise("many").alias("source"))
    got = {r.doc_id: r.n for r in mixing.mix_sources(df, {"rare": 9.0, "many": 1.0}, epochs=20.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[i] - 1800) < 6 * math.sqrt(1800) for i in (0, 1))


def test_shape_of_a_whole_word():
    assert quality_classifier._shape("a" * 70 + "7") == "a9"
