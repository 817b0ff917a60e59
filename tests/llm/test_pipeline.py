"""Every stage of the pipeline against a plain version of itself, on the stage's own input."""

import hashlib
import math

import pytest
from pyspark.sql.functions import lit

import corpus_pipeline
from tests.llm.test_line_dedup import brute_force
from tests.llm.test_near_copies import shingles, similarity
from tests.llm.test_simhash import groups
from timedtext.llm import quality_classifier
from timedtext.llm.common import Scratch, crc32_mod
from timedtext.llm.queries import SOURCE_WEIGHTS

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    scratch, docs = Scratch(spark, "test-pipeline"), spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.table(stage(spark, docs, DATA), str(k))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        out.append(docs.collect())
    return out


def test_quality(spark, tables):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    w = quality_classifier.fit(docs, labels.where(crc32_mod(labels["doc_id"], 5) != 0))

    def score(text):
        i, v = quality_classifier.features(text)
        return 1 / (1 + math.exp(-float(w[i] @ v)))

    assert {r.doc_id for r in tables[1]} == {r.doc_id for r in tables[0] if score(r.text) >= 0.3}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - {r.doc_id for r in tables[1]}) <= 0.03 * len(good)


def test_lines(tables):
    want = brute_force([(r.doc_id, r.text) for r in tables[1]])
    got = {r.doc_id: r for r in tables[2]}
    assert set(got) == set(want)
    assert sum(got[i].text != want[i] for i in want) <= 0.03 * len(want)
    assert all(r.n_chars == len(r.text) for r in tables[2])


def test_near_duplicates(tables):
    """The bands miss few pairs; the sample's texts have none near the threshold that they miss."""
    rows = {}
    for r in tables[2]:
        rows.setdefault(r.text or "", []).append(r.doc_id)
    texts = sorted(rows)
    sets = [shingles(t) for t in texts]
    root = groups([(a, b) for a in range(len(texts)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8], range(len(texts)))
    first = {}
    for k, t in enumerate(texts):
        first[root[k]] = min(first.get(root[k], math.inf), *rows[t])
    assert sorted(r.doc_id for r in tables[3]) == sorted(first.values())


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, stage):
    """Nulls, empty, blank and very long texts, repeated rows, extra columns and no rows at all."""
    rows = [(1, "w " * 40_000, "en", "src0", 1), (2, None, None, "src1", None), (3, "", "en", "src2", 0), (4, " \n\t\n", "en", "src3", 4), (None, "a text without an id", "en", "src0", 20), (5, "x" * 100_000, None, "src0", 9), (6, "twice", "de", "src0", 5), (6, "twice", "de", "src0", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for c in ("score", "key", "row", "rate", "copy", "piece", "n_lines", "root"):
        docs = docs.withColumn(c, lit("x"))
    run = corpus_pipeline.STAGES[stage][1]
    got = run(spark, docs, DATA).collect()
    ids = sorted((str(r.doc_id) for r in got), key=str)
    if stage < 4:
        assert run(spark, docs, DATA).columns == corpus_pipeline.COLUMNS
    if stage == 1:
        assert len(got) == len(rows) and next(r for r in got if r.doc_id == 2).text is None
    if stage == 2:
        assert ids == ["1", "2", "5", "6", "None"]
    if stage == 4:
        assert {*ids} == {str(r[0]) for r in rows} and sum(r.piece == 0 for r in got) == len(rows)
    assert run(spark, docs.limit(0), DATA).count() == 0


def test_mixing(tables):
    counts = {}
    for r in tables[3]:
        counts[r.source] = counts.get(r.source, 0) + 1
    share = sum(SOURCE_WEIGHTS[s] for s in counts if s in SOURCE_WEIGHTS)
    want = {}
    for r in tables[3]:
        rate = SOURCE_WEIGHTS[r.source] / share * sum(counts.values()) / counts[r.source]
        u = int(hashlib.md5(f"3|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, total = 0, math.exp(-rate)
        term = total
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        if k:
            want[r.doc_id] = k
    got = {}
    for r in tables[4]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_packing(tables):
    pieces = {}
    for r in tables[5]:
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in pieces.values():
        end = 0
        for o, n in sorted(p):
            assert o == end
            end += n
        assert end <= 1024
    assert sum(r.piece == 0 for r in tables[5]) == len(tables[4])


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, DATA).count() == len(tables[5])
