"""Exact dedup against a plain grouping, with frequent texts, repeated rows, nulls and odd blanks."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from timedtext.llm import exact_dedup
from timedtext.llm.exact_dedup import dedup_texts

SCHEMA = "doc_id long, text string"


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = (
    [(i, "a frequent text\t of words") for i in range(500)]
    + [(7, "a frequent text of  words")] * 200
    + [(None, None)] * 40
    + [(i, None) for i in range(1000, 1020)]
    + [(3, ""), (2, " "), (4, "\n\t"), (None, "only null ids"), (None, "only  null ids"), (9, "x" * 300_000), (8, "x" * 300_000), (10, "x" * 299_999 + "y"), (11, "\x1cblank\x85?"), (12, "\x1c blank\x85?"), (13, "\x00"), (14, "\x00")]
    + [(100 + i, f"the same first letters of a text {i % 7}") for i in range(21)]
)


@pytest.mark.parametrize("sample", [50_000, 300, 1])
def test_equals_plain(spark, sample):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    for c in ("id", "body", "often", "salt", "sha", "total"):
        docs = docs.withColumn(c, F.lit(9))
    assert got(dedup_texts(docs, sample=sample)) == plain(ROWS)


def test_empty_and_single(spark):
    assert got(dedup_texts(spark.createDataFrame([], SCHEMA))) == []
    assert got(dedup_texts(spark.createDataFrame([(None, None)], SCHEMA))) == plain([(None, None)])


@pytest.mark.parametrize("often", [True, False])
def test_one_exchange_carries_the_texts(spark, monkeypatch, capsys, often):
    def table(self, df, name):
        df.explain()
        return df

    monkeypatch.setattr(exact_dedup.Scratch, "table", table)
    dedup_texts(spark.createDataFrame(ROWS if often else ROWS[-5:], SCHEMA))
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan
