"""Token ids of texts with very long runs, against the vocabulary's own library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from timedtext.llm import packing

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
MIXED = "".join(random.Random(3).choices(" \n\t\r　\x85", k=1_000_000))


def ids(text):
    return packing.token_ids(text, *packing.default_tokenizer())


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, MIXED, "\t" * 999_999 + "\n", " " * 5_000_000, "\n" * 5_000_000, "a" * 1_000_000, "!" * 1_000_000])
@pytest.mark.parametrize("around", [("x", "y"), ("", ""), ("one two ", "<|endoftext|> z"), ("\x1c", "\x1d a")])
def test_long_runs(run, around):
    if len(run) > 1_000_000 and around != ("x", "y"):
        return
    text = around[0] + run + around[1]
    assert ids(text) == PLAIN.encode(text, add_special_tokens=False).ids


def test_runs_are_cut_where_the_pattern_cuts(monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 3)
    rnd = random.Random(9)
    signs = ["a", "é", " ", " ", " ", "\n", "\t", "'s", "1", ".", "\x1c", "\x85", "　", "<|endoftext|>", "   ", "\n\n\n"]
    for _ in range(5_000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randrange(24)))
        assert ids(t) == PLAIN.encode(t, add_special_tokens=False).ids, t


def test_packing_stage_survives_long_blanks(spark):
    texts = ["x" + " " * 1_000_000 + "y", "\n" * 5_000_000, "short one"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.packing_stage(spark, docs, "").collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        want = np.array([*PLAIN.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert sum(r.length for r in own) == len(want)
        assert all(r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in own)
