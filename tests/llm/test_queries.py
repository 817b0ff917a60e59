"""The registered training-data queries against their SQL, against brute force, and by held-out accuracy."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.oracle import rows_of_query, rows_of_sql
from timedtext.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


def table(name, where="true"):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet' WHERE {where}").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert rows_of_query(QUERIES[name](spark, DATA)) == rows_of_sql(ORACLE_SQL[name], DATA)


def test_op1_accuracy(spark):
    out = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, DATA).collect()}
    docs, labels = table("documents"), table("labels")
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())
    held = [(out[i].score, q) for i, q, _ in labels if out[i].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_op8_accuracy(spark):
    out = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, DATA).collect()}
    docs = table("documents")
    held = [(out[d[0]].lang_pred, d[2]) for d in docs if out[d[0]].held_out and d[2]]
    assert len(out) == len(docs) and len(held) > 200
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert np.mean([a == b for a, b in held]) > 0.97


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_op4_base_and_verdict(spark):
    out = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, DATA).collect()}
    for d in table("documents"):
        r = out[d[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(d[1])
        assert not (r.base_failed and r.kept)
    labels = [(out[i], q) for i, q, _ in table("labels")]
    assert np.mean([r.kept for r, q in labels if q == 1 and not r.base_failed]) > 0.99
    assert np.mean([r.kept for r, q in labels if q == 0]) < 0.1


def test_op7_pieces_and_bins(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op7_best_fit_packing"](spark, DATA).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    docs = table("documents")
    assert set(by) == {d[0] for d in docs}
    for d in docs:
        ids = np.array([*tok.encode(d[1] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[d[0]], key=lambda r: r.piece):
            assert r.start == at and 0 < r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or r.piece == 0
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) * 1.01 + 1


def base_spans(text):
    kinds = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    )
    found = [(m.start(), k, m.end(), name) for k, (name, p, g, n) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m.group(g)) >= n]
    return [(name, s, e) for s, _, e, name in sorted(found)]


def test_op9_base(spark):
    out = {r.doc_id: r for r in QUERIES["op9_secret_scan"](spark, DATA).collect()}
    n = 0
    for d in table("documents"):
        spans, r = base_spans(d[1]), out[d[0]]
        n += len(spans)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex")]
        assert all(f"{k}:{s}:{e}" in r.spans.split(",") for k, s, e in spans)
    assert n > 0


def test_op10_equals_brute_force(spark):
    out = {r.vec_id: r for r in QUERIES["op10_embedding_dedup"](spark, DATA).collect()}
    rows = table("embeddings")
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    for k, r in enumerate(rows):
        assert out[r[0]].n_links == near[k].sum() - 1
    ids = np.array([r[0] for r in rows])
    low = ids.copy()
    for _ in rows:
        new = np.array([low[n].min() if n.any() else low[k] for k, n in enumerate(near)])
        if (new == low).all():
            break
        low = new
    assert [(out[i].component_id, out[i].kept) for i in ids] == [(c, c == i) for i, c in zip(ids, low)]
