"""Near copies against the brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_simhash import groups
from timedtext.llm import near_copies as N


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"x{rnd.random()}"
    return out


def pairs(seed, n):
    """Texts of 12 to 600 words beside an edited one at a similarity of 0.8 to 1."""
    rnd, out = random.Random(seed), []
    while len(out) < n:
        a = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([12, 30, 80, 200, 600]))]
        b = edited(rnd, a, rnd.randint(1, max(1, len(a) // 40))) if rnd.random() < 0.7 else a[: -rnd.randint(1, max(1, len(a) // 6))]
        a, b = " ".join(a), " ".join(b)
        if 0.8 <= similarity(shingles(a), shingles(b)) < 1:
            out.append((a, b))
    return out


@pytest.mark.parametrize(("low", "high", "least"), [(0.8, 0.85, 0.99), (0.85, 1.0, 0.995)])
def test_recall_of_the_bands(low, high, least):
    found = [p for p in pairs(1, 1500) if low <= similarity(*map(shingles, p)) < high]
    hits = sum(any(x == y for x, y in zip(*(N.band_keys(N.shingle_hashes(t)) for t in p))) for p in found)
    assert len(found) > 200 and hits >= least * len(found)


def test_stage_equals_brute_force(spark):
    rnd = random.Random(3)
    texts = [t for p in pairs(2, 60) for t in p]
    for p in pairs(4, 20):  # under the threshold
        w = p[0].split(" ")
        texts += [p[0], " ".join(edited(rnd, w, max(1, len(w) // 12)))]
    family = [f"f{rnd.randrange(900)}" for _ in range(200)]
    texts += [" ".join(edited(rnd, family, 2)) for _ in range(60)]
    texts += ["", " \n", None, None, "one two", "One  TWO", "one two three"]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = [shingles(t) for t in texts]
    root = groups([(a, b) for a in range(len(rows)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8], range(len(rows)))
    got = corpus_pipeline.STAGES[2][1](spark, df, "")
    assert {r.doc_id for r in got.collect()} == set(root.values())


def test_stage_keeps_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [
        (None, text("a"), "en", None, 1),  # clean, without an id
        (None, text("b"), None, "src1", 1),  # a copy of row 7: the id wins
        (7, text("b"), None, "src1", 1),
        (None, text("c"), "en", "src0", 1),  # two copies, both without an id: one stays
        (None, text("c") + " tail", "en", "src0", 1),
        (5, text("d"), "en", "src0", 1),  # one id, two texts: both stay
        (5, text("e"), "en", "src0", 1),
        (9, text("f"), "en", "src0", 1),  # equal rows: one stays
        (9, text("f"), "en", "src0", 1),
        (3, text("g"), None, "en", 1),  # the nulls' places matter
        (4, text("g"), "en", None, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        got = [tuple(r) for r in corpus_pipeline.STAGES[2][1](spark, df.repartition(parts), "").collect()]
        c = [r for r in got if r[1].startswith("c0")]
        assert len(c) == 1 and c[0] in rows
        assert sorted(map(str, set(got) - set(c))) == sorted(map(str, [rows[0], rows[2], rows[5], rows[6], rows[7], rows[9]])) and len(got) == 7
