import random

from timedtext.llm import line_dedup as L


def shingles(line):
    b = line.encode("utf-16-be")
    n = len(b) // 2
    return {b[2 * i : 2 * (i + L.SHINGLE)] for i in range(max(1, n - L.SHINGLE + 1))}


def brute_force(docs, threshold=L.THRESHOLD):
    """Components over all pairs of distinct lines; the first line of each by id, (hash is unique here) and position stays."""
    lines = sorted({x.strip(" \t\r\x0b\x0c") for _, t in docs if t is not None for x in t.split("\n")} - {""})
    sets, root = [shingles(x) for x in lines], list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    name = {x: find(i) for i, x in enumerate(lines)}
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        if t is None:
            out[i] = None
            continue
        keep = []
        for x in t.split("\n"):
            c = name.get(x.strip(" \t\r\x0b\x0c"))
            if c is None or c not in seen:
                keep.append(x)
            seen.add(c) if c is not None else None
        out[i] = "\n".join(keep)
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    pool = [line(rnd.randint(1, 40)) for _ in range(60)] + ["x", "ü", "é" * 11, "é" * 12]
    docs = []
    for i in range(60):
        rows = []
        for _ in range(rnd.randint(1, 6)):
            x = rnd.choice(pool) if rnd.random() < 0.5 else line(rnd.randint(3, 30))
            if rnd.random() < 0.4:
                w = x.split(" ")
                w[rnd.randrange(len(w))] = "zz"
                x = " ".join(w) if len(w) > 25 else x
            rows.append(x)
        docs.append((i, "\n".join(rows)))
    family = line(60).split(" ")
    for i in range(60, 100):  # one large family of near copies
        w = list(family)
        w[rnd.randrange(60)] = rnd.choice(words)
        docs.append((i, "  " + " ".join(w) + "\t\n\n" + line(20)))
    return docs + [(200, None), (201, ""), (202, "\n \n"), (203, "word " * 4000)]


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, h1 string, n int")
    out = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    want = brute_force(docs)
    assert set(out) == set(want)
    wrong = [i for i in want if out[i].text != want[i]]
    assert len(wrong) <= 2, wrong  # the bands miss few pairs near the threshold
    assert out[200].n_lines is None and out[201].n_lines == 1 and out[0].h1 == "n" and out[0].n == 1


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a long line of some text\nsecond line here"), (5, "a long line of some text\nsecond line here"), (None, "a long line of some text"), (7, "second line here\nown line of seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in L.dedup_lines(df).collect())
    assert got == [("5", "second line here"), ("5", "second line here"), ("7", "own line of seven"), ("None", "a long line of some text")]


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_representatives_are_for_buckets_of_many(spark, monkeypatch):
    seen = []
    nearest = L._nearest
    monkeypatch.setattr(L, "_nearest", lambda placed, *more: seen.append({r.key: r["count"] for r in placed.groupBy("key").count().collect()}) or nearest(placed, *more))
    # Half of each bucket holds one set, the other half another one.
    bands = spark.createDataFrame([(b * 1000 + i, b) for b, n in ((1, 10), (2, 40)) for i in range(n)], "h1 long, key long")
    sets = bands.selectExpr("h1", "transform(sequence(0, 19), x -> cast(x + 100 * (h1 % 2) as int)) shingles")
    words = [f"cast(if(h1 % 2 = 0, {j}, -1 - {j}) as long) w{j}" for j in range(L.WORDS)]
    sketch = sets.selectExpr("h1", "20L n", *words)
    root = {r.node: r.root for r in L.linked(bands, lambda ids: (sets, sketch), L.Scratch(spark, "few")).collect()}
    assert root == {b * 1000 + i: b * 1000 + i % 2 for b, n in ((1, 10), (2, 40)) for i in range(n)}
    assert seen == [{2: 40}, {2: 40}]
