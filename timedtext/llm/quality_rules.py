"""Quality rules with DataFrame expressions only: fixed counts and a hashed n-gram log-likelihood ratio.

The ratio compares a multinomial over hashed n-grams of trusted target documents with one of the raw corpus. The n-grams are
words and pairs of adjacent word endings; both are hashed into the same buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLANKS = " \t\n\x0b\x0c\r"
BUCKETS = 1 << 16
WINDOW = 8
#: Documents whose mean log-likelihood ratio per n-gram is lower are not kept.
THRESHOLD = -0.3
_SMOOTHING = 1.0


def words(text: str) -> Column:
    """Words of a text, cut at ASCII blanks; none for null."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    return F.filter(F.split(trimmed, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` and the words as ``__w``.

    Windows are compared by a 64-bit hash of their word hashes. Only rows that have a repeated window sort their windows.
    """
    d = docs.withColumn("__w", words(text_col))
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = d.withColumn("__lines", lines).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    d = d.withColumn("n_words", F.size("__w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[#*$%&|<>]")).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.size("__h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("__win", F.transform(starts, lambda i: F.xxhash64(F.slice("__h", i + 1, F.lit(WINDOW)))))
    some = F.size(F.array_distinct("__win")) < F.size("__win")
    by_hash = F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__s", F.when(some, by_hash))
    same = lambda x, k: F.coalesce(F.get("__s", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("__s", lambda x, k: ((k > 0) & same(x, k - 1)) | same(x, k + 1))
    d = d.withColumn("__p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.when(k == 0, F.lit(WINDOW)).otherwise(p - F.get("__p", k - 1))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    d = d.withColumn("n_repeat_words", F.when(F.col("__s").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return d.drop("__lines", "__h", "__win", "__s", "__p")


def _buckets(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per n-gram of ``__w``: ``keep`` and its ``bucket``."""
    at = rows.where("size(__w) > 0").select(*keep, "__w", F.explode(F.sequence(F.lit(0), F.size("__w") - 1)).alias("__i"))
    word, after = F.get("__w", F.col("__i")), F.get("__w", F.col("__i") + 1)
    pair = F.hash(F.right(word, F.lit(3)), F.coalesce(F.right(after, F.lit(3)), F.lit("")))
    at = at.select(*keep, F.hash(word).alias("__one"), pair.alias("__two"))
    return at.select(*keep, F.explode(F.array("__one", "__two")).alias("bucket")).withColumn("bucket", F.col("bucket").bitwiseAND(BUCKETS - 1))


def ratios(docs: DataFrame, trusted: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(bucket, llr)`` of every bucket in use: counts over the documents with an id in ``trusted`` against counts over all.

    ``trusted`` has one column, the ids; it is joined by a sort merge, since it grows with the corpus.
    """
    flag = trusted.select(F.col(trusted.columns[0]).alias("__tid")).where("__tid is not null").distinct()
    both = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(flag.hint("merge"), F.col("__id") == F.col("__tid"), "left")
    rows = both.select(F.col("__tid").isNotNull().cast("long").alias("__yes"), words("__t").alias("__w"))
    counts = scratch.table(_buckets(rows, "__yes").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("__yes").alias("target")), "counts")
    total = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not total[1]:
        return counts.select("bucket", F.lit(0.0).alias("llr"))
    r, t = total[0] + _SMOOTHING * BUCKETS, total[1] + _SMOOTHING * BUCKETS
    llr = F.log((F.col("target") + _SMOOTHING) / F.lit(float(t))) - F.log((F.col("raw") + _SMOOTHING) / F.lit(float(r)))
    return counts.select("bucket", llr.alias("llr"))


def apply_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row's id, the base counts, ``base_failed``, ``llr`` (mean over its n-grams) and ``kept``.

    Defined cases: a null text has no words, fails the base and is not kept; with no trusted document all ratios are 0;
    rows with equal or null ids are judged one by one; an empty table gives an empty result; other columns are not read.
    The table of ratios has at most ``BUCKETS`` rows and is broadcast; sums per document are partial before they are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    table = scratch.table(ratios(docs, trusted, scratch, id_col, text_col), "ratios")
    base = base_counts(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t")
    base = base.select(F.monotonically_increasing_id().alias("__row"), "__id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "__w")
    fixed = ["__id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # One hash stands for the row and its counts while n-grams are summed; an empty document keeps a row without a bucket.
    grams = base.select("__row", *fixed, "__w", F.explode_outer(F.when(F.size("__w") > 0, F.sequence(F.lit(0), F.size("__w") - 1))).alias("__i"))
    word, after = F.get("__w", F.col("__i")), F.get("__w", F.col("__i") + 1)
    pair = F.hash(F.right(word, F.lit(3)), F.coalesce(F.right(after, F.lit(3)), F.lit("")))
    grams = grams.select("__row", *fixed, F.hash(word).bitwiseAND(BUCKETS - 1).alias("b1"), pair.bitwiseAND(BUCKETS - 1).alias("b2"))
    for k in ("1", "2"):
        grams = grams.join(F.broadcast(table.select(F.col("bucket").alias(f"b{k}"), F.col("llr").alias(f"l{k}"))), f"b{k}", "left")
    sums = grams.groupBy("__row").agg(*[F.first(c).alias(c) for c in fixed], (F.sum(F.coalesce("l1", F.lit(0.0)) + F.coalesce("l2", F.lit(0.0))) / (2 * F.count("*"))).alias("llr"))
    return sums.select(F.col("__id").alias(id_col), *fixed[1:], "llr", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))
