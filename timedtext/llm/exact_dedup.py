"""Exact dedup by content sort: equal normalised texts lie next to each other and the smallest identifier stays.

Sampled splitters deal the rows over ranges of their normalised bytes, each range is sorted externally, and neighbours are compared
in full. The splitters are the first bytes and a hash, so that they stay short however long the texts are. Only the text is
sorted on: no row is found to be a copy by its hash alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Characters of a text that are part of a splitter.
HEAD = 24
#: Ranges that a frequent text is dealt over.
SALTS = 64
#: Rows that the frequent texts are looked for in, and how often a text comes in them at least; most of these texts that are dealt apart.
SAMPLE, OFTEN, MOST = 50_000, 16, 2_000


def normalised(text: Column) -> Column:
    """The text with each run of blanks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def frequent_texts(docs: DataFrame, text: Column, sample: int = SAMPLE) -> list[int]:
    """Hashes of at most ``MOST`` texts that come often in about ``sample`` rows. They say where rows go, not what equals what."""
    n = docs.count()
    some = docs if n <= sample else docs.sample(sample / n, seed=11)
    seen = some.groupBy(F.xxhash64(normalised(text)).alias("h")).agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return [r["h"] for r in seen.orderBy(F.desc("n"), "h").limit(MOST).collect()]


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, salts: int = SALTS) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row; exactly one row of each group of equal texts is kept.

    A text that comes often in a sample is dealt over ``salts`` ranges next to each other; each has its smallest id and its count,
    and these few rows are sorted by the whole text once more. A frequent text that the sample misses is in one range: slower,
    with the same result. Defined cases: a null text counts as empty, and empty texts are equal to each other but not to a
    single blank; rows with a null id come last in their group, a group of null ids only has a null ``keep_id``; of rows that share
    the smallest id one is kept; long texts are compared whole; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "content-sort")
    often = frequent_texts(docs, F.col(text_col), sample)
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    rows = rows.withColumn("h", F.xxhash64("body")).withColumn("often", F.col("h").isin(often) if often else F.lit(False))
    # Rows that repeat an id have to spread too: the salt is the row's place, not its id.
    rows = rows.withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))).otherwise(0).cast("int"))
    head = F.left("body", F.lit(HEAD))
    # The ranges already hold a run's rows together, so that the window sorts them where they are; a constant salt would hide that.
    place = ["head", "h", "salt"] if often else ["head", "h"]
    dealt = rows.withColumn("head", head).repartitionByRange(*place)
    run = Window.partitionBy(*place, "body").orderBy(F.col("id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_ = dealt.select("id", "often", "salt", "body", F.row_number().over(run).alias("at"), F.first("id").over(whole).alias("low"), F.count("*").over(whole).alias("n"))
    first = F.col("often") & (F.col("at") == 1)
    runs = scratch.table(sorted_.select("id", "often", "salt", "at", "low", "n", F.sha2("body", 256).alias("sha"), F.when(first, F.col("body")).alias("body")), "runs")
    # One row a range of a frequent text: at most MOST * salts rows, whatever the size of the table.
    best = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "salt"))
    total = runs.where("often AND at = 1").groupBy("body", "sha").agg(best.alias("best"), F.sum("n").alias("total"))
    total = total.select(F.col("sha").alias("of"), "best.low", "best.salt", "total").toDF("of", "first_id", "first_salt", "total")
    out = runs.join(F.broadcast(total), F.col("often") & (F.col("sha") == F.col("of")), "left")
    low = F.when(F.col("often"), F.col("first_id")).otherwise(F.col("low"))
    return out.select(
        "id",
        low.alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        ((F.col("at") == 1) & (~F.col("often") | (F.col("salt") == F.col("first_salt")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
