"""A corpus pipeline of five stages over ``documents``: each is written as Parquet and read again by the next one.

Cases that hold for every stage: columns other than those of ``documents`` are dropped, whatever their names; an empty table
gives an empty table; the other cases are said by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm import mixing, packing, quality_classifier
from timedtext.llm.common import Scratch, crc32_mod
from timedtext.llm.line_dedup import dedup_lines
from timedtext.llm.near_copies import near_copies, text_key
from timedtext.llm.queries import MIX_SEED, SOURCE_WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labels outside the held-out fifth.

    Null and empty texts have a score by the bias alone; equal texts, and so repeated rows and ties, share their fate; a null id has
    no label and is scored like any other.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc32_mod(F.col("doc_id"), 5) != 0)
    weights = quality_classifier.fit(docs, labels)
    return quality_classifier.score(docs, weights, COLUMNS).where("score >= 0.3").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one, exactly or nearly; ``n_chars`` follows.

    All rows stay: a null text stays null with a null ``n_chars``, a document whose lines all go has an empty text. Of equal lines
    the first by id (null first), text hash and position stays; repeated rows lose the same lines.
    """
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-copy group: the first by id, text key and row key. Null ids come last; equal rows are one row.

    Null, empty and blank texts are copies of each other. A row goes only if another one of its group stays.
    """
    scratch = Scratch(spark, "near-copies")
    found = near_copies(docs, scratch).select(F.col("node").alias("key"), "root")
    # Hashes skip nulls, so that the row's key has to say where they are.
    row = F.xxhash64(F.concat(*[F.col(c).isNull().cast("string") for c in COLUMNS]), *COLUMNS)
    rows = docs.select(*COLUMNS, text_key().alias("key"), row.alias("row"))
    first = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "row")).alias("at"))
    first = first.join(found.hint("merge"), "key", "left").groupBy(F.coalesce("root", "key").alias("c")).agg(F.min("at").alias("at")).select("at.row")
    # Repeated rows become one before they are sent: a row that comes a million times is no hot key of the join.
    return rows.dropDuplicates(["row"]).join(first.hint("merge"), "row", "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target weight draws for it, in shuffled order.

    Rows with a source that is null or has no weight are left out, as their share of the mix is 0; rows with equal ids get equal
    draws, null ids that of the empty id; texts are not looked at.
    """
    return mixing.mix_sources(docs, SOURCE_WEIGHTS, seed=MIX_SEED).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens in sequences of 1,024: null and empty texts are the end token alone, repeated rows are packed each."""
    return packing.pack(docs, ["doc_id"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Training a model, fingerprints and tokens are beyond SQL; the tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
    return docs
