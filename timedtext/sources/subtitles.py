"""Readers and writers of subtitle and word-timing files, and choice among listed files."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import times


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, applied once at ingest; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def parse_srt(files: DataFrame) -> DataFrame:
    """Cues ``(video_id, track, cue_no, start_ms, end_ms, text)`` of ``files(video_id, track, content)``.

    A byte-order mark is dropped, blocks are cut at blank lines, and blocks with fewer than two lines or without a time
    line are left out; the lines after the time line are joined by blanks.
    """
    body = F.regexp_replace(F.regexp_replace(nfc("content"), "^\\x{FEFF}", ""), "\\r\\n?", "\n")
    blocks = files.select("video_id", "track", F.posexplode(F.split(F.trim(body), "\\n[ \\t]*\\n")).alias("block_no", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), F.trim), lambda x: x != "")
    d = blocks.select("video_id", "track", "block_no", lines.alias("lines"))
    d = d.withColumn("at", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True)).where((F.size("lines") >= 2) & (F.col("at") > 0))
    span = F.split(F.get("lines", (F.col("at") - 1).cast("int")), "-->")
    text = F.array_join(F.slice("lines", F.col("at").cast("int") + 1, F.size("lines")), " ")
    end = F.regexp_extract(F.trim(F.get(span, F.lit(1))), "^\\S+", 0)
    d = d.select("video_id", "track", "block_no", times.parse_timestamp(F.get(span, F.lit(0))).alias("start_ms"), times.parse_timestamp(end).alias("end_ms"), text.alias("text")).where("text <> ''")
    no = F.row_number().over(Window.partitionBy("video_id", "track").orderBy("block_no"))
    return d.withColumn("cue_no", no).select("video_id", "track", "cue_no", "start_ms", "end_ms", "text")


def read_srt(spark: SparkSession, glob: str) -> DataFrame:
    """All files ``.../<video_id>/subtitles.<track>.srt`` below a path that Spark reads."""
    f = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    f = f.select(F.url_decode(F.regexp_extract("path", "([^/]+)/[^/]+$", 1)).alias("video_id"), F.regexp_extract("path", "subtitles\\.([^/]+)\\.srt$", 1).alias("track"), "content")
    return parse_srt(f)


def srt_text(cues: DataFrame) -> DataFrame:
    """``(video_id, track, content)``: numbered blocks from 1 in order of the cues."""
    no = F.row_number().over(Window.partitionBy("video_id", "track").orderBy("cue_no"))
    block = F.concat_ws("\n", no.cast("string"), F.concat(times.format_timestamp("start_ms"), F.lit(" --> "), times.format_timestamp("end_ms")), F.trim("text"))
    d = cues.select("video_id", "track", "cue_no", block.alias("block"))
    rows = F.array_sort(F.collect_list(F.struct("cue_no", "block")))
    return d.groupBy("video_id", "track").agg(F.concat(F.array_join(F.transform(rows, lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("content"))


def write_srt(cues: DataFrame, path: str) -> None:
    srt_text(cues).repartition("video_id", "track").write.partitionBy("video_id", "track").mode("overwrite").text(path)


def word_boundaries(lines: DataFrame, part_lengths: DataFrame) -> DataFrame:
    """``(video_id, word_no, word, start_ms, end_ms)`` of boundary lines ``(video_id, part_no, line_no, line)`` of JSON.

    Times are ticks of 100 ns in a part; parts are laid end to end by ``part_lengths(video_id, part_no, length_ms)``. Lines of
    another type or without text are left out; a word lasts at least 0.01 s.
    """
    j = lines.select("video_id", "part_no", "line_no", F.from_json("line", "type string, offset bigint, duration bigint, text string").alias("j")).where("j.type = 'WordBoundary' and trim(j.text) <> ''")
    w = Window.partitionBy("video_id").orderBy("part_no")
    offset = part_lengths.select("video_id", "part_no", F.coalesce(F.sum("length_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    d = j.join(offset.hint("merge"), ["video_id", "part_no"])
    start = F.col("base") + F.floor(F.col("j.offset") / 10000 + 0.5)
    d = d.select("video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("part_no", "line_no")).alias("word_no"), F.trim("j.text").alias("word"), start.cast("long").alias("start_ms"), F.greatest(F.lit(10), F.floor(F.col("j.duration") / 10000 + 0.5)).cast("long").alias("n"))
    return d.select("video_id", "word_no", "word", "start_ms", (F.col("start_ms") + F.col("n")).alias("end_ms"))


def rescale_words(words: DataFrame, durations: DataFrame) -> DataFrame:
    """Words at another duration, ``durations(video_id, from_ms, to_ms)``: scaled if both are positive, held to the media, at
    least 0.01 s long; empty words are left out."""
    factor = F.when((F.col("from_ms") > 0) & (F.col("to_ms") > 0), F.col("to_ms") / F.col("from_ms")).otherwise(F.lit(1.0))
    d = words.join(durations.hint("merge"), "video_id").withColumn("__f", factor).where("trim(word) <> '' and end_ms > start_ms")
    held = lambda c: F.greatest(F.lit(0), F.least(F.col("to_ms"), F.floor(F.col(c) * F.col("__f") + 0.5))).cast("long")
    d = d.withColumn("s", held("start_ms")).withColumn("e", F.greatest(held("end_ms"), F.col("s") + 10))
    return d.select("video_id", "word_no", "word", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def pick_track(tracks: DataFrame, wanted: str = "auto") -> DataFrame:
    """One listed track ``(video_id, language, name)`` per video.

    The wanted language; for ``auto`` one that has an original-language track, then by ``lang_rank``. Inside a language a
    supplied track (name without ``-orig``) comes before an automatic one.
    """
    orig = F.col("name").rlike("-orig(\\.[^.]*)?$")
    d = tracks if wanted == "auto" else tracks.where(F.col("language") == wanted)
    d = d.withColumn("__orig", orig).withColumn("__has", F.max(orig.cast("int")).over(Window.partitionBy("video_id", "language")))
    w = Window.partitionBy("video_id").orderBy(F.desc("__has"), "lang_rank", "__orig", "name")
    return d.withColumn("__i", F.row_number().over(w)).where("__i = 1").select("video_id", "language", "name")


def pick_artifacts(listing: DataFrame, precedence: DataFrame) -> DataFrame:
    """The first non-empty file per role: ``listing(video_id, name, size)``, ``precedence(role, name, rank)``."""
    d = listing.where("size > 0").join(precedence.hint("merge"), "name")
    w = Window.partitionBy("video_id", "role").orderBy("rank", "name")
    return d.withColumn("__i", F.row_number().over(w)).where("__i = 1").select("video_id", "role", "name")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records of a JSON index (an array of objects): rows without an id are dropped, and a completed job without a
    completion time takes its last update."""
    files = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("j"))
    items = spark.sql("SELECT v.value AS v FROM {files}, LATERAL variant_explode(j) AS v", files=files)
    fields = {"job_id": "string", "status": "string", "progress": "int", "stage": "string", "created_at": "timestamp", "updated_at": "timestamp", "completed_at": "timestamp", "error": "string"}
    d = items.select(*[F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in fields.items()]).where("job_id <> ''")
    return d.withColumn("completed_at", F.coalesce("completed_at", F.when(F.col("status") == "completed", F.col("updated_at"))))
