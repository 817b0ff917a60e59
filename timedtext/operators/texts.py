"""Rule-driven text operators: ordered corrections, masked terms, name replacement, context pruning; and clip plans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.types import StringType

from ..functions import text as T

# Fields whose strings name sources, aliases or places, and endings of such fields.
KEPT_FIELDS = ("alias", "aliases", "source", "source_name", "original", "original_name", "romanized_name", "other_names", "also_known_as", "asr_variants", "ocr_variants", "path", "url")
KEPT_ENDINGS = ("_id", "_ids", "_path", "_url")


def apply_rules(c: str | Column, rules: list[tuple[str, str]], only_cjk: bool = False) -> Column:
    """Corrections in order, each a regular expression and its replacement; with ``only_cjk`` for texts with CJK alone."""
    col = F.col(c) if isinstance(c, str) else c
    out = col
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(T.has_cjk(col), out).otherwise(col) if only_cjk else out

#: Keys over which the rows of one video are dealt.
_DEALT = 32


def mask_terms(c: str | Column, terms: list[str]) -> Column:
    """Whole-word terms replaced by placeholders ``[[k]]``, longest first, so that a translator leaves them alone.

    A ``[[`` of the text becomes ``[[-]]``; a term that is a number is not looked for inside placeholders.
    """
    out = F.replace(F.col(c) if isinstance(c, str) else c, F.lit("[["), F.lit("[[-]]"))
    order = sorted(range(len(terms)), key=lambda k: (-len(terms[k]), terms[k]))
    for k in order:
        out = F.regexp_replace(out, f"(?U)(?<!\\w)(?<!\\[\\[){re.escape(terms[k])}(?!\\w)", f"[[{k}]]")
    return out


def unmask_terms(c: str | Column, terms: list[str]) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for k, term in enumerate(terms):
        out = F.replace(out, F.lit(f"[[{k}]]"), F.lit(term))
    return F.replace(out, F.lit("[[-]]"), F.lit("[["))


def prune_context(m: str | Column, allowed: tuple[str, ...]) -> Column:
    """The allowed keys of a map whose values are neither null nor blank."""
    return F.map_filter(m, lambda k, v: k.isin(*allowed) & F.coalesce(F.trim(v) != "", F.lit(False)))


def _rule(names: dict) -> Callable[[str], str]:
    """Replacement of whole names in one pass, longest first."""
    if not names:
        return lambda text: text
    # Canonical names stand for themselves, so that a part of one is never replaced.
    table = {**{c: c for c in names.values()}, **names}
    body = "|".join(re.escape(n).replace("\\ ", "\\s+") for n in sorted(table, key=lambda n: (-len(n), n)))
    pattern = re.compile(rf"(?<!\w)(?:{body})(?!\w)")
    return lambda text: pattern.sub(lambda m: table.get(" ".join(m.group().split()), m.group()), text)


@F.pandas_udf(StringType())
def _replace(texts: pd.Series, maps: pd.Series) -> pd.Series:
    rules: dict = {}

    def one(text: str | None, names: dict | list | None) -> str | None:
        key = tuple(dict(names).items()) if names is not None else ()
        if key not in rules:
            rules[key] = _rule(dict(key))
        return rules[key](text) if text else text

    return pd.Series([one(t, m) for t, m in zip(texts, maps)], dtype=object)


def _name_maps(aliases: DataFrame) -> DataFrame:
    """``(video_id, __m)``: the map of a video's aliases, of equal ones the first by priority."""
    pick = aliases.groupBy("video_id", "alias").agg(F.min_by("canonical", F.struct("priority", "canonical")).alias("canonical"))
    return pick.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "canonical")))).alias("__m"))


def _hashed(t: Y.DataType) -> bool:
    """Whether Spark hashes values of the type."""
    if isinstance(t, Y.StructType):
        return all(_hashed(f.dataType) for f in t)
    return _hashed(t.elementType) if isinstance(t, Y.ArrayType) else not isinstance(t, (Y.MapType, Y.VariantType))


def _with_maps(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with the map ``__m`` of their video. A video's rows are dealt over ``_DEALT`` keys, each with a copy of the small map, so
    that the texts of a few large videos do not come to as few tasks."""
    maps = _name_maps(aliases).withColumn("__deal", F.explode(F.expr(f"sequence(0L, {_DEALT - 1}L)")))
    deal = F.pmod(F.xxhash64(*[f.name for f in rows.schema if _hashed(f.dataType)]), F.lit(_DEALT).cast("long"))
    return rows.withColumn("__deal", deal).join(maps.hint("merge"), ["video_id", "__deal"], "left").drop("__deal")


def replace_names(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Texts with every whole alias replaced by its canonical name in one pass, longest first.

    ``aliases(video_id, alias, canonical, priority)`` becomes one map per video; the replacement itself is an Arrow-batched
    function, since no built-in replaces by a map.
    """
    return _with_maps(texts, aliases).withColumn("text", _replace("text", "__m")).drop("__m")


def _holds_text(t: Y.DataType) -> bool:
    """Whether a string is somewhere in the type."""
    if isinstance(t, Y.StructType):
        return any(_holds_text(f.dataType) for f in t)
    inner = getattr(t, "elementType", None) or getattr(t, "valueType", None)
    return _holds_text(inner) if inner else isinstance(t, Y.StringType)


def _keeps(key: str) -> bool:
    """Whether the strings of a field stay as they are."""
    return key.lower() in KEPT_FIELDS or key.lower().endswith(KEPT_ENDINGS)


def _renamed(value, key: str, rename):
    if key.lower() == "artifact_paths" or value is None:
        return value
    if isinstance(value, str):
        return value if _keeps(key) else rename(value)
    if isinstance(value, dict):
        return {k: _renamed(v, k, rename) for k, v in value.items()}
    if isinstance(value, list):
        # A map's entries come as pairs.
        return [(x[0], _renamed(x[1], str(x[0]), rename)) if isinstance(x, tuple) else _renamed(x, key, rename) for x in value]
    return value


def replace_names_nested(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows of any schema with ``video_id``: all strings inside, however nested, by the rule of ``replace_names``.

    Strings of fields for ids, paths, addresses and aliases stay, and all below ``artifact_paths``. A list has its field's name, a map's
    value its key's. Columns without a string are not touched; types, nulls and the order of columns stay.
    """
    touched, columns = [f.name for f in rows.schema if _holds_text(f.dataType)], rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: dict = {}
        for b in batches:
            names = [tuple(m or ()) for m in b.column(b.num_columns - 1).to_pylist()]
            for m in set(names) - rules.keys():
                rules[m] = _rule(dict(m))
            rename = [rules[m] for m in names]
            out = []
            for name, c in zip(columns, b.columns):
                if name in touched:
                    c = pa.array([_renamed(v, name, r) for v, r in zip(c.to_pylist(), rename)], c.type)
                out.append(c)
            yield pa.RecordBatch.from_arrays(out, columns)

    return _with_maps(rows, aliases).select(*columns, "__m").mapInArrow(run, rows.schema)


def caption_offsets(cues: DataFrame, decisions: DataFrame, matches: DataFrame) -> DataFrame:
    """``(video_id, cue_no, offset_ms, score)``: gap between a cue and the voice range it matches by text, and the share of the
    cue inside the range times the share of its tokens. ``matches`` comes from ``matching.match_by_tokens``."""
    d = decisions.select("video_id", "seq", F.col("start_ms").alias("v0"), F.col("end_ms").alias("v1"))
    j = matches.join(cues.select("video_id", "cue_no", "start_ms", "end_ms").hint("merge"), ["video_id", "cue_no"]).join(d.hint("merge"), ["video_id", "seq"], "left")
    overlap = F.greatest(F.lit(0), F.least("end_ms", "v1") - F.greatest("start_ms", "v0"))
    share = F.least(F.lit(1.0), overlap / F.greatest(F.lit(10), F.col("end_ms") - F.col("start_ms"))) * F.col("shared") / F.greatest("n_tokens", F.lit(1))
    gap = F.when(F.col("v0").isNull(), F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).when(F.col("end_ms") < F.col("v0"), F.col("v0") - F.col("end_ms")).when(F.col("start_ms") > F.col("v1"), F.col("start_ms") - F.col("v1")).otherwise(F.lit(0))
    return j.select("video_id", "cue_no", gap.cast("long").alias("offset_ms"), F.coalesce(share, F.lit(0.0)).alias("score"))


def clip_plan(decisions: DataFrame, media: DataFrame) -> DataFrame:
    """``(video_id, seq, clip_start_ms, clip_ms, output_ms)``: how long each clip plays and which part of the source it shows.

    The length is explicit, else the voice range, else the source range, else 3 s, and at least 0.8 s; the last clip takes up
    a difference to ``target_ms`` of at most 0.5 s or 3 percent. The source part keeps its centre and is held inside the media.
    """
    d = decisions.join(media.hint("merge"), "video_id")
    span = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a))
    n = F.coalesce(F.when(F.col("explicit_ms") > 0, F.col("explicit_ms")), span("voice_start_ms", "voice_end_ms"), span("start_ms", "end_ms"), F.lit(3000))
    d = d.withColumn("n", F.greatest(F.lit(800), n))
    every = Window.partitionBy("video_id")
    drift = F.col("target_ms") - F.sum("n").over(every)
    near = (F.col("target_ms") > 0) & (F.abs(drift) <= F.greatest(F.lit(500), F.floor(F.col("target_ms") * F.lit(3) / 100)))
    last = F.row_number().over(every.orderBy(F.desc("seq"))) == 1
    d = d.withColumn("drift", drift).withColumn("fix", near & last)
    d = d.withColumn("n", F.when(F.col("fix"), F.greatest(F.lit(800), F.col("n") + F.col("drift"))).otherwise(F.col("n")))
    d = d.withColumn("output_ms", F.least("n", F.greatest("source_ms", F.lit(800))))
    safe = F.greatest(F.lit(10), F.col("source_ms"))
    d = d.withColumn("a", F.greatest(F.lit(0), F.least("start_ms", safe))).withColumn("b", F.greatest(F.col("a"), F.least(F.coalesce("end_ms", F.col("start_ms") + F.col("n")), safe)))
    d = d.withColumn("clip_ms", F.least("output_ms", F.greatest(F.least(F.lit(800), safe), F.col("b") - F.col("a"))))
    start = F.floor((F.col("a") + F.col("b") - F.col("clip_ms")) / 2)
    start = F.greatest(F.lit(0), F.least(start, F.greatest(F.lit(0), safe - F.col("clip_ms"))))
    return d.select("video_id", "seq", start.cast("long").alias("clip_start_ms"), F.col("clip_ms").cast("long").alias("clip_ms"), F.col("output_ms").cast("long").alias("output_ms"))


def write_artifacts(tables: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Each nested table as Parquet in a folder of its own, dealt over ``buckets`` folders by a hash of the video, however many videos there are."""
    for name, df in tables.items():
        dealt = df.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))
        dealt.repartition("bucket").sortWithinPartitions("bucket", "video_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def read_artifacts(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").drop("bucket") for n in names}
