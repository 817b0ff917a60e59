"""Operators on subtitle cues ``(video_id, cue_no, start_ms, end_ms, text)``: clean-up, slots, segmentation, windows.

Everything is partitioned by ``video_id``. A step that depends on what the step before emitted is a fold over the sorted rows
of one video (`fold_groups`); it returns group numbers only, and Spark does the grouping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import clamp


def _w(*order: str | Column) -> Window:
    return Window.partitionBy("video_id").orderBy(*order)


def clamp_cues(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Cues that start at least 0.1 s before the end of the media, cut to its length. ``durations(video_id, duration_ms)``."""
    d = cues.join(durations.hint("merge"), "video_id").where("start_ms < duration_ms - 100")
    return d.withColumn("end_ms", F.least("end_ms", "duration_ms")).drop("duration_ms")


def scale_time(cues: DataFrame, speed: float | Column) -> DataFrame:
    """The timeline at another playback speed, floored at 0.01."""
    s = F.greatest(F.lit(0.01), speed if isinstance(speed, Column) else F.lit(float(speed)))
    return cues.withColumn("start_ms", F.floor(F.col("start_ms") / s + 0.5).cast("long")).withColumn("end_ms", F.floor(F.col("end_ms") / s + 0.5).cast("long"))


def normalize_cues(cues: DataFrame) -> DataFrame:
    """Cues in order of start without empty ones; an end beyond the next start moves to max(start + 0.6 s, next - 0.04 s).

    The next start is taken before empty cues are dropped, as an empty cue still ends the one before it.
    """
    nxt = F.lead("start_ms").over(_w("start_ms", "cue_no"))
    end = F.when(nxt < F.col("end_ms"), F.greatest(F.col("start_ms") + 600, nxt - 40)).otherwise(F.col("end_ms"))
    return cues.withColumn("__end", end).where("end_ms > start_ms").withColumn("end_ms", F.col("__end")).drop("__end")


def speech_slots(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """``(video_id, cue_no, available_ms, gap_ms)``: the speech slot of each cue and the silence before it.

    A slot ends at the cue's end, the next start or the end of the media; slots under 0.03 s are left out; a cue that
    touches the next gives up to 0.05 s. The gap counts from the end of the slot kept before.
    """
    d = cues.join(durations.hint("merge"), "video_id").withColumn("nxt", F.lead("start_ms").over(_w("start_ms", "cue_no")))
    d = d.withColumn("limit", F.coalesce("nxt", "duration_ms")).withColumn("slot_end", F.least("end_ms", "limit", "duration_ms"))
    d = d.withColumn("slot", F.col("slot_end") - F.col("start_ms")).where("slot >= 30")
    pause = F.when(F.col("nxt").isNotNull() & (F.col("slot_end") >= F.col("nxt")), F.least(F.lit(50), F.greatest(F.lit(0), F.col("slot") - 30))).otherwise(F.lit(0))
    d = d.withColumn("available_ms", F.col("slot") - pause)
    before = F.coalesce(F.lag(F.col("start_ms") + F.col("available_ms")).over(_w("start_ms", "cue_no")), F.lit(0))
    return d.withColumn("gap_ms", F.greatest(F.lit(0), F.col("start_ms") - before)).select("video_id", "cue_no", "available_ms", "gap_ms")


def cue_health(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Per video: cues out of bounds, overlaps in list order, empty cues, coverage and reading rates with their score."""
    d = cues.join(durations.hint("merge"), "video_id").withColumn("before", F.lag("end_ms").over(_w("cue_no")))
    bad = (F.col("start_ms") < -10) | (F.col("end_ms") <= F.col("start_ms")) | ((F.col("duration_ms") > 0) & (F.col("end_ms") > F.col("duration_ms") + 200))
    chars = F.length(T.alignment_key("text"))
    rate = F.when(chars > 0, chars * 1000 / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(50)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    g = d.withColumn("__rate", rate).withColumn("__chars", chars).groupBy("video_id").agg(
        F.count("*").alias("n_cues"),
        n(bad).alias("n_out_of_bounds"),
        n(F.col("start_ms") < F.col("before") - 20).alias("n_overlaps"),
        n(F.col("__chars") == 0).alias("n_empty"),
        (100 * F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))) / F.greatest(F.max("duration_ms"), F.lit(10))).alias("coverage"),
        F.coalesce(F.avg("__rate"), F.lit(0.0)).alias("mean_rate"),
        F.coalesce(F.max("__rate"), F.lit(0.0)).alias("max_rate"),
    )
    readable = clamp(100 - F.greatest(F.lit(0.0), F.col("mean_rate") - 17) * 4 - F.greatest(F.lit(0.0), F.col("max_rate") - 25) * 1.5)
    bounds = clamp(100 - 100 * (F.col("n_out_of_bounds") + F.col("n_overlaps")) / F.greatest("n_cues", F.lit(1)))
    return g.withColumn("readability", readable).withColumn("bounds_score", bounds)


_BLOCK = 256


def fold_groups(rows: DataFrame, order: list[str], payload: list[str], zero: Column, step: Callable[[Column, Column], Column], out: str = "group_no") -> DataFrame:
    """Number the rows of each video by a fold.

    ``step(state, row)`` returns the next state, a struct whose field ``g`` is the row's group number. The fold runs inside the
    JVM over the sorted rows of a video; only ``order`` and ``payload`` columns are gathered.
    """
    names = [*order, *payload]
    sorted_ = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__rows"))

    # Numbers are appended to a short block, and blocks to the result: a growing array is not copied for each row.
    none = F.array().cast("array<int>")

    def go(acc: Column, row: Column) -> Column:
        state = step(acc["state"], row)
        block = F.concat(acc["block"], F.array(state["g"]))
        full = F.size(acc["block"]) >= _BLOCK - 1
        return F.struct(state.alias("state"), F.when(full, none).otherwise(block).alias("block"), F.when(full, F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"))

    start = F.struct(zero.alias("state"), none.alias("block"), F.array().cast("array<array<int>>").alias("out"))
    folded = sorted_.withColumn("__g", F.aggregate("__rows", start, go, lambda acc: F.concat(F.flatten(acc["out"]), acc["block"])))
    return folded.select("video_id", F.explode(F.arrays_zip("__rows", "__g")).alias("__x")).select("video_id", *[F.col(f"__x.__rows.{c}").alias(c) for c in names], F.col("__x.__g").alias(out))


def drop_repeats(cues: DataFrame) -> DataFrame:
    """Cues without repeated recognitions: against the last kept text, in lower case, equal, or over 10 characters and
    contained at the previous one's end or starting with it."""
    rows = cues.where(F.trim("text") != "").withColumn("key", F.lower(F.trim("text")))
    zero = F.struct(F.lit(0).alias("g"), F.lit("").alias("kept"))

    def step(s: Column, r: Column) -> Column:
        long_ = F.length(r["key"]) > 10
        same = (s["g"] != 0) & ((r["key"] == s["kept"]) | (long_ & (F.endswith(s["kept"], r["key"]) | F.startswith(r["key"], s["kept"]))))
        n = F.abs(s["g"])
        return F.struct(F.when(same, -n).otherwise(n + 1).cast("int").alias("g"), F.when(same, s["kept"]).otherwise(r["key"]).alias("kept"))

    kept = fold_groups(rows, ["start_ms", "cue_no"], ["key"], zero, step).where("group_no > 0").select("video_id", "cue_no")
    return cues.join(kept.hint("merge"), ["video_id", "cue_no"], "left_semi")


def _grouped(numbered: DataFrame) -> DataFrame:
    """The fold carries the trimmed texts ``t``, so that nothing is joined back."""
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "cue_no", "end_ms", "t")))
    g = numbered.groupBy("video_id", "group_no").agg(rows.alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["t"]), " ")
    return g.select("video_id", "group_no", F.get("r", F.lit(0))["start_ms"].alias("start_ms"), F.element_at("r", -1)["end_ms"].alias("end_ms"), text.alias("text"), F.size("r").alias("n_cues"))


def group_cues(cues: DataFrame, max_chars: int = 90, max_ms: int = 6000, max_gap_ms: int = 750) -> DataFrame:
    """Cues joined to sentences: cut before a row that makes the group too long in characters or time, or after a gap behind a
    complete sentence; and after a complete sentence that is at least half as long as allowed or follows a gap."""
    rows = normalize_cues(cues).where(F.trim("text") != "")
    rows = rows.withColumn("t", F.trim("text")).withColumn("n", F.length("t")).withColumn("done", T.ends_sentence("text") & ~T.is_incomplete("text"))
    zero = F.struct(F.lit(0).alias("g"), F.lit(True).alias("closed"), F.lit(0).alias("chars"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), F.lit(False).alias("done"))

    def step(s: Column, r: Column) -> Column:
        gap, merged = r["start_ms"] - s["last"], s["chars"] + 1 + r["n"]
        cut = s["closed"] | (merged > max_chars) | (r["end_ms"] - s["first"] > max_ms) | ((gap > max_gap_ms) & s["done"])
        chars = F.when(cut, r["n"]).otherwise(merged)
        # A sentence that opens an empty group ends it at once; otherwise it must be long enough or follow a gap.
        close = r["done"] & (s["closed"] | (chars >= max_chars * 0.5) | (gap > max_gap_ms))
        return F.struct((s["g"] + cut.cast("int")).alias("g"), close.alias("closed"), chars.cast("int").alias("chars"), F.when(cut, r["start_ms"]).otherwise(s["first"]).alias("first"), r["end_ms"].alias("last"), r["done"].alias("done"))

    return _grouped(fold_groups(rows, ["start_ms", "cue_no"], ["end_ms", "n", "done", "t"], zero, step))


def merge_cues(cues: DataFrame, max_gap_ms: int = 300, max_chars: int = 120, max_ms: int = 8000) -> DataFrame:
    """Cues merged for speech while the gap, length and span are small and the text so far does not end a sentence."""
    rows = cues.withColumn("t", F.trim("text")).withColumn("n", F.length("t")).withColumn("ends", T.ends_sentence("text"))
    zero = F.struct(F.lit(0).alias("g"), F.lit(0).alias("chars"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), F.lit(True).alias("ends"))

    def step(s: Column, r: Column) -> Column:
        merged = s["chars"] + 1 + r["n"]
        join = (s["g"] > 0) & (r["start_ms"] - s["last"] <= max_gap_ms) & (merged <= max_chars) & (r["end_ms"] - s["first"] <= max_ms) & ~s["ends"]
        return F.struct((s["g"] + (~join).cast("int")).alias("g"), F.when(join, merged).otherwise(r["n"]).cast("int").alias("chars"), F.when(join, s["first"]).otherwise(r["start_ms"]).alias("first"), r["end_ms"].alias("last"), r["ends"].alias("ends"))

    return _grouped(fold_groups(rows, ["start_ms", "cue_no"], ["end_ms", "n", "ends", "t"], zero, step))


def pack_batches(items: DataFrame, size: str, max_items: int = 20, max_chars: int = 4600, overhead: int = 60) -> DataFrame:
    """``(video_id, item_no, batch_no)``: greedy batches by number of items and by characters with an overhead per item."""
    rows = items.select("video_id", "item_no", (F.col(size) + overhead).cast("long").alias("cost"))
    zero = F.struct(F.lit(0).alias("g"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, r: Column) -> Column:
        cut = (s["g"] == 0) | (s["k"] >= max_items) | (s["used"] + r["cost"] > max_chars)
        return F.struct((s["g"] + cut.cast("int")).alias("g"), F.when(cut, 1).otherwise(s["k"] + 1).alias("k"), F.when(cut, r["cost"]).otherwise(s["used"] + r["cost"]).alias("used"))

    return fold_groups(rows, ["item_no"], ["cost"], zero, step, "batch_no").drop("cost")


def pack_words(texts: DataFrame, max_chars: int) -> DataFrame:
    """``(video_id, chunk_no, chunk)``: words packed into chunks of at most ``max_chars`` characters with single blanks.

    A longer word is a chunk of its own. One row a video. The longest run of whole words that fits is what a greedy pattern takes first,
    so that a text is packed where it is read.
    """
    plain = F.trim(F.regexp_replace("text", "\\s+", " "))
    chunks = F.regexp_extract_all(plain, F.lit(f"(?s)(.{{1,{max_chars}}}|[^ ]+)(?: |\\z)"), F.lit(1))
    return texts.select("video_id", F.posexplode(chunks).alias("i", "chunk")).select("video_id", (F.col("i") + 1).alias("chunk_no"), "chunk")


def with_context(cues: DataFrame, batch: int = 20, before: int = 8, after: int = 4) -> DataFrame:
    """One row per batch of ``batch`` cues with the texts of the rows around it."""
    n, own = F.col("__n"), F.floor(F.col("__n") / batch)
    to = lambda first, last, part: F.coalesce(F.when(first <= last, F.transform(F.sequence(first, last), lambda c: F.struct(c.alias("batch_no"), F.lit(part).alias("part")))), none)
    none = F.array().cast("array<struct<batch_no: bigint, part: int>>")
    # A text goes to the few batches that it precedes or follows, instead of twelve texts to each row.
    parts = F.concat(to(own, own, 0), to(own + 1, F.floor((n + before) / batch), -1), to(F.greatest(F.lit(0), F.floor((n - after) / batch)), own - 1, 1))
    d = cues.select("video_id", "text", (F.row_number().over(_w("cue_no")) - 1).alias("__n")).select("video_id", "text", "__n", F.inline(parts))
    texts = lambda part: F.collect_list(F.when((F.col("part") == part) & F.col("text").isNotNull(), F.struct("__n", "text")))
    d = d.withColumn("text", F.when(F.col("part") != 0, F.col("text"))).groupBy("video_id", "batch_no").agg(F.sum((F.col("part") == 0).cast("long")).alias("n_items"), texts(-1).alias("prev"), texts(1).alias("nxt"))
    in_order = lambda c: F.transform(F.array_sort(c), lambda x: x["text"]).alias(c)
    return d.where("n_items > 0").select("video_id", "batch_no", "n_items", in_order("prev"), in_order("nxt"))


def sliding_windows(cues: DataFrame, most: int = 8, max_ms: int = 42_000, min_ms: int = 5_000) -> DataFrame:
    """``(video_id, start_no, end_no, start_ms, end_ms, text)``: runs of up to ``most`` cues from each cue.

    A run goes on while the span from its start is at most ``max_ms``, and counts from ``min_ms`` or at the last cue.
    """
    row = F.struct(F.col("cue_no").alias("no"), "start_ms", "end_ms", F.col("text").alias("t"))
    d = cues.withColumn("__a", F.collect_list(row).over(_w("cue_no").rowsBetween(0, most - 1))).withColumn("__last", F.max("cue_no").over(Window.partitionBy("video_id")))
    d = d.select("video_id", "cue_no", "start_ms", "__a", "__last", F.posexplode("__a").alias("__i", "x"))
    span = F.col("x.end_ms") - F.col("start_ms")
    d = d.where((F.forall(F.slice("__a", F.lit(1), F.col("__i") + 1), lambda y: y["end_ms"] - F.col("start_ms") <= max_ms)) & ((span >= min_ms) | (F.col("x.no") == F.col("__last"))))
    text = F.array_join(F.transform(F.slice("__a", F.lit(1), F.col("__i") + 1), lambda y: y["t"]), " ")
    return d.select("video_id", F.col("cue_no").alias("start_no"), F.col("x.no").alias("end_no"), "start_ms", F.col("x.end_ms").alias("end_ms"), text.alias("text"))


def sample_evenly(rows: DataFrame, n: int | Column, order: str = "cue_no") -> DataFrame:
    """``n`` rows of each video at rounded even positions; all rows if there are no more."""
    d = rows.withColumn("__i", F.row_number().over(_w(order)) - 1).withColumn("__k", F.count("*").over(Window.partitionBy("video_id")))
    # Position i(k-1)/(n-1) for some i is this row if the nearest i of the row rounds back to it.
    i = F.col("__i") * (n - 1) / F.greatest(F.col("__k") - 1, F.lit(1))
    at = lambda j: F.bround(j * (F.col("__k") - 1) / (n - 1), 0)
    hit = (at(F.floor(i)) == F.col("__i")) | (at(F.floor(i) + 1) == F.col("__i"))
    return d.where((F.col("__k") <= n) | hit).drop("__i", "__k")


def consolidate(ranges: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` ranges per video: even groups of rows with rounded edges."""
    d = ranges.withColumn("__i", F.row_number().over(_w("start_ms", "end_ms")) - 1).withColumn("__k", F.count("*").over(Window.partitionBy("video_id")))
    n = F.least(F.col("__k"), F.lit(limit))
    g = F.floor(((F.col("__i") + 0.5) * n) / F.col("__k"))
    return d.withColumn("group_no", g.cast("long")).groupBy("video_id", "group_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def transcript(lines: DataFrame) -> DataFrame:
    """``(video_id, transcript)``: lines in order without blank, digit-only and arrow lines, blanks squeezed."""
    good = lines.where((F.trim("line") != "") & ~F.trim("line").rlike("^[0-9]+$") & ~F.contains("line", F.lit("-->")))
    row = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    joined = F.array_join(F.transform(row, lambda x: x["line"]), " ")
    return good.groupBy("video_id").agg(F.trim(F.regexp_replace(joined, "\\s+", " ")).alias("transcript"))
