"""Matching of texts, words, scenes, events and names by shared tokens and positions; no pair is made without a shared key."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folding import bind


def align_by_chars(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``(video_id, text_no, word_no)``: the words whose letters fall into a text's letters.

    ``texts(video_id, text_no, text)`` and ``words(video_id, word_no, word, start_ms, end_ms)``. Both sides are laid out by
    cumulative letter counts. A video counts only if the letters of both sides are equal and every text has letters. The
    join is by the blocks of 64 letters that both touch.
    """
    return _aligned(texts, words).select("video_id", "text_no", "word_no")


def _aligned(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs of ``align_by_chars`` with the times of the words, which come along instead of by a join of their own."""
    t = texts.withColumn("key", T.alignment_key("text")).where("trim(text) <> ''")
    w = words.withColumn("key", T.alignment_key("word")).where("key <> '' and end_ms > start_ms")
    full = lambda d, no: d.groupBy("video_id").agg(F.min(F.length("key")).alias("least"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(no, "key"))), lambda x: x["key"]), ""), 256).alias("all"))
    same = full(t, "text_no").where("least > 0").join(full(w, "word_no").select("video_id", F.col("all").alias("other")).hint("merge"), "video_id").where("all = other").select("video_id")

    def placed(d: DataFrame, no: str, name: str, *more: str) -> DataFrame:
        to = F.sum(F.length("key")).over(Window.partitionBy("video_id").orderBy(no).rowsBetween(Window.unboundedPreceding, 0))
        d = d.join(same.hint("merge"), "video_id", "left_semi").withColumn("to", to).withColumn("from", F.col("to") - F.length("key"))
        blocks = F.explode(F.sequence(F.floor(F.col("from") / 64), F.floor((F.col("to") - 1) / 64)))
        return d.select("video_id", no, *more, blocks.alias("block"), F.col("from").alias(f"{name}_from"), F.col("to").alias(f"{name}_to"))

    j = placed(t, "text_no", "t").join(placed(w, "word_no", "w", "start_ms", "end_ms").hint("merge"), ["video_id", "block"])
    first = F.col("block") == F.floor(F.greatest("t_from", "w_from") / 64)
    return j.where((F.col("w_to") > F.col("t_from")) & (F.col("w_from") < F.col("t_to")) & first).select("video_id", "text_no", "word_no", "start_ms", "end_ms")


def _word_spans(texts: DataFrame, words: DataFrame) -> DataFrame:
    return _aligned(texts, words).groupBy("video_id", "text_no").agg(F.min_by("start_ms", "word_no").alias("w0"), F.max_by("end_ms", "word_no").alias("w1"))


def time_captions(texts: DataFrame, words: DataFrame, durations: DataFrame) -> DataFrame:
    """Caption times from word times: 0.08 s before the first word to 0.18 s after the last, fitted to the next caption's start,
    at least 0.12 s long and within the media."""
    d = _word_spans(texts, words).join(durations.hint("merge"), "video_id")
    d = d.withColumn("start_ms", F.greatest(F.lit(0), F.col("w0") - 80)).withColumn("e", F.least("duration_ms", F.col("w1") + 180))
    nxt = F.lead("start_ms").over(Window.partitionBy("video_id").orderBy("text_no"))
    e = F.when(nxt.isNull(), F.col("e")).when(nxt > F.col("start_ms") + 120, F.least("e", nxt)).otherwise(F.greatest("e", nxt))
    d = d.withColumn("end_ms", F.least("duration_ms", F.greatest(F.col("start_ms") + 120, e)))
    ok = F.bool_and(F.col("end_ms") > F.col("start_ms")).over(Window.partitionBy("video_id"))
    return d.withColumn("__ok", ok).where("__ok").select("video_id", "text_no", "start_ms", "end_ms")


def time_segments(texts: DataFrame, words: DataFrame, durations: DataFrame) -> DataFrame:
    """Narration ranges: the first starts at 0, others 0.08 s before their first word but never before the one before; each
    ends where the next starts. A video with an empty range is left out."""
    w = Window.partitionBy("video_id").orderBy("text_no")
    d = _word_spans(texts, words).join(durations.hint("merge"), "video_id")
    want = F.when(F.row_number().over(w) == 1, 0).otherwise(F.least("duration_ms", F.col("w0") - 80))
    d = d.withColumn("want", want).withColumn("start_ms", F.max("want").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("duration_ms")))
    ok = F.bool_and(F.col("end_ms") > F.col("start_ms")).over(Window.partitionBy("video_id"))
    return d.withColumn("__ok", ok).where("__ok").select("video_id", "text_no", "start_ms", "end_ms")


def match_by_tokens(cues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Best decision of each cue by the share of its tokens, ``(video_id, cue_no, seq, shared, n_tokens)``; ties to the lowest ``seq``.

    Pairs come from a join on shared tokens. A cue that shares none takes its video's first decision.
    """
    c = cues.withColumn("__t", T.tokens("text"))
    left = c.select("video_id", "cue_no", F.explode("__t").alias("token"))
    right = decisions.select("video_id", "seq", F.explode(T.tokens("narration")).alias("token"))
    hits = left.join(right.hint("merge"), ["video_id", "token"]).groupBy("video_id", "cue_no", "seq").agg(F.count("*").alias("shared"))
    best = hits.groupBy("video_id", "cue_no").agg(F.max_by(F.struct("seq", "shared"), F.struct(F.col("shared"), -F.col("seq"))).alias("x"))
    first = decisions.groupBy("video_id").agg(F.min("seq").alias("first"))
    out = c.select("video_id", "cue_no", F.size("__t").alias("n_tokens")).join(best.hint("merge"), ["video_id", "cue_no"], "left").join(first.hint("merge"), "video_id", "left")
    return out.select("video_id", "cue_no", F.coalesce("x.seq", "first").alias("seq"), F.coalesce("x.shared", F.lit(0)).cast("long").alias("shared"), "n_tokens")


def scene_candidates(segments: DataFrame, events: DataFrame, scenes: DataFrame) -> DataFrame:
    """``(video_id, seq, pos, scene_id)``: own scene ids and then the event's, each once, in order, known ones only."""
    s = segments.join(events.select("video_id", "event_no", F.col("scene_ids").alias("__e")).hint("merge"), ["video_id", "event_no"], "left")
    ids = F.array_distinct(F.concat(F.coalesce("scene_ids", F.array().cast("array<bigint>")), F.coalesce("__e", F.array().cast("array<bigint>"))))
    d = s.select("video_id", "seq", F.posexplode(ids).alias("pos", "scene_id"))
    return d.join(scenes.select("video_id", "scene_id").distinct().hint("merge"), ["video_id", "scene_id"], "left_semi").select("video_id", "seq", "pos", "scene_id")


def scene_match_score(c: DataFrame) -> Column:
    """Match of a segment with a scene, over columns of one candidate row.

    ``narration``, ``req_characters``, ``req_actions``, ``req_objects``, ``req_locations``, ``characters``, ``actions``, ``objects``,
    ``location``, ``summary``, ``dialogue``, ``linked``, ``confidence`` and ``n_evidence``.
    """
    text = F.concat_ws(" ", F.array_join("characters", " "), F.array_join("actions", " "), F.array_join("objects", " "), "location", "summary", "dialogue")
    seen = lambda col: F.concat(col, F.array(text))
    score = (
        T.token_overlap("narration", text) * 0.16
        + T.list_overlap("req_characters", seen(F.col("characters")), 0.75) * 0.22
        + T.list_overlap("req_actions", seen(F.col("actions")), 0.72) * 0.18
        + T.list_overlap("req_objects", seen(F.col("objects")), 0.72) * 0.12
        + T.list_overlap("req_locations", seen(F.array("location")), 0.75) * 0.07
        + F.when(F.col("linked"), 0.15).otherwise(0.0)
        + F.col("confidence") * 0.05
        + F.least(F.lit(1.0), F.col("n_evidence") / 3) * 0.05
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def supports(required: Column | str, have: Column | str) -> Column:
    """Everything required is there."""
    return F.size(F.array_except(required, have)) == 0


def event_facts(events: DataFrame, scenes: DataFrame) -> DataFrame:
    """Facts of events from their scenes: range, evidence, verification, distinct characters in order and a joined summary.

    ``events(video_id, event_no, scene_ids)`` and ``scenes(video_id, scene_id, start_ms, end_ms, characters, summary, dialogue,
    n_evidence)``. Events without a known scene are left out. The summary takes the scenes' summaries that are known, else
    their dialogue.
    """
    bridge = events.select("video_id", "event_no", F.explode("scene_ids").alias("scene_id"))
    d = bridge.join(scenes.hint("merge"), ["video_id", "scene_id"])
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "scene_id", "characters", F.trim("summary").alias("s"), F.trim("dialogue").alias("d"))))
    g = d.groupBy("video_id", "event_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_evidence").cast("long").alias("evidence_count"), rows.alias("r"))
    known = F.transform(F.filter("r", lambda x: (x["s"] != "") & (F.upper(x["s"]) != "UNKNOWN")), lambda x: x["s"])
    said = F.transform(F.filter("r", lambda x: x["d"] != ""), lambda x: x["d"])
    g = g.withColumn("summary", F.array_join(F.when(F.size(known) > 0, known).otherwise(said), " | "))
    return g.select("video_id", "event_no", "start_ms", "end_ms", "evidence_count", (F.col("evidence_count") > 0).alias("verified"), F.array_distinct(F.flatten(F.transform("r", lambda x: x["characters"]))).alias("characters"), "summary")


def canonical_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(video_id, name, canonical)`` by equal folded keys; of several aliases the first by priority; else the name itself."""
    a = aliases.select("video_id", T.name_key("alias").alias("__k"), "canonical", "priority")
    a = a.groupBy("video_id", "__k").agg(F.min_by("canonical", F.struct("priority", "canonical")).alias("canonical"))
    return names.withColumn("__k", T.name_key("name")).join(a.hint("merge"), ["video_id", "__k"], "left").select("video_id", "name", F.coalesce("canonical", "name").alias("canonical"))


def fuzzy_match(names: DataFrame, canon: DataFrame, least: float = 0.88, lead: float = 0.06) -> DataFrame:
    """``(video_id, name, canonical, ratio)``: the one canonical name that matches clearly.

    Keys without blanks, of four characters or more. Candidates share a pair of adjacent characters and differ in length by
    no more than the ratio allows; the ratio itself is the matching-block ratio of Python's standard library, in batches.
    A second candidate within ``lead`` makes the match unclear; pairs without a shared pair of characters have a ratio far
    below both bounds.
    """
    key = F.replace(T.name_key("name"), F.lit(" "))
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
    a = names.select("video_id", "name").distinct().withColumn("ka", key).where("length(ka) >= 4")
    b = canon.select("video_id", F.col("name").alias("canonical")).distinct().withColumn("kb", F.replace(T.name_key("canonical"), F.lit(" "))).where("length(kb) >= 4")
    both = a.withColumn("g", F.explode(pairs("ka"))).join(b.withColumn("g", F.explode(pairs("kb"))).hint("merge"), ["video_id", "g"])
    low = least - lead
    both = both.where(2 * F.least(F.length("ka"), F.length("kb")) >= low * (F.length("ka") + F.length("kb"))).select("video_id", "name", "canonical", "ka", "kb").distinct()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    w = Window.partitionBy("video_id", "name").orderBy(F.desc("ratio"), F.desc("canonical"))
    d = both.withColumn("ratio", ratio("ka", "kb")).withColumn("i", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("ratio").over(w), F.lit(0.0)))
    return d.where((F.col("i") == 1) & (F.col("ratio") >= least) & (F.col("ratio") - F.col("second") >= lead)).select("video_id", "name", "canonical", "ratio")


def _counted(values: Column, weight: float) -> Column:
    """Distinct values of an array with ``weight`` for each time they come, found by runs of the sorted array."""
    def runs(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
        return bind(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(v, i).alias("term"), ((F.coalesce(F.get(at, k + 1), F.size(v)) - i) * F.lit(weight)).alias("weight"))))

    return F.when(F.size(values) > 0, bind(F.array_sort(values), runs))


def term_weights(texts: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """``(video_id, item_no, term, weight)``: tokens count 1, adjacent pairs 1.35. One row of ``texts`` an item, so that its terms are counted
    where it is read: no row is shuffled, and a task holds the terms of one text."""
    t = texts.select("video_id", "item_no", T.terms("text", stop).alias("t"))
    pairs = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, 1 << 30), lambda x, y: F.concat_ws("_", x, y))
    none = F.array().cast("array<struct<term: string, weight: double>>")
    both = F.concat(*[F.coalesce(x, none) for x in (_counted(F.col("t"), 1.0), _counted(pairs, 1.35))])
    return t.select("video_id", "item_no", F.inline(both))


def cosine_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(video_id, item_no, r_item_no, cosine)`` of the pairs of one video that share a term."""
    norm = lambda d, n: d.groupBy("video_id", "item_no").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(n))
    x, y = a.join(norm(a, "na").hint("merge"), ["video_id", "item_no"]), b.join(norm(b, "nb").hint("merge"), ["video_id", "item_no"])
    y = y.select("video_id", "term", F.col("item_no").alias("r_item_no"), F.col("weight").alias("wb"), "nb")
    j = x.join(y.hint("merge"), ["video_id", "term"]).groupBy("video_id", "item_no", "r_item_no", "na", "nb").agg(F.sum(F.col("weight") * F.col("wb")).alias("dot"))
    return j.select("video_id", "item_no", "r_item_no", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def mine_names(cues: DataFrame, common: list[str], least: int = 2) -> DataFrame:
    """``(video_id, name, n, n_inside, vocative)``: capitalised words that are likely names.

    Words of two Latin letters or more, also joined by hyphens or apostrophes. A word counts that comes ``least`` times, or once inside a
    sentence, if it is not one of the ``common`` ones (in lower case); and any word that is called, with a comma before or after it, even a
    common one. Sentences begin with the text, a line, or after a closing sign with blanks. The texts between the words are kept
    as they are, so that a word's neighbours say what it is. ``n`` and ``n_inside`` are 0 for common words. A null text has no words.
    """
    marked = F.regexp_replace("text", "(?U)\\b([A-Z][a-zA-Z]{1,24}(?:[-'][A-Z][a-zA-Z]{1,24})*)\\b", "\x01$1\x01")
    d = cues.select("video_id", F.split(marked, "\x01").alias("p"))
    odd = F.when(F.size("p") > 2, F.sequence(F.lit(1), F.size("p") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    d = d.select("video_id", F.explode(F.transform(odd, lambda i: F.struct(F.get("p", i).alias("name"), F.get("p", i - 1).alias("before"), F.get("p", i + 1).alias("after"), (i == 1).alias("first")))).alias("x")).select("video_id", "x.*")
    start = (F.col("first") & F.rlike("before", F.lit("(?U)^\\s*$"))) | F.rlike("before", F.lit("(?U)([.!?…。！？]\\s+|\\n\\s*)$"))
    called = F.rlike("before", F.lit("(?U),\\s*$")) | F.rlike("after", F.lit("(?U)^\\s*,"))
    known = F.lower("name").isin(*common) if common else F.lit(False)
    n = lambda c: F.sum(c.cast("long"))
    g = d.groupBy("video_id", "name").agg(n(~known).alias("n"), n(~known & ~start).alias("n_inside"), F.bool_or(called).alias("vocative"))
    return g.where((F.col("n") >= least) | (F.col("n_inside") >= 1) | F.col("vocative"))


def merge_glossary(entries: DataFrame, most: int = 120) -> DataFrame:
    """``(video_id, source, target)``: the last target of each source; of the sources the newest ``most`` by first entry."""
    g = entries.groupBy("video_id", "source").agg(F.max_by("target", "seq").alias("target"), F.min("seq").alias("first"))
    w = Window.partitionBy("video_id").orderBy(F.desc("first"))
    return g.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= most).select("video_id", "source", "target")


def merge_memory(items: DataFrame, most: int = 80) -> DataFrame:
    """``(video_id, item, first)``: distinct items, the oldest ``most``."""
    g = items.groupBy("video_id", "item").agg(F.min("seq").alias("first"))
    w = Window.partitionBy("video_id").orderBy("first")
    return g.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= most).select("video_id", "item", "first")


def uncovered(required: DataFrame, covered: DataFrame, *keys: str) -> DataFrame:
    return required.select(*keys).distinct().join(covered.select(*keys).distinct().hint("merge"), list(keys), "left_anti")


def allocate_units(items: DataFrame, totals: DataFrame) -> DataFrame:
    """``(video_id, item_no, units)``: whole units by weight, largest remainders first, at least one each.

    ``totals(video_id, total)`` counts as no less than the number of items. Items whose share is under one take one unit; the
    others share the rest, which a second pass repeats for items that this brings under one.
    """
    w = Window.partitionBy("video_id")
    d = items.join(totals.hint("merge"), "video_id").withColumn("total", F.greatest("total", F.count("*").over(w)))
    raw = F.col("total") * F.col("weight") / F.sum("weight").over(w)
    d = d.withColumn("raw", raw).withColumn("units", F.greatest(F.lit(1), F.floor("raw")).cast("long"))
    d = d.withColumn("open", F.col("total") - F.sum("units").over(w))
    up = F.row_number().over(w.orderBy(F.desc(F.col("raw") - F.col("units")), "item_no"))
    d = d.withColumn("units", F.when((F.col("open") > 0) & (up <= F.col("open")), F.col("units") + 1).otherwise(F.col("units")))
    # Too many units were given by the minimum: take them back one by one, where the share is exceeded most.
    over = F.greatest(F.lit(0), -F.col("open"))
    down = d.withColumn("over", over).withColumn("step", F.explode(F.when((F.col("over") > 0) & (F.col("units") > 1), F.sequence(F.lit(0).cast("long"), F.least(F.col("units") - 2, F.col("over") - 1)))))
    rank = F.row_number().over(w.orderBy(F.col("raw") - F.col("units") + F.col("step"), "item_no"))
    back = down.withColumn("rank", rank).where("rank <= over").groupBy("video_id", "item_no").agg(F.count("*").alias("less"))
    return d.join(back.hint("merge"), ["video_id", "item_no"], "left").select("video_id", "item_no", (F.col("units") - F.coalesce("less", F.lit(0))).alias("units"))
