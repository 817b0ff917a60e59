"""Queries over cues: clean-up, slots, segmentation, context and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import micro
from ..operators import cues as C
from . import views as V


def _durations(c: DataFrame) -> DataFrame:
    return c.groupBy("video_id").agg((F.max("end_ms") - 1500).alias("duration_ms"))


def clamp_cues(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    return C.clamp_cues(c, _durations(c)).select("video_id", "cue_no", "start_ms", "end_ms")


def scale_time(spark: SparkSession, d: str) -> DataFrame:
    return C.scale_time(V.cues(spark, d), 1.25).select("video_id", "cue_no", "start_ms", "end_ms")


def normalize_cues(spark: SparkSession, d: str) -> DataFrame:
    return C.normalize_cues(V.cues(spark, d)).select("video_id", "cue_no", "start_ms", "end_ms")


def speech_slots(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    return C.speech_slots(c, _durations(c))


def cue_health(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    h = C.cue_health(c, _durations(c))
    return h.select("video_id", "n_cues", "n_out_of_bounds", "n_overlaps", "n_empty", *[micro(x).alias(f"{x}_micro") for x in ("coverage", "mean_rate", "max_rate", "readability", "bounds_score")])


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each document as cues of 40 ms a character with a pause after each fifth."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?…]+[.!?…]*"), F.lit(0))).alias("cue_no", "text"))
    w = C._w("cue_no")
    start = F.coalesce(F.sum(F.length("text") * 40 + F.when(F.col("cue_no") % 5 == 4, 1000).otherwise(100)).over(w.rowsBetween(-(1 << 31), -1)), F.lit(0))
    return docs.select("video_id", F.col("cue_no").cast("long").alias("cue_no"), "text", start.cast("long").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + F.length("text") * 40)


def drop_repeats(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("cue_no", "text"))
    lines = docs.withColumn("start_ms", F.col("cue_no").cast("long"))
    return C.drop_repeats(lines).select("video_id", "cue_no")


def _digest(g: DataFrame) -> DataFrame:
    return g.select("video_id", "group_no", "start_ms", "end_ms", "n_cues", F.md5("text").alias("text_md5"))


def group_cues(spark: SparkSession, d: str) -> DataFrame:
    return _digest(C.group_cues(_sentences(spark, d)))


def merge_cues(spark: SparkSession, d: str) -> DataFrame:
    return _digest(C.merge_cues(_sentences(spark, d).withColumn("text", F.regexp_replace("text", "[.!?…]$", ""))))


def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).select("video_id", F.col("cue_no").alias("item_no"), F.length("text").alias("n"))
    return C.pack_batches(s, "n", 20, 1600, 60)


def pack_words(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "text")
    return C.pack_words(docs, 42).select("video_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def with_context(spark: SparkSession, d: str) -> DataFrame:
    out = C.with_context(_sentences(spark, d))
    return out.select("video_id", "batch_no", "n_items", F.md5(F.array_join("prev", "|")).alias("prev_md5"), F.md5(F.array_join("nxt", "|")).alias("next_md5"))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    out = C.sliding_windows(V.cues(spark, d))
    return out.select("video_id", "start_no", "end_no", "start_ms", "end_ms", F.md5("text").alias("text_md5"))


def sample_evenly(spark: SparkSession, d: str) -> DataFrame:
    return C.sample_evenly(_sentences(spark, d), 12).select("video_id", "cue_no")


def consolidate(spark: SparkSession, d: str) -> DataFrame:
    return C.consolidate(_sentences(spark, d), 7)


def transcript(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    out = C.transcript(docs)
    return out.select("video_id", F.length("transcript").alias("n_chars"), F.md5("transcript").alias("transcript_md5"))


def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    return s.select("video_id", "cue_no", T.ends_sentence("text").alias("ends"), T.is_incomplete(F.regexp_replace("text", "[.!?…]+$", "")).alias("incomplete"), T.is_speakable("text").alias("speakable"), T.has_cjk("text").alias("cjk"))


def voice_estimate(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    return s.select("video_id", "cue_no", T.word_count("text").alias("n_words"), micro(T.voice_seconds("text")).alias("voice_micro"))


def alignment_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.alignment_key("text")).alias("key_md5"), F.md5(T.fold("text")).alias("fold_md5"))


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each sentence with the one after it."""
    s = _sentences(spark, d).select("video_id", "cue_no", T.tokens("text").alias("own"))
    s = s.withColumn("after", F.lead("own").over(C._w("cue_no"))).where("after is not null")
    return s.select("video_id", "cue_no", micro(T.shared_tokens(F.col("own"), F.col("after"))).alias("overlap_micro"))


_FUNCTIONS = (clamp_cues, scale_time, normalize_cues, speech_slots, cue_health, drop_repeats, group_cues, merge_cues, pack_batches, pack_words, with_context, sliding_windows, sample_evenly, consolidate, transcript, text_predicates, voice_estimate, alignment_keys, token_overlap)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_C = f"c AS ({V.CUES_DUCK}), d AS (SELECT video_id, max(end_ms) - 1500 AS duration_ms FROM c GROUP BY 1)"
_S = r"""x AS (SELECT doc_id AS video_id, unnest(regexp_extract_all(text, '[^.!?…]+[.!?…]*', 0)) AS text, generate_subscripts(regexp_extract_all(text, '[^.!?…]+[.!?…]*', 0), 1) - 1 AS cue_no FROM documents),
s AS (SELECT video_id, cue_no, text, start_ms, start_ms + length(text) * 40 AS end_ms FROM (SELECT *, coalesce(sum(length(text) * 40 + CASE WHEN cue_no % 5 = 4 THEN 1000 ELSE 100 END) OVER (PARTITION BY video_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM x))"""
_L = "l AS (SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS cue_no FROM documents)"
_CONN = "|".join(T.CONNECTIVES)
_WORD = "[\\pL\\pN\\pM_]"
_NORM = """n AS (SELECT * REPLACE (CASE WHEN nxt < end_ms THEN greatest(start_ms + 600, nxt - 40) ELSE end_ms END AS end_ms) FROM (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, cue_no) AS nxt FROM {t}) WHERE end_ms > start_ms)"""
_TOK = r"list_distinct(regexp_extract_all(strip_accents(lower({t})), '[\pL\pN\pM_]{{2,}}', 0))"
ORACLE_SQL = {
    "clamp_cues": f"WITH {_C} SELECT video_id, cue_no, start_ms, least(end_ms, duration_ms) AS end_ms FROM c JOIN d USING (video_id) WHERE start_ms < duration_ms - 100",
    "scale_time": f"WITH {_C} SELECT video_id, cue_no, cast(floor(start_ms / 1.25 + 0.5) AS BIGINT) AS start_ms, cast(floor(end_ms / 1.25 + 0.5) AS BIGINT) AS end_ms FROM c",
    "normalize_cues": f"WITH {_C}, {_NORM.format(t='c')} SELECT video_id, cue_no, start_ms, end_ms FROM n",
    "speech_slots": f"""WITH {_C}, e AS (SELECT c.*, duration_ms, lead(start_ms) OVER w AS nxt FROM c JOIN d USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, cue_no)),
f AS (SELECT *, least(end_ms, coalesce(nxt, duration_ms), duration_ms) AS slot_end FROM e), g AS (SELECT *, slot_end - start_ms AS slot FROM f WHERE slot_end - start_ms >= 30),
h AS (SELECT *, slot - CASE WHEN nxt IS NOT NULL AND slot_end >= nxt THEN least(50, greatest(0, slot - 30)) ELSE 0 END AS available_ms FROM g)
SELECT video_id, cue_no, available_ms, greatest(0, start_ms - coalesce(lag(start_ms + available_ms) OVER (PARTITION BY video_id ORDER BY start_ms, cue_no), 0)) AS gap_ms FROM h""",
    "cue_health": f"""WITH {_C}, e AS (SELECT c.*, duration_ms, lag(end_ms) OVER (PARTITION BY video_id ORDER BY cue_no) AS before, length(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\pL\\pN]', '', 'g')) AS k FROM c JOIN d USING (video_id)),
g AS (SELECT video_id, count(*) AS n_cues, count(*) FILTER (start_ms < -10 OR end_ms <= start_ms OR (duration_ms > 0 AND end_ms > duration_ms + 200)) AS n_out_of_bounds, count(*) FILTER (start_ms < before - 20) AS n_overlaps,
  count(*) FILTER (k = 0) AS n_empty, 100 * sum(greatest(0, end_ms - start_ms)) / greatest(max(duration_ms), 10) AS coverage,
  coalesce(avg(CASE WHEN k > 0 THEN k * 1000 / greatest(end_ms - start_ms, 50) END), 0) AS mean_rate, coalesce(max(CASE WHEN k > 0 THEN k * 1000 / greatest(end_ms - start_ms, 50) END), 0) AS max_rate FROM e GROUP BY 1)
SELECT video_id, n_cues, n_out_of_bounds, n_overlaps, n_empty, cast(floor(coverage * 1000000 + 0.5) AS BIGINT) AS coverage_micro, cast(floor(mean_rate * 1000000 + 0.5) AS BIGINT) AS mean_rate_micro, cast(floor(max_rate * 1000000 + 0.5) AS BIGINT) AS max_rate_micro,
  cast(floor(least(100, greatest(0, 100 - greatest(0, mean_rate - 17) * 4 - greatest(0, max_rate - 25) * 1.5)) * 1000000 + 0.5) AS BIGINT) AS readability_micro,
  cast(floor(least(100, greatest(0, 100 - 100 * (n_out_of_bounds + n_overlaps) / greatest(n_cues, 1))) * 1000000 + 0.5) AS BIGINT) AS bounds_score_micro FROM g""",
    "drop_repeats": f"""WITH RECURSIVE {_L}, t AS (SELECT video_id, cue_no, lower(trim(text)) AS key, row_number() OVER (PARTITION BY video_id ORDER BY cue_no) AS i FROM l WHERE trim(text) <> ''),
f(video_id, i, cue_no, kept, keep) AS (SELECT video_id, i, cue_no, key, TRUE FROM t WHERE i = 1
UNION ALL SELECT t.video_id, t.i, t.cue_no, CASE WHEN same THEN kept ELSE key END, NOT same FROM (SELECT t.*, f.kept, key = kept OR (length(key) > 10 AND (suffix(kept, key) OR starts_with(key, kept))) AS same FROM f JOIN t ON t.video_id = f.video_id AND t.i = f.i + 1) t)
SELECT video_id, cue_no::INT AS cue_no FROM f WHERE keep""",
    "group_cues": f"""WITH RECURSIVE {_S}, {_NORM.format(t='s')}, t AS (SELECT *, length(trim(text)) AS n, right(rtrim(text), 1) IN ('.', '?', '!', '…', '。', '？', '！') AND NOT (ends_with(trim(text), ',') OR regexp_matches(trim(text), '(?i)\\b({_CONN})\\s*$')) AS done,
  row_number() OVER (PARTITION BY video_id ORDER BY start_ms, cue_no) AS i FROM n WHERE trim(text) <> ''),
f(video_id, i, g, closed, chars, first, last, done, start_ms, end_ms, text) AS (SELECT video_id, i, 1, done, n, start_ms, end_ms, done, start_ms, end_ms, text FROM t WHERE i = 1
UNION ALL SELECT video_id, i, g + cut::INT, done AND (closed OR CASE WHEN cut THEN n ELSE merged END >= 45 OR gap > 750), CASE WHEN cut THEN n ELSE merged END, CASE WHEN cut THEN start_ms ELSE first END, end_ms, done, start_ms, end_ms, text FROM (
  SELECT *, closed OR merged > 90 OR end_ms - first > 6000 OR (gap > 750 AND was) AS cut FROM (
    SELECT t.*, f.g, f.closed, f.first, f.done AS was, t.start_ms - f.last AS gap, f.chars + 1 + t.n AS merged FROM f JOIN t ON t.video_id = f.video_id AND t.i = f.i + 1)))
SELECT video_id, g::INT AS group_no, min(start_ms) AS start_ms, arg_max(end_ms, i) AS end_ms, count(*)::INT AS n_cues, md5(string_agg(trim(text), ' ' ORDER BY i)) AS text_md5 FROM f GROUP BY 1, 2""",
    "merge_cues": f"""WITH RECURSIVE {_S}, y AS (SELECT * REPLACE (regexp_replace(text, '[.!?…]$', '') AS text) FROM s), t AS (SELECT *, length(trim(text)) AS n, right(rtrim(text), 1) IN ('.', '?', '!', '…', '。', '？', '！') AS ends, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, cue_no) AS i FROM y),
f(video_id, i, g, chars, first, last, ends, start_ms, text) AS (SELECT video_id, i, 1, n, start_ms, end_ms, ends, start_ms, text FROM t WHERE i = 1
UNION ALL SELECT video_id, i, g + (NOT j)::INT, CASE WHEN j THEN merged ELSE n END, CASE WHEN j THEN first ELSE start_ms END, end_ms, ends, start_ms, text FROM (
  SELECT *, start_ms - last <= 300 AND merged <= 120 AND end_ms - first <= 8000 AND NOT was AS j FROM (
    SELECT t.*, f.g, f.first, f.last, f.ends AS was, f.chars + 1 + t.n AS merged FROM f JOIN t ON t.video_id = f.video_id AND t.i = f.i + 1)))
SELECT video_id, g::INT AS group_no, min(start_ms) AS start_ms, arg_max(last, i) AS end_ms, count(*)::INT AS n_cues, md5(string_agg(trim(text), ' ' ORDER BY i)) AS text_md5 FROM f GROUP BY 1, 2""",
    "pack_batches": f"""WITH RECURSIVE {_S}, t AS (SELECT video_id, cue_no, length(text) + 60 AS cost FROM s), f(video_id, item_no, batch_no, k, used) AS (SELECT video_id, cue_no, 1, 1, cost FROM t WHERE cue_no = 0
UNION ALL SELECT t.video_id, t.cue_no, CASE WHEN k >= 20 OR used + cost > 1600 THEN batch_no + 1 ELSE batch_no END, CASE WHEN k >= 20 OR used + cost > 1600 THEN 1 ELSE k + 1 END, CASE WHEN k >= 20 OR used + cost > 1600 THEN cost ELSE used + cost END
  FROM f JOIN t ON t.video_id = f.video_id AND t.cue_no = f.item_no + 1) SELECT video_id, item_no, batch_no::INT AS batch_no FROM f""",
    "pack_words": r"""WITH RECURSIVE w AS (SELECT doc_id AS video_id, unnest(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+', 0)) AS word, generate_subscripts(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+', 0), 1) AS i FROM documents),
f(video_id, i, chunk_no, used, word) AS (SELECT video_id, i, 1, length(word), word FROM w WHERE i = 1
UNION ALL SELECT w.video_id, w.i, CASE WHEN used + 1 + length(w.word) > 42 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN used + 1 + length(w.word) > 42 THEN length(w.word) ELSE used + 1 + length(w.word) END, w.word FROM f JOIN w ON w.video_id = f.video_id AND w.i = f.i + 1)
SELECT video_id, chunk_no::INT AS chunk_no, length(string_agg(word, ' ' ORDER BY i))::INT AS n_chars, md5(string_agg(word, ' ' ORDER BY i)) AS chunk_md5 FROM f GROUP BY 1, 2""",
    "with_context": f"""WITH {_S}, b AS (SELECT video_id, cast(floor(cue_no / 20) AS BIGINT) AS batch_no, count(*) AS n_items, min(cue_no) AS lo, max(cue_no) AS hi FROM s GROUP BY 1, 2)
SELECT b.video_id, b.batch_no, b.n_items, md5(coalesce((SELECT string_agg(text, '|' ORDER BY cue_no) FROM s WHERE s.video_id = b.video_id AND cue_no BETWEEN lo - 8 AND lo - 1), '')) AS prev_md5,
  md5(coalesce((SELECT string_agg(text, '|' ORDER BY cue_no) FROM s WHERE s.video_id = b.video_id AND cue_no BETWEEN hi + 1 AND hi + 4), '')) AS next_md5 FROM b""",
    "sliding_windows": f"""WITH {_C}, p AS (SELECT a.video_id, a.cue_no AS start_no, b.cue_no AS end_no, a.start_ms, b.end_ms, (SELECT max(cue_no) FROM c z WHERE z.video_id = a.video_id) AS last_no,
  (SELECT max(z.end_ms) FROM c z WHERE z.video_id = a.video_id AND z.cue_no BETWEEN a.cue_no AND b.cue_no) AS far, (SELECT string_agg(z.text, ' ' ORDER BY z.cue_no) FROM c z WHERE z.video_id = a.video_id AND z.cue_no BETWEEN a.cue_no AND b.cue_no) AS text
  FROM c a JOIN c b ON a.video_id = b.video_id AND b.cue_no BETWEEN a.cue_no AND a.cue_no + 7)
SELECT video_id, start_no, end_no, start_ms, end_ms, md5(text) AS text_md5 FROM p WHERE far - start_ms <= 42000 AND (end_ms - start_ms >= 5000 OR end_no = last_no)""",
    "sample_evenly": f"""WITH {_S}, k AS (SELECT video_id, count(*) AS k FROM s GROUP BY 1), p AS (SELECT DISTINCT video_id, cast(round_even(i * (k - 1) / 11.0, 0) AS BIGINT) AS cue_no FROM k, range(12) r(i) WHERE k > 12)
SELECT video_id, cue_no FROM s WHERE (video_id, cue_no) IN (SELECT (video_id, cue_no) FROM p) OR video_id IN (SELECT video_id FROM k WHERE k <= 12)""",
    "consolidate": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS k FROM s)
SELECT video_id, cast(floor((i + 0.5) * least(k, 7) / k) AS BIGINT) AS group_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY 1, 2""",
    "transcript": rf"""WITH {_L}, t AS (SELECT video_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY cue_no), '\s+', ' ', 'g')) AS transcript FROM l WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '^[0-9]+$') AND NOT contains(text, '-->') GROUP BY 1)
SELECT video_id, length(transcript)::INT AS n_chars, md5(transcript) AS transcript_md5 FROM t""",
    "text_predicates": rf"""WITH {_S} SELECT video_id, cue_no, right(rtrim(text), 1) IN ('.', '?', '!', '…', '。', '？', '！') AS ends,
  ends_with(trim(regexp_replace(text, '[.!?…]+$', '')), ',') OR regexp_matches(trim(regexp_replace(text, '[.!?…]+$', '')), '(?i)(^|[^\pL\pN\pM_])({_CONN})\s*$') AS incomplete, regexp_matches(text, '[\pL\pN]') AS speakable, regexp_matches(text, '[一-鿿]') AS cjk FROM s""",
    "voice_estimate": rf"""WITH {_S}, n AS (SELECT video_id, cue_no, len(regexp_extract_all(text, '{_WORD}+', 0))::INT AS n_words FROM s)
SELECT video_id, cue_no, n_words, cast(floor(round_even(least(7.0::DOUBLE, greatest(2.0::DOUBLE, n_words / 2.75::DOUBLE + 0.35::DOUBLE)), 3) * 1000000 + 0.5) AS BIGINT) AS voice_micro FROM n""",
    "alignment_keys": r"SELECT doc_id, md5(regexp_replace(replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's'), '[^\pL\pN]', '', 'g')) AS key_md5, md5(strip_accents(lower(text))) AS fold_md5 FROM documents",
    "token_overlap": rf"""WITH {_S}, p AS (SELECT video_id, cue_no, {_TOK.format(t='text')} AS a, {_TOK.format(t='after')} AS b FROM (SELECT *, lead(text) OVER (PARTITION BY video_id ORDER BY cue_no) AS after FROM s) WHERE after IS NOT NULL)
SELECT video_id, cue_no, cast(floor(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END * 1000000 + 0.5) AS BIGINT) AS overlap_micro FROM p""",
}
