"""Queries over words, tokens, scenes, events, names and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import micro
from ..operators import matching as M
from . import views as V


def _words(c: DataFrame) -> DataFrame:
    """Words of the cues of a video with equal shares of the cue's time."""
    w = c.select("video_id", "cue_no", "start_ms", "end_ms", F.split("text", " ").alias("p")).withColumn("n", F.size("p"))
    w = w.select("video_id", "cue_no", "start_ms", "end_ms", "n", F.posexplode("p").alias("i", "word"))
    at = lambda k: (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.col("n"))).cast("long")
    return w.select("video_id", (F.col("cue_no") * 10000 + F.col("i")).alias("word_no"), "word", at(F.col("i")).alias("start_ms"), at(F.col("i") + 1).alias("end_ms"))


def _texts(c: DataFrame) -> DataFrame:
    """Chunks of about 60 characters of each cue; every seventh video is spoilt, so that it fails the equality of letters."""
    p = c.select("video_id", "cue_no", F.posexplode(F.regexp_extract_all("text", F.lit("[^,.!?]+[,.!?]*"), F.lit(0))).alias("i", "text"))
    p = p.select("video_id", (F.col("cue_no") * 10000 + F.col("i")).alias("text_no"), "text").where(F.length(T.alignment_key("text")) > 0)
    return p.withColumn("text", F.when(F.col("video_id") % 7 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")))


def _timed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = V.cues(spark, d)
    return _texts(c), _words(c), c.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))


def align_by_chars(spark: SparkSession, d: str) -> DataFrame:
    t, w, _ = _timed(spark, d)
    return M.align_by_chars(t, w)


def time_captions(spark: SparkSession, d: str) -> DataFrame:
    return M.time_captions(*_timed(spark, d))


def time_segments(spark: SparkSession, d: str) -> DataFrame:
    return M.time_segments(*_timed(spark, d))


def match_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    return M.match_by_tokens(c.where("cue_no % 2 = 1"), c.where("cue_no % 2 = 0").select("video_id", F.col("cue_no").alias("seq"), F.col("text").alias("narration")))


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    words = T.terms("text")
    return c.select("video_id", F.col("cue_no").alias("scene_id"), "start_ms", "end_ms", words.alias("characters"), F.when(F.col("cue_no") % 3 == 0, "UNKNOWN").otherwise(F.col("text")).alias("summary"), F.when(F.col("cue_no") % 4 == 0, "").otherwise(F.reverse("text")).alias("dialogue"), (F.col("cue_no") % 3).alias("n_evidence"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Three cues an event; each names one more scene that no table has."""
    c = V.cues(spark, d)
    return c.groupBy("video_id", F.floor(F.col("cue_no") / 3).alias("event_no")).agg(F.concat(F.array(F.lit(-1).cast("long")), F.array_sort(F.collect_list("cue_no"))).alias("scene_ids"))


def event_facts(spark: SparkSession, d: str) -> DataFrame:
    e = M.event_facts(_events(spark, d), _scenes(spark, d))
    return e.select("video_id", "event_no", "start_ms", "end_ms", "evidence_count", "verified", F.array_join("characters", ",").alias("characters"), F.md5("summary").alias("summary_md5"))


def scene_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    seg = c.select("video_id", F.col("cue_no").alias("seq"), F.floor(F.col("cue_no") / 3).alias("event_no"), F.array(F.col("cue_no") + 1, F.col("cue_no")).alias("scene_ids"))
    return M.scene_candidates(seg, _events(spark, d), _scenes(spark, d))


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").select((F.col("p_partkey") % 5).alias("video_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("priority"))
    aliases = p.where("priority % 3 = 0").select("video_id", F.upper("name").alias("alias"), F.concat(F.lit("c"), (F.col("priority") % 40).cast("string")).alias("canonical"), "priority")
    return M.canonical_names(p.select("video_id", "name").distinct(), aliases)


def term_weights(spark: SparkSession, d: str) -> DataFrame:
    t = V.table(spark, d, "documents").select(F.lit(0).alias("video_id"), F.col("doc_id").alias("item_no"), "text")
    return M.term_weights(t).select("item_no", "term", micro("weight").alias("weight_micro"))


def cosine_join(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d).select("video_id", F.col("cue_no").alias("item_no"), "text")
    out = M.cosine_join(M.term_weights(c.where("item_no % 2 = 0")), M.term_weights(c.where("item_no % 2 = 1")))
    return out.select("video_id", "item_no", "r_item_no", F.floor(F.col("cosine") * 1e4 + 0.5).cast("long").alias("cosine_e4"))


def mine_names(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.lit(0).alias("cue_no"), "text")
    return M.mine_names(c, ["the", "and", "die", "la"])


def merge_glossary(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select((F.col("user_id") % 4).alias("video_id"), F.floor("value").cast("long").cast("string").alias("source"), F.col("event_type").alias("target"), F.col("event_id").alias("seq"))
    return M.merge_glossary(e, 40)


def merge_memory(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select((F.col("user_id") % 4).alias("video_id"), F.floor("value").cast("long").cast("string").alias("item"), F.col("event_id").alias("seq"))
    return M.merge_memory(e, 30)


def uncovered(spark: SparkSession, d: str) -> DataFrame:
    return M.uncovered(V.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), V.table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k")), "k")


def allocate_units(spark: SparkSession, d: str) -> DataFrame:
    i = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") % 9).alias("item_no")).agg(F.sum("l_linenumber").alias("weight"))
    t = i.select("video_id").distinct().withColumn("total", (F.col("video_id") % 11 * 6).cast("long"))
    return M.allocate_units(i, t)


QUERIES = {f.__name__: f for f in (align_by_chars, time_captions, time_segments, match_by_tokens, event_facts, scene_candidates, canonical_names, term_weights, cosine_join, mine_names, merge_glossary, merge_memory, uncovered, allocate_units)}

_C = f"c AS ({V.CUES_DUCK})"
_KEY = r"regexp_replace(lower({}), '[^\pL\pN]', '', 'g')"
_T = rf"""k AS (SELECT * FROM c), d AS (SELECT video_id, max(end_ms) AS duration_ms FROM k GROUP BY 1),
x AS (SELECT video_id, cue_no, unnest(regexp_extract_all(text, '[^,.!?]+[,.!?]*', 0)) AS t, generate_subscripts(regexp_extract_all(text, '[^,.!?]+[,.!?]*', 0), 1) - 1 AS i FROM k),
t AS (SELECT video_id, cue_no * 10000 + i AS text_no, t || CASE WHEN video_id % 7 = 3 THEN 'x' ELSE '' END AS text FROM x WHERE length({_KEY.format('t')}) > 0),
y AS (SELECT video_id, cue_no, start_ms, end_ms, len(string_split(text, ' ')) AS n, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM k),
w AS (SELECT video_id, cue_no * 10000 + i AS word_no, word, start_ms + (end_ms - start_ms) * i // n AS start_ms, start_ms + (end_ms - start_ms) * (i + 1) // n AS end_ms FROM y),
tk AS (SELECT *, {_KEY.format('text')} AS key FROM t), wk AS (SELECT *, {_KEY.format('word')} AS key FROM w WHERE end_ms > start_ms),
g AS (SELECT a.video_id FROM (SELECT video_id, string_agg(key, '' ORDER BY text_no) AS s FROM tk GROUP BY 1) a JOIN (SELECT video_id, string_agg(key, '' ORDER BY word_no) AS s FROM wk WHERE key <> '' GROUP BY 1) b ON a.video_id = b.video_id AND a.s = b.s),
tp AS (SELECT *, sum(length(key)) OVER (PARTITION BY video_id ORDER BY text_no ROWS UNBOUNDED PRECEDING) AS hi FROM tk WHERE video_id IN (SELECT video_id FROM g)),
wp AS (SELECT *, sum(length(key)) OVER (PARTITION BY video_id ORDER BY word_no ROWS UNBOUNDED PRECEDING) AS hi FROM wk WHERE key <> '' AND video_id IN (SELECT video_id FROM g)),
a AS (SELECT tp.video_id, text_no, word_no, wp.start_ms, wp.end_ms FROM tp JOIN wp ON tp.video_id = wp.video_id AND wp.hi > tp.hi - length(tp.key) AND wp.hi - length(wp.key) < tp.hi),
s AS (SELECT video_id, text_no, arg_min(start_ms, word_no) AS w0, arg_max(end_ms, word_no) AS w1 FROM a GROUP BY 1, 2)"""
_TOK = r"list_distinct(regexp_extract_all(strip_accents(lower({})), '[\pL\pN\pM_]{{2,}}', 0))"
_TERMS = "list_filter(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+', 0), lambda x: length(x) > 1)"


def _vector(source: str, item: str, name: str) -> str:
    return f"""{name}_t AS (SELECT video_id, {item} AS item_no, unnest({_TERMS}) AS t, generate_subscripts({_TERMS}, 1) AS i FROM {source}),
{name}_p AS (SELECT *, lead(t) OVER (PARTITION BY video_id, item_no ORDER BY i) AS n FROM {name}_t),
{name} AS (SELECT video_id, item_no, term, sum(w) AS weight FROM (SELECT video_id, item_no, t AS term, 1.0::DOUBLE AS w FROM {name}_p UNION ALL SELECT video_id, item_no, t || '_' || n, 1.35::DOUBLE FROM {name}_p WHERE n IS NOT NULL) GROUP BY 1, 2, 3)"""


_SC = f"""sc AS (SELECT video_id, cue_no AS scene_id, start_ms, end_ms, {_TERMS} AS characters, CASE WHEN cue_no % 3 = 0 THEN 'UNKNOWN' ELSE text END AS summary, CASE WHEN cue_no % 4 = 0 THEN '' ELSE reverse(text) END AS dialogue, cue_no % 3 AS n_evidence FROM c)"""
ORACLE_SQL = {
    "align_by_chars": f"WITH {_C}, {_T} SELECT video_id, text_no, word_no FROM a",
    "time_captions": f"""WITH {_C}, {_T}, e AS (SELECT s.*, duration_ms, greatest(0, w0 - 80) AS start_ms, least(duration_ms, w1 + 180) AS e, lead(greatest(0, w0 - 80)) OVER (PARTITION BY s.video_id ORDER BY text_no) AS nxt FROM s JOIN d ON d.video_id = s.video_id),
f AS (SELECT video_id, text_no, start_ms, least(duration_ms, greatest(start_ms + 120, CASE WHEN nxt IS NULL THEN e WHEN nxt > start_ms + 120 THEN least(e, nxt) ELSE greatest(e, nxt) END)) AS end_ms FROM e)
SELECT * FROM f WHERE video_id NOT IN (SELECT video_id FROM f WHERE end_ms <= start_ms)""",
    "time_segments": f"""WITH {_C}, {_T}, e AS (SELECT s.video_id, text_no, duration_ms, CASE WHEN row_number() OVER o = 1 THEN 0 ELSE least(duration_ms, w0 - 80) END AS want FROM s JOIN d ON d.video_id = s.video_id WINDOW o AS (PARTITION BY s.video_id ORDER BY text_no)),
f AS (SELECT *, max(want) OVER (PARTITION BY video_id ORDER BY text_no ROWS UNBOUNDED PRECEDING) AS start_ms FROM e), h AS (SELECT video_id, text_no, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY text_no), duration_ms) AS end_ms FROM f)
SELECT * FROM h WHERE video_id NOT IN (SELECT video_id FROM h WHERE end_ms <= start_ms)""",
    "match_by_tokens": f"""WITH {_C}, p AS (SELECT a.video_id, a.cue_no, b.cue_no AS seq, len(list_intersect({_TOK.format('a.text')}, {_TOK.format('b.text')})) AS shared, len({_TOK.format('a.text')})::INT AS n_tokens FROM (SELECT * FROM c WHERE cue_no % 2 = 1) a LEFT JOIN (SELECT * FROM c WHERE cue_no % 2 = 0) b USING (video_id))
SELECT video_id, cue_no, arg_min(seq, (-shared, seq)) AS seq, max(shared)::BIGINT AS shared, any_value(n_tokens) AS n_tokens FROM p GROUP BY 1, 2""",
    "event_facts": f"""WITH {_C}, {_SC}, b AS (SELECT video_id, cue_no // 3 AS event_no, cue_no AS scene_id FROM c), j AS (SELECT b.event_no, sc.* FROM b JOIN sc USING (video_id, scene_id)),
ch AS (SELECT video_id, event_no, n, min(o) AS o FROM (SELECT video_id, event_no, unnest(characters) AS n, (start_ms, scene_id, generate_subscripts(characters, 1)) AS o FROM j) GROUP BY 1, 2, 3),
cn AS (SELECT video_id, event_no, string_agg(n, ',' ORDER BY o) AS characters FROM ch GROUP BY 1, 2)
SELECT video_id, event_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(n_evidence)::BIGINT AS evidence_count, sum(n_evidence) > 0 AS verified, coalesce(any_value(cn.characters), '') AS characters,
md5(coalesce(string_agg(trim(summary), ' | ' ORDER BY start_ms, scene_id) FILTER (trim(summary) <> '' AND upper(trim(summary)) <> 'UNKNOWN'), string_agg(trim(dialogue), ' | ' ORDER BY start_ms, scene_id) FILTER (trim(dialogue) <> ''), '')) AS summary_md5
FROM j LEFT JOIN cn USING (video_id, event_no) GROUP BY 1, 2""",
    "scene_candidates": f"""WITH {_C}, {_SC}, e AS (SELECT video_id, cue_no // 3 AS event_no, [-1] || list(cue_no ORDER BY cue_no) AS ids FROM c GROUP BY 1, 2),
u AS (SELECT s.video_id, s.cue_no AS seq, unnest([s.cue_no + 1, s.cue_no] || ids) AS scene_id, generate_subscripts([s.cue_no + 1, s.cue_no] || ids, 1) AS o FROM c s JOIN e ON e.video_id = s.video_id AND e.event_no = s.cue_no // 3),
f AS (SELECT video_id, seq, scene_id, min(o) AS o FROM u GROUP BY 1, 2, 3), n AS (SELECT *, (row_number() OVER (PARTITION BY video_id, seq ORDER BY o) - 1)::INT AS pos FROM f)
SELECT video_id, seq, pos, scene_id FROM n WHERE (video_id, scene_id) IN (SELECT (video_id, scene_id) FROM sc)""",
    "canonical_names": r"""WITH p AS (SELECT p_partkey % 5 AS video_id, p_name AS name, p_partkey AS priority, trim(regexp_replace(strip_accents(lower(p_name)), '[^\pL\pN\pM_]+', ' ', 'g')) AS k FROM part),
a AS (SELECT video_id, k, arg_min('c' || (priority % 40)::VARCHAR, priority) AS canonical FROM p WHERE priority % 3 = 0 GROUP BY 1, 2)
SELECT DISTINCT p.video_id, p.name, coalesce(a.canonical, p.name) AS canonical FROM p LEFT JOIN a USING (video_id, k)""",
    "term_weights": f"WITH z AS (SELECT 0 AS video_id, doc_id, text FROM documents), {_vector('z', 'doc_id', 'v')} SELECT item_no, term, cast(floor(weight * 1000000 + 0.5) AS BIGINT) AS weight_micro FROM v",
    "cosine_join": f"""WITH {_C}, e AS (SELECT * FROM c WHERE cue_no % 2 = 0), o AS (SELECT * FROM c WHERE cue_no % 2 = 1), {_vector('e', 'cue_no', 'v')}, {_vector('o', 'cue_no', 'u')},
n AS (SELECT video_id, item_no, sqrt(sum(weight * weight)) AS n FROM (SELECT * FROM v UNION ALL SELECT * FROM u) GROUP BY 1, 2), j AS (SELECT v.video_id, v.item_no, u.item_no AS r_item_no, sum(v.weight * u.weight) AS dot FROM v JOIN u USING (video_id, term) GROUP BY 1, 2, 3)
SELECT j.video_id, j.item_no, r_item_no, cast(floor(dot / (a.n * b.n) * 10000 + 0.5) AS BIGINT) AS cosine_e4 FROM j JOIN n a ON a.video_id = j.video_id AND a.item_no = j.item_no JOIN n b ON b.video_id = j.video_id AND b.item_no = r_item_no""",
    "mine_names": r"""WITH m AS (SELECT doc_id AS video_id, string_split(regexp_replace(regexp_replace(text, '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]|[^\x00-\x7F\PM]', '_', 'g'), '\b([A-Z][a-zA-Z]{1,24}(?:[-''][A-Z][a-zA-Z]{1,24})*)\b', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
w AS (SELECT video_id, unnest(range(2, len(p), 2)) AS i, p FROM m), x AS (SELECT video_id, p[i] AS name, p[i - 1] AS before, p[i + 1] AS after, i = 2 AS first FROM w),
y AS (SELECT video_id, name, lower(name) NOT IN ('the', 'and', 'die', 'la') AS ok, (first AND regexp_matches(before, '^\s*$')) OR regexp_matches(before, '([.!?…。！？]\s+|\n\s*)$') AS start, regexp_matches(before, ',\s*$') OR regexp_matches(after, '^\s*,') AS called FROM x)
SELECT video_id, name, count(*) FILTER (ok) AS n, count(*) FILTER (ok AND NOT start) AS n_inside, bool_or(called) AS vocative FROM y GROUP BY 1, 2 HAVING count(*) FILTER (ok) >= 2 OR count(*) FILTER (ok AND NOT start) >= 1 OR bool_or(called)""",
    "merge_glossary": """WITH g AS (SELECT user_id % 4 AS video_id, cast(floor(value) AS BIGINT)::VARCHAR AS source, arg_max(event_type, event_id) AS target, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT video_id, source, target FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first DESC) AS i FROM g) WHERE i <= 40""",
    "merge_memory": """WITH g AS (SELECT user_id % 4 AS video_id, cast(floor(value) AS BIGINT)::VARCHAR AS item, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT video_id, item, first FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first) AS i FROM g) WHERE i <= 30""",
    "uncovered": "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "allocate_units": """WITH RECURSIVE i AS (SELECT l_suppkey AS video_id, l_orderkey % 9 AS item_no, sum(l_linenumber) AS weight FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, greatest(video_id % 11 * 6, count(*) OVER p) AS total, greatest(video_id % 11 * 6, count(*) OVER p) * weight / sum(weight) OVER p AS raw FROM i WINDOW p AS (PARTITION BY video_id)),
f(step, video_id, item_no, total, raw, units, open) AS (SELECT 0, video_id, item_no, total, raw, greatest(1, floor(raw))::BIGINT, total - sum(greatest(1, floor(raw))) OVER (PARTITION BY video_id) FROM r
UNION ALL SELECT step + 1, video_id, item_no, total, raw, units + CASE WHEN open > 0 AND up = 1 THEN 1 WHEN open < 0 AND units > 1 AND down = 1 THEN -1 ELSE 0 END, open - sign(open) FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY raw - units DESC, item_no) AS up, row_number() OVER (PARTITION BY video_id ORDER BY units = 1, raw - units, item_no) AS down FROM f WHERE open <> 0))
SELECT video_id, item_no, arg_max(units, step)::BIGINT AS units FROM f GROUP BY 1, 2""",
}
