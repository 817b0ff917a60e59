"""Queries over rule-driven text operators, scene match scores and clip plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import micro
from ..operators import matching as M
from ..operators import texts as X
from . import views as V

RULES = [("the", "THE"), ("[0-9]+", "#"), ("(an)(d)", "$2$1"), (" +", " ")]
TERMS = ["the", "of the", "die", "la", "and"]


def corrections(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(X.apply_rules("text", RULES)).alias("text_md5"))


def masked_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "text", X.mask_terms("text", TERMS).alias("m"))
    return docs.select("doc_id", F.md5("m").alias("masked_md5"), (X.unmask_terms("m", TERMS) == F.col("text")).alias("restored"))


def pruned_context(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("name"), "n_name", F.lit("blank"), F.lit(" "), F.lit("region"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("string")), F.lit("other"), F.lit("x"))
    n = V.table(spark, d, "nation").select("n_nationkey", X.prune_context(m, ("name", "blank", "region")).alias("m"))
    return n.select("n_nationkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.array_join(F.array_sort(F.map_values("m")), ",").alias("vals"))


def caption_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = V.cues(spark, d)
    cues, said = c.where("cue_no % 2 = 1"), c.where("cue_no % 2 = 0").select("video_id", F.col("cue_no").alias("seq"), F.col("text").alias("narration"), (F.col("start_ms") + 4000).alias("start_ms"), (F.col("end_ms") + 9000).alias("end_ms"))
    out = X.caption_offsets(cues, said, M.match_by_tokens(cues, said))
    return out.select("video_id", "cue_no", "offset_ms", micro("score").alias("score_micro"))


def clip_plan(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("video_id"), F.col("l_orderkey").alias("seq")).agg(F.sum("l_partkey").alias("p"), F.sum("l_linenumber").alias("q"))
    dec = li.select("video_id", "seq", F.when(F.col("q") % 3 == 0, F.col("p") % 4000).alias("explicit_ms"), F.when(F.col("q") % 3 == 1, F.col("p") * 3 % 7000).alias("voice_start_ms"), F.lit(6000).alias("voice_end_ms"), (F.col("p") * 7 % 90000).alias("start_ms"), (F.col("p") * 7 % 90000 + F.col("q") % 5 * 900).alias("end_ms"))
    media = dec.groupBy("video_id").agg((F.count("*") * 2900 + F.col("video_id") % 3 * 40000).alias("target_ms")).withColumn("source_ms", F.lit(60000).cast("long"))
    return X.clip_plan(dec, media)


def scene_match(spark: SparkSession, d: str) -> DataFrame:
    """The first half of a text is the narration, the second half the scene: its quarters are characters, actions, objects and place."""
    docs = V.table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    docs = docs.withColumn("h", F.ceil(F.size("w") / 2).cast("int")).withColumn("q", F.floor((F.size("w") - F.col("h")) / 4).cast("int"))
    at = lambda a, n: F.slice("w", a, n)
    text = lambda a, n: F.array_join(at(a, n), " ")
    none = F.array().cast("array<string>")
    h, q, n = F.col("h"), F.col("q"), F.size("w")
    c = docs.select(
        "doc_id",
        text(F.lit(1), h).alias("narration"),
        F.when(F.col("doc_id") % 6 == 0, F.array(text(h + 1, q))).when(F.col("doc_id") % 2 == 0, F.array(text(F.lit(1), q))).otherwise(none).alias("req_characters"),
        F.when(F.col("doc_id") % 3 == 0, F.array(text(h + 1, n - h))).otherwise(none).alias("req_actions"),
        none.alias("req_objects"),
        F.when(F.col("doc_id") % 5 == 0, F.array(text(F.lit(1), h))).otherwise(none).alias("req_locations"),
        F.array(text(h + 1, q)).alias("characters"),
        at(h + q + 1, q).alias("actions"),
        at(h + q * 2 + 1, q).alias("objects"),
        text(h + q * 3 + 1, n - h - q * 3).alias("location"),
        text(h + 1, q).alias("summary"),
        F.lit("").alias("dialogue"),
        (F.col("doc_id") % 4 == 0).alias("linked"),
        (F.col("doc_id") % 11 / 10).alias("confidence"),
        (F.col("doc_id") % 5).alias("n_evidence"),
    )
    c = c.withColumn("supported", M.supports("req_characters", "characters"))
    return c.select("doc_id", micro(M.scene_match_score(c)).alias("score_micro"), "supported")


def renamed_records(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select((F.col("doc_id") % 7).alias("video_id"), "doc_id", F.struct(F.col("text").alias("said"), F.col("text").alias("source"), F.array("text").alias("lines")).alias("record"))
    names = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(c).alias("canonical")) for a, c in (("the", "Theo"), ("die", "Didi"))])
    aliases = docs.where("video_id > 0").select("video_id").distinct().select("video_id", F.inline(names)).withColumn("priority", F.lit(0))
    out = X.replace_names_nested(docs, aliases)
    return out.select("doc_id", F.md5("record.said").alias("said_md5"), F.md5("record.source").alias("source_md5"), F.md5(F.array_join("record.lines", "|")).alias("lines_md5"))


QUERIES = {f.__name__: f for f in (corrections, masked_terms, pruned_context, caption_offsets, clip_plan, scene_match, renamed_records)}

_TOK = r"list_distinct(regexp_extract_all(strip_accents(lower({})), '[\pL\pN\pM_]{{2,}}', 0))"


def _hit(item: str, cond: str, default: str) -> str:
    a = _TOK.format(item)
    return f"CASE WHEN {cond} THEN CASE WHEN len({a}) > 0 AND len(list_intersect({a}, tt)) / len({a}) >= 0.45::DOUBLE THEN 1 ELSE 0 END ELSE {default}::DOUBLE END"


_W = "[^\\pL\\pN\\pM_]"
_C = f"c AS ({V.CUES_DUCK})"
ORACLE_SQL = {
    "corrections": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, 'the', 'THE'), '[0-9]+', '#', 'g'), '(an)(d)', '\2\1', 'g'), ' +', ' ', 'g')) AS text_md5 FROM documents",
    # No look-around here: words are cut out and replaced one by one; the two-word term is joined first.
    "masked_terms": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN\pM_]+|[^\pL\pN\pM_]+', 0)) AS t, generate_subscripts(regexp_extract_all(text, '[\pL\pN\pM_]+|[^\pL\pN\pM_]+', 0), 1) AS i FROM documents),
p AS (SELECT *, lead(t, 1) OVER o AS t1, lead(t, 2) OVER o AS t2, lag(t, 1) OVER o AS b1, lag(t, 2) OVER o AS b2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, CASE WHEN t = 'of' AND t1 = ' ' AND t2 = 'the' THEN '[[1]]' WHEN b1 = 'of' AND t = ' ' AND t1 = 'the' THEN '' WHEN t = 'the' AND b1 = ' ' AND b2 = 'of' THEN ''
  WHEN t = 'the' THEN '[[0]]' WHEN t = 'die' THEN '[[2]]' WHEN t = 'la' THEN '[[3]]' WHEN t = 'and' THEN '[[4]]' ELSE t END AS t FROM p)
SELECT doc_id, md5(string_agg(t, '' ORDER BY i)) AS masked_md5, TRUE AS restored FROM m GROUP BY 1""",
    "renamed_records": r"""WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN text ELSE array_to_string(list_transform(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_]+', 0), lambda x: CASE x WHEN 'the' THEN 'Theo' WHEN 'die' THEN 'Didi' ELSE x END), '') END AS said FROM documents)
SELECT doc_id, md5(said) AS said_md5, md5(text) AS source_md5, md5(said) AS lines_md5 FROM r""",
    "pruned_context": "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN 'name,region' ELSE 'name' END AS keys, CASE WHEN n_regionkey > 1 THEN n_regionkey || ',' || n_name ELSE n_name END AS vals FROM nation",
    "caption_offsets": f"""WITH {_C}, p AS (SELECT a.video_id, a.cue_no, a.start_ms AS s, a.end_ms AS e, b.cue_no AS seq, b.start_ms + 4000 AS v0, b.end_ms + 9000 AS v1, len(list_intersect({_TOK.format('a.text')}, {_TOK.format('b.text')})) AS k, len({_TOK.format('a.text')}) AS n
  FROM (SELECT * FROM c WHERE cue_no % 2 = 1) a LEFT JOIN (SELECT * FROM c WHERE cue_no % 2 = 0) b USING (video_id)), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, cue_no ORDER BY k DESC, seq) AS i FROM p)
SELECT video_id, cue_no, CASE WHEN v0 IS NULL THEN e - s WHEN e < v0 THEN v0 - e WHEN s > v1 THEN s - v1 ELSE 0 END AS offset_ms,
  cast(floor(coalesce(least(1, greatest(0, least(e, v1) - greatest(s, v0)) / greatest(10, e - s)) * k / greatest(n, 1), 0) * 1000000 + 0.5) AS BIGINT) AS score_micro FROM r WHERE i = 1""",
    "clip_plan": """WITH l AS (SELECT l_suppkey AS video_id, l_orderkey AS seq, sum(l_partkey)::BIGINT AS p, sum(l_linenumber)::BIGINT AS q FROM lineitem GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN q % 3 = 0 THEN p % 4000 END AS x, CASE WHEN q % 3 = 1 THEN p * 3 % 7000 END AS v0, p * 7 % 90000 AS s, p * 7 % 90000 + q % 5 * 900 AS e FROM l),
n AS (SELECT *, greatest(800, coalesce(CASE WHEN x > 0 THEN x END, CASE WHEN v0 < 6000 THEN 6000 - v0 END, CASE WHEN e > s THEN e - s END, 3000)) AS n0, count(*) OVER (PARTITION BY video_id) * 2900 + video_id % 3 * 40000 AS target, max(seq) OVER (PARTITION BY video_id) AS last FROM d),
f AS (SELECT *, target - sum(n0) OVER (PARTITION BY video_id) AS drift FROM n), g AS (SELECT *, CASE WHEN seq = last AND abs(drift) <= greatest(500, floor(target * 3 / 100)) THEN greatest(800, n0 + drift) ELSE n0 END AS m FROM f),
h AS (SELECT *, least(m, 60000) AS o, least(s, 60000) AS a, greatest(least(s, 60000), least(e, 60000)) AS b FROM g), k AS (SELECT *, least(o, greatest(800, b - a)) AS c FROM h)
SELECT video_id, seq, greatest(0, least(floor((a + b - c) / 2), 60000 - c))::BIGINT AS clip_start_ms, c::BIGINT AS clip_ms, o::BIGINT AS output_ms FROM k""",
    "scene_match": f"""WITH w AS (SELECT doc_id, w, len(w) AS n, (len(w) + 1) // 2 AS h, (len(w) - (len(w) + 1) // 2) // 4 AS q FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
c AS (SELECT *, array_to_string(w[1:h], ' ') AS narration, array_to_string(w[h + 1:n], ' ') AS scene, array_to_string(w[h + 1:h + q], ' ') AS who, array_to_string(w[1:q], ' ') AS other FROM w),
z AS (SELECT *, {_TOK.format('narration')} AS nt, {_TOK.format('scene')} AS tt FROM c)
SELECT doc_id, cast(floor(least(1, greatest(0, CASE WHEN len(nt) > 0 AND len(tt) > 0 THEN len(list_intersect(nt, tt)) / len(nt) ELSE 0 END * 0.16::DOUBLE
  + ({_hit("(CASE WHEN doc_id % 6 = 0 THEN who ELSE other END)", "doc_id % 2 = 0", "0.75")}) * 0.22::DOUBLE + ({_hit("scene", "doc_id % 3 = 0", "0.72")}) * 0.18::DOUBLE + 0.72::DOUBLE * 0.12::DOUBLE
  + ({_hit("narration", "doc_id % 5 = 0", "0.75")}) * 0.07::DOUBLE + CASE WHEN doc_id % 4 = 0 THEN 0.15::DOUBLE ELSE 0 END + doc_id % 11 / 10 * 0.05::DOUBLE + least(1, doc_id % 5 / 3) * 0.05::DOUBLE)) * 1000000 + 0.5) AS BIGINT) AS score_micro,
  doc_id % 2 = 1 OR doc_id % 6 = 0 OR who = other AS supported FROM z""",
}
