"""The registered queries of the training-data operators and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, language_id, mixing, packing, quality_classifier, quality_rules, secret_scan, simhash
from .common import crc32_mod
from .embedding_dedup import near_vectors
from .exact_dedup import dedup_texts
from .hard_negatives import hard_negatives
from .lexical_search import search
from .line_dedup import dedup_lines

#: Wanted shares of the sources; the last ones are to be seen more often than they come.
SOURCE_WEIGHTS = {f"src{i}": (1.0 if i < 10 else 1.5) for i in range(20)}
MIX_SEED = 3


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    weights = quality_classifier.fit(docs, labels.where(crc32_mod(F.col("doc_id"), 5) != 0))
    out = quality_classifier.score(docs, weights, ["doc_id"])
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_read(spark, sf_dir, "documents"), SOURCE_WEIGHTS, seed=MIX_SEED)
    return out.select("doc_id", "source", "copy", "shuffle_key", F.md5("text").alias("text_md5"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = quality_rules.apply_rules(docs, labels.where("quality = 1").select("doc_id"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = chat_format.format_conversations(turns.unionByName(extra))
    out = out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_read(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 3) == 1
    names, weights = language_id.fit(docs.where(~held_out), "doc_id", "text", "lang")
    out = language_id.predict(docs, names, weights, ["doc_id"])
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.find_secrets(_read(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(_read(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_texts(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_read(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_simhash_dedup, op3_source_mixing, op4_quality_rules, op5_chat_format, op6_line_dedup, op7_best_fit_packing, op8_language_id, op9_secret_scan, op10_embedding_dedup, op11_exact_dedup, op12_hard_negatives, op13_lexical_search)}

_WEIGHTS = ", ".join(f"('{s}', {w}::DOUBLE)" for s, w in SOURCE_WEIGHTS.items())

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": f"""
WITH RECURSIVE w(source, weight) AS (VALUES {_WEIGHTS}),
n AS (SELECT source, count(*)::DOUBLE AS n FROM documents WHERE source IN (SELECT source FROM w) GROUP BY source),
r AS (SELECT source, weight / (SELECT sum(weight) FROM w JOIN n USING (source)) * (SELECT sum(n) FROM n) / n AS rate FROM w JOIN n USING (source)),
term(source, k, p, total) AS (
  SELECT source, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT t.source, t.k + 1, t.p * r.rate / (t.k + 1), t.total + t.p * r.rate / (t.k + 1) FROM term t JOIN r USING (source) WHERE t.k < r.rate + 60
),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents JOIN r USING (source)),
c AS (SELECT u.doc_id, u.source, u.text, t.k AS copy FROM u JOIN term t ON t.source = u.source AND t.total <= u.u)
SELECT doc_id, source, copy, md5('{MIX_SEED}s|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS shuffle_key, md5(text) AS text_md5 FROM c
""",
    "op5_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), seen AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k,
    length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) AS role_chars, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS text_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(text_chars + CASE WHEN k > 1 AND before = role THEN 8 ELSE 16 + role_chars + CASE WHEN k > 1 THEN 7 ELSE 0 END END) + 7)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id
""",
    "op11_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
    "op13_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) CROSS JOIN c GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10
""",
}
