"""Ranked lexical search: the best documents of each query by integer term scores, hybrid of term- and document-at-a-time.

Documents are cut to the terms that the queries ask for and dealt over shards by a hash. A shard's short posting lists are added up into
summed accumulators first (term at a time). From then on these are one more list with a bound, beside the long lists, and the
lists are walked document by document: those whose bounds together can't reach the worst kept score are only looked into for documents
that others bring up. What is left of the shards' best is ranked for each query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Everything but digits, letters and what lies beyond ASCII separates terms; only A-Z are folded. A byte beyond ASCII is part of a term.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: Lists with no more postings than this are added up before the walk.
SHORT = 128
#: Documents that are looked at together in the first step of a walk; later steps are longer.
STEP = 256


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Postings(NamedTuple):
    """Documents in ascending order, what each adds to the score, and the most that one adds."""

    docs: np.ndarray
    adds: np.ndarray
    bound: int


def accumulate(lists: list[Postings]) -> Postings:
    """Term at a time: the lists added up, as one list."""
    docs, at = np.unique(np.concatenate([x.docs for x in lists]), return_inverse=True)
    adds = np.zeros(len(docs), np.int64)
    np.add.at(adds, at, np.concatenate([x.adds for x in lists]))
    return Postings(docs, adds, int(adds.max()))


def best(lists: list[Postings], n_docs: int, k: int, short: int = SHORT, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents with the highest sums over ``lists``, ties by document, and their sums; sums of 0 don't count."""
    few, walk = [x for x in lists if len(x.docs) <= short], [x for x in lists if len(x.docs) > short]
    least = 1  # a sum below it can't be among the k best
    if few:
        walk.append(accumulate(few))
        if len(walk[-1].docs) >= k:
            least = max(1, int(np.partition(walk[-1].adds, -k)[-k]))
    walk.sort(key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in walk])  # what the lists up to this one can add together
    kept, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = 0
    while lo < n_docs:
        lead = int(np.searchsorted(reach, least))  # the lists before it bring no document up by themselves
        if lead == len(walk):
            break
        hi, step = min(n_docs, lo + step), min(4096, 2 * step)
        total, touched = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
        for x in walk[lead:]:
            a, b = np.searchsorted(x.docs, (lo, hi))
            total[x.docs[a:b] - lo] += x.adds[a:b]
            touched[x.docs[a:b] - lo] = True
        at = np.flatnonzero(touched)
        total = total[at]
        for j in range(lead - 1, -1, -1):
            alive = total + reach[j] >= least
            at, total = at[alive], total[alive]
            if not len(at):
                break
            x = walk[j]
            i = np.minimum(np.searchsorted(x.docs, at + lo), len(x.docs) - 1)
            total += np.where(x.docs[i] == at + lo, x.adds[i], 0)
        good = total >= least
        kept, sums = np.concatenate([kept, at[good] + lo]), np.concatenate([sums, total[good]])
        order = np.lexsort((kept, -sums))[:k]
        kept, sums = kept[order], sums[order]
        if len(kept) == k:
            least = max(least, int(sums[-1]))
        lo = hi
    return kept, sums


def _queries(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(query, item, terms)``: one row of each different row, its terms sorted, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(x.decode() for x in terms(t)) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], ["query", "item", "terms"])

    rows = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    rows = rows.select(F.xxhash64(F.col("item").isNull(), "item", "text").alias("query"), "item", "text")
    schema = rows.select("query", "item").schema.add("terms", T.ArrayType(T.StringType()))
    return rows.mapInArrow(run, schema).where(F.size("terms") > 0)


def _count(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(id, n, term, tf)`` of every document: the number of its terms, and those of ``vocabulary`` with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            n, ends, ids, tf = [], [0], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                found = terms(t)
                some = Counter(found)
                own = [(known[x], c) for x, c in some.items() if x in known]
                n.append(len(found))
                ids += [i for i, _ in own]
                tf += [c for _, c in own]
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], ["id", "n", "term", "tf"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("id").schema.add("n", "long").add("term", T.ArrayType(T.IntegerType())).add("tf", T.ArrayType(T.LongType())))


def inverted(term: np.ndarray, doc: np.ndarray, adds: np.ndarray) -> dict[int, Postings]:
    """Posting lists by term."""
    order = np.lexsort((doc, term))
    term, doc, adds = term[order], doc[order], adds[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, int)
    return {int(term[a]): Postings(doc[a:b], adds[a:b], int(adds[a:b].max())) for a, b in zip(starts, [*starts[1:], len(term)])}


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10, shard: int = 4_000, block: int = 200_000) -> DataFrame:
    """``(item, rank, doc, score)``: the ``k`` highest-scoring documents of each item, ties by ascending id, null ids last.

    ``block``: different terms of the queries that are looked for in one pass over the documents; more queries take more passes, so
    that what is broadcast has a bound. ``shard``: documents whose lists one task holds at a time. Every document takes part,
    and the result is exact. Defined cases: null and empty texts have no terms and count in nothing; documents with equal or null
    ids count and are ranked each; an item that comes twice with the same text is one item, with different texts one for each;
    an item whose terms are in no document has no rows; a text of any length is one document; empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    asked = scratch.table(_queries(items, item_id, item_text), "queries")
    per_query = asked.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    n_terms = per_query.agg(F.count("*")).first()[0]
    parts = max(1, -(-n_terms // block))
    hits = [_block(docs, per_query.where(F.pmod("query", F.lit(parts)) == p), scratch, f"{p}", doc_id, doc_text, k, shard) for p in range(parts)]
    found = hits[0]
    for x in hits[1:]:
        found = found.unionByName(x)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item").hint("merge"), "query").select("item", "rank", "doc", "score")


def _block(docs: DataFrame, asked: DataFrame, scratch: Scratch, name: str, doc_id: str, doc_text: str, k: int, shard: int) -> DataFrame:
    """``(query, doc, score)``: the ``k`` best of each shard for the queries of one pass."""
    rows = asked.orderBy("term", "query").collect()
    vocabulary: dict[str, int] = {}
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        wanted.setdefault(r["query"], []).append((vocabulary.setdefault(r["term"], len(vocabulary)), r["times"]))
    counted = scratch.table(_count(docs, doc_id, doc_text, {t.encode(): i for t, i in vocabulary.items()}), f"counted-{name}")
    total = counted.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # The vocabulary of a pass has a bound, and so have its document frequencies.
    df = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    weight = np.zeros(max(1, len(vocabulary)), np.int64)
    for r in df:
        weight[r["term"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["df"] + 1)))
    shared = scratch.spark.sparkContext.broadcast((wanted, weight))
    shards = max(1, -(-total["docs"] // shard))
    held = counted.where(F.size("term") > 0).withColumn("row", F.monotonically_increasing_id())
    # Exact beyond 64 bits: a long text in a very large corpus.
    part = F.expr(f"75 * cast(n AS decimal(20, 0)) * {total['docs']} div {max(1, total['terms'])}")
    held = held.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "id", (F.lit(25) + part).alias("m"), "term", "tf")
    out_schema = held.select(F.lit(0).cast("long").alias("query"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("score")).schema

    def run(table: pa.Table) -> pa.Table:
        queries, weights = shared.value
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_end")).combine_chunks()
        lists = table["term"].combine_chunks(), table["tf"].combine_chunks()
        sizes = np.diff(lists[0].offsets.to_numpy())
        doc, term, tf = np.repeat(np.arange(len(sizes)), sizes), lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()
        m = table["m"].to_numpy()[doc]
        index = inverted(term, doc, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)))
        out_query, out_doc, out_score = [], [], []
        for query, own in queries.items():
            own = [Postings(x.docs, x.adds * times, x.bound * times) for t, times in own if (x := index.get(t)) and x.bound]
            if own:
                kept, sums = best(own, len(sizes), k)
                out_query.append(np.full(len(kept), query))
                out_doc.append(kept)
                out_score.append(sums)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"query": pa.array(join(out_query), pa.int64()), "doc": table["id"].take(pa.array(join(out_doc), pa.int64())), "score": pa.array(join(out_score), pa.int64())})

    return scratch.table(held.groupBy("shard").applyInArrow(run, out_schema), f"best-{name}")
