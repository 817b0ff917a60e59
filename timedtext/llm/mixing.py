"""Mixing sources to target weights by Poisson replication, with DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson_table(rate: float) -> list[float]:
    """Distribution function of a Poisson variable, up to where it is 1 in double precision."""
    if rate <= 0:
        return [1.0]
    out, k, total = [], 0, 0.0
    while k <= rate + 12 * math.sqrt(rate) + 24:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        k += 1
    return out


def seeded_uniform(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits of an MD5 digest: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Rates above this are drawn as a sum of independent draws, so that no distribution table is longer than some hundred numbers.
MOST_RATE = 256.0


def mix_sources(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, seed: int = 3, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Each row as many times as a Poisson draw says, in a globally shuffled order.

    ``weights`` are the wanted shares of the sources named in it, scaled to 1. The mean number of copies of a document is
    its source's share times ``epochs`` times the documents of all named sources, divided by the source's documents. The draw
    inverts the distribution function at a number hashed from seed and id, so that a rerun or a retried task gives the
    same copies. Adds ``copy`` (from 0), ``rate`` and ``shuffle_key`` and replaces columns of these names; rows are sorted by that
    key over all partitions.
    Defined cases: rows whose source is null or not named are left out; sources without rows get nothing, and their
    share goes to the others in proportion; rows with equal ids get equal draws; a null id hashes as the empty text; an
    empty table gives an empty result. Only one count per named source reaches the driver.
    """
    named = {k: w for k, w in weights.items() if w > 0}
    counts = {r["s"]: r["n"] for r in docs.where(F.col(source_col).isin(list(named))).groupBy(F.col(source_col).alias("s")).agg(F.count("*").alias("n")).collect()}
    total, share = sum(counts.values()), sum(named[s] for s in counts)
    rates = {s: named[s] / share * epochs * total / n for s, n in sorted(counts.items())}
    doc, draw, number = F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__u", "__copies"
    while {draw, number} & set(docs.columns):
        draw, number = f"_{draw}", f"_{number}"
    rate, copies = F.lit(0.0), F.lit(0)
    for s, r in rates.items():
        here = F.col(source_col) == s
        rate = F.when(here, F.lit(r)).otherwise(rate)
        parts = max(1, math.ceil(r / MOST_RATE))
        table = F.array(*[F.lit(p) for p in poisson_table(r / parts)])
        one = F.size(F.filter(table, lambda p: p <= F.col(draw)))
        for_part = lambda j, table=table: F.size(F.filter(table, lambda p: p <= seeded_uniform(F.concat_ws("|", doc, j.cast("string")), seed)))
        more = F.aggregate(F.sequence(F.lit(1), F.lit(parts - 1)), one, lambda n, j: n + for_part(j)) if parts > 1 else one
        copies = F.when(here, more).otherwise(copies)
    drawn = docs.withColumn(draw, seeded_uniform(doc, seed)).withColumn("rate", rate).withColumn(number, copies)
    drawn = drawn.where(F.col(number) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(number) - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}s"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")))
    return drawn.withColumn("shuffle_key", key).drop(draw, number).orderBy("shuffle_key")
