"""Shared pieces of the training-data operators: stage tables in the cluster's shared folder and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import Scratch, shared_root  # noqa: F401


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def with_lowest(rows: DataFrame, group: str, value: str, out: str, spread: str) -> DataFrame:
    """``rows`` with ``out``, the lowest ``value`` of each ``group``; nulls count only where a group has nothing else.

    A group's rows are dealt over 64 salts by a hash of ``spread``, and the minimum of the group is joined to its salts first:
    the join with the rows has no hot key, however large a group is.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(64)).cast("int"))
    part = salted.groupBy(group, "__salt").agg(F.min(value).alias("__low"))
    low = part.groupBy(F.col(group).alias("__group")).agg(F.min("__low").alias(out))
    low = part.select(group, "__salt").join(low.hint("merge"), F.col(group) == F.col("__group")).select(F.col(group).alias("__group"), F.col("__salt").alias("__own"), out)
    return salted.join(low.hint("merge"), (F.col(group) == F.col("__group")) & (F.col("__salt") == F.col("__own"))).drop("__salt", "__group", "__own")


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star joins: ``(node, root)``.

    Every round is two joins on a key and two minimum aggregates, written to the scratch folder; a hub only adds rows to a
    join that Spark can split. Isolated nodes are not in the result. No link and no label goes to the driver but two
    control sums a round.
    """
    edge = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = scratch.table(edge, f"{name}-0")
    seen_of = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    mark = seen_of(e)
    # Links are few next to what they came from: tasks follow their number, not the session's shuffle partitions.
    tasks = 1 + mark[0] // 200_000
    for i in range(1, max_rounds + 1):
        lowest = e.groupBy(F.col("hi").alias("top")).agg(F.min("lo").alias("m"))
        large = e.join(lowest.hint("merge"), F.col("lo") == F.col("top"), "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        large = scratch.table(large.coalesce(tasks), f"{name}-{i}-large")
        lowest = large.groupBy(F.col("hi").alias("top")).agg(F.min("lo").alias("m"))
        small = large.join(lowest.hint("merge"), F.col("hi") == F.col("top")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = small.unionByName(lowest.select(F.col("top").alias("hi"), F.col("m").alias("lo"))).distinct()
        e = scratch.table(small.coalesce(tasks), f"{name}-{i}")
        seen = seen_of(e)
        scratch.drop(f"{name}-{i}-large")
        if i > 1:
            scratch.drop(f"{name}-{i - 1}")
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
