"""Folds over the sorted rows of a video, inside the JVM, whose steps depend on what the steps before chose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def none_of(example: Column) -> Column:
    """An empty array of the type of ``example``."""
    return F.filter(F.array(example), lambda x: F.lit(False))


def fold(rows: DataFrame, order: list[str], payload: list[str], zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column], Column]) -> DataFrame:
    """``video_id``, the columns ``order`` and the fields of ``emit(state)`` after each row.

    ``step(state, row)`` returns the next state, a struct of the type of ``zero``. One video's ``order`` and ``payload`` columns must fit a
    task. What is emitted goes to a short block and blocks go to the result, so that a growing array is not copied for each row.
    """
    sorted_ = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*order, *payload))).alias("__rows"))
    none = none_of(emit(zero))

    def go(acc: Column, row: Column) -> Column:
        def put(state: Column) -> Column:
            block = F.concat(acc["block"], F.array(emit(state)))
            full = F.size(acc["block"]) >= _BLOCK - 1
            return F.struct(state.alias("state"), F.when(full, none).otherwise(block).alias("block"), F.when(full, F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"))

        return bind(step(acc["state"], row), put)

    start = F.struct(zero.alias("state"), none.alias("block"), none_of(none).alias("out"))
    folded = sorted_.withColumn("__e", F.aggregate("__rows", start, go, lambda acc: F.concat(F.flatten(acc["out"]), acc["block"])))
    return folded.select("video_id", F.explode(F.arrays_zip("__rows", "__e")).alias("__x")).select("video_id", *[F.col(f"__x.__rows.{c}").alias(c) for c in order], "__x.__e.*")
