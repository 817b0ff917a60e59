"""Long cues in parts: at clauses, then between words, with neighbours of near length and time by length."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cues import normalize_cues

#: Characters that end a clause.
_CLAUSE = ",;:.!?…-"


def _packed(ends: list[int], first: int, span: Callable[[int, int], int], width: int) -> list[int]:
    """Edges of the fullest runs of at most ``width`` characters from word ``first``, cut at ``ends`` only; a longer piece is a run."""
    edges, at = [first], first
    for e in ends:
        if at > edges[-1] and span(edges[-1], e) > width:
            edges.append(at)
        at = e
    return [*edges, at]


def _by_words(i: int, j: int, span: Callable[[int, int], int], width: int) -> list[tuple[int, int]]:
    """Runs of words ``i..j``; from the last edge backwards, each moves to where its two neighbours differ least in length."""
    edges = _packed(list(range(i + 1, j + 1)), i, span, width)
    for k in range(len(edges) - 2, 0, -1):
        low, high = edges[k - 1], edges[k + 1]
        fits = [c for c in range(edges[k], low, -1) if c == edges[k] or span(c, high) <= width]
        edges[k] = min(fits, key=lambda c: abs(span(low, c) - span(c, high)))
    return list(zip(edges, edges[1:]))


def parts(text: str, ms: int, width: int, most_ms: int) -> list[str]:
    """The parts of a cue's text; one part if it is neither too long nor too slow, none if it is blank."""
    words = text.split()
    before = list(accumulate((len(w) + 1 for w in words), initial=0))

    def span(i: int, j: int) -> int:
        return before[j] - before[i] - 1

    n = len(words)
    if n == 0 or (span(0, n) <= width and ms <= most_ms):
        return [" ".join(words)][: min(n, 1)]
    ends = [k + 1 for k, w in enumerate(words) if w[-1] in _CLAUSE or k == n - 1]
    edges = _packed(ends, 0, span, width)
    runs = [r for i, j in zip(edges, edges[1:]) for r in ([(i, j)] if span(i, j) <= width else _by_words(i, j, span, width))]
    want = max(-(-span(0, n) // width), -(-ms // most_ms))
    while len(runs) < want:
        k = max(range(len(runs)), key=lambda r: span(*runs[r]))
        halves = _by_words(*runs[k], span, max(12, min(width, span(*runs[k]) // 2)))
        if len(halves) < 2:
            break
        runs[k : k + 1] = halves
    return [" ".join(words[i:j]) for i, j in runs]


def split_cues(cues: DataFrame, max_chars: int = 42, max_ms: int = 3200) -> DataFrame:
    """Cues in parts that can be read: ``(video_id, cue_no, source_no, start_ms, end_ms, text)``, numbered from 0 in order of time.

    A cue over ``max_chars`` or ``max_ms`` is cut; each part gets 0.6 s, or an even share of a short cue, and a share of the rest by its
    length. Blanks are squeezed; null and blank texts are left out.
    """

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([parts(t, m, max_chars, max_ms) for t, m in zip(text, ms)])

    # Not pushed into the filter that Spark infers from the explosion, so that it runs once a row.
    cut = cut.asNondeterministic()
    ms = F.greatest(F.lit(10).cast("long"), F.col("end_ms") - F.col("start_ms"))
    d = normalize_cues(cues).where("text is not null").select("video_id", F.col("cue_no").alias("source_no"), "start_ms", "end_ms", ms.alias("ms"), cut("text", ms).alias("parts"))
    least = F.least(F.lit(600.0), F.col("ms") / F.size("parts"))
    d = d.withColumn("least", least).withColumn("rest", F.greatest(F.lit(0.0), F.col("ms") - least * F.size("parts"))).withColumn("total", F.length(F.array_join("parts", "")))
    # One shuffle for all windows below: by themselves, the first of them would deal the rows by its own longer key.
    d = d.select("*", F.posexplode("parts").alias("i", "text")).withColumn("n", F.size("parts")).drop("parts").repartition("video_id")
    w = Window.partitionBy("video_id", "source_no", "start_ms").orderBy("i")
    done = F.sum(F.length("text")).over(w)
    edge = lambda k, chars: F.col("start_ms") + F.floor(F.col("least") * k + F.col("rest") * chars / F.col("total") + 0.5)
    start = F.when(F.col("i") == 0, F.col("start_ms")).otherwise(F.least("end_ms", edge(F.col("i"), done - F.length("text"))))
    end = F.when(F.col("i") == F.col("n") - 1, F.col("end_ms")).otherwise(F.least("end_ms", edge(F.col("i") + 1, done)))
    d = d.select("video_id", "source_no", "i", "text", start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))
    order = Window.partitionBy("video_id").orderBy("start_ms", "source_no", "i")
    d = d.withColumn("cue_no", (F.row_number().over(order) - 1).cast("long"))
    return normalize_cues(d).select("video_id", "cue_no", "source_no", "start_ms", "end_ms", "text")
