"""Choices in order of time: beats to transcript windows, weak clips to better ones, clips of a script after an edit.

Each choice depends on the one before it. Joins and windows first bring a step's options down to those that some earlier choice
could leave as the best; a fold over these short lists then takes them one after the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..functions.times import time_proximity
from .cues import sample_evenly
from .folding import bind, fold

#: Weights of single terms and of adjacent pairs, 1 and 1.35, in whole numbers: products and sums are exact.
_ONE, _PAIR = 20, 27
_FAR = float("inf")
#: Beats of a film that one task holds against its windows, and windows that it scores at once.
_BEATS, _SLAB = 256, 1024


def transcript_windows(cues: DataFrame, most: int = 8, max_ms: int = 42_000, min_ms: int = 5_000, by: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """``(video_id, start_no, end_no, start_ms, end_ms, text)``: runs of up to ``most`` cues with text from each such cue.

    A run takes cues that start within ``max_ms`` of its first and counts from a length of ``min_ms``, or at the video's last cue.
    With more columns ``by``, each of their values has the runs of its own cues, and the columns come too.
    """
    order = Window.partitionBy(*by).orderBy("cue_no")
    row = F.struct(F.col("cue_no").alias("no"), "start_ms", "end_ms", F.col("text").alias("t"))
    d = cues.where(F.trim("text") != "").withColumn("run", F.collect_list(row).over(order.rowsBetween(0, most - 1)))
    d = d.withColumn("last", F.max("cue_no").over(Window.partitionBy(*by))).select(*by, "start_ms", "run", "last", F.posexplode("run").alias("i", "x"))
    own = F.slice("run", F.lit(1), F.col("i") + 1)
    near = F.forall(own, lambda y: y["start_ms"] - F.col("start_ms") <= max_ms)
    d = d.where(near & ((F.col("x.end_ms") - F.col("start_ms") >= min_ms) | (F.col("x.no") == F.col("last"))))
    return d.select(*by, F.col("run")[0]["no"].alias("start_no"), F.col("x.no").alias("end_no"), "start_ms", F.col("x.end_ms").alias("end_ms"), F.array_join(F.transform(own, lambda y: y["t"]), " ").alias("text"))


def _weights(text: str) -> dict:
    """Weights of the terms of ``text``, which stand between blanks, and of their adjacent pairs."""
    t = text.split()
    return {x: _ONE * k for x, k in Counter(t).items()} | {x: _PAIR * k for x, k in Counter(zip(t, t[1:])).items()}


def _promising(least: float, columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs of the beats and windows of a film with the squared lengths ``n2``, ``m2`` and the product ``dot`` of their vectors, but for
    pairs that a later window outdoes or whose score is too low, by more than an error of rounding."""

    def pairs(beats: pa.Table, windows: pa.Table) -> pa.Table:
        number = lambda t, c: t[c].cast(pa.float64()).to_numpy()
        vectors = [_weights(x) for x in beats["terms"].to_pylist()]
        n2 = np.array([sum(w * w for w in v.values()) for v in vectors], np.int64)
        ids: dict = {}
        term = np.array([ids.setdefault(x, len(ids)) for v in vectors for x in v], np.int64)
        order = np.argsort(term, kind="stable")
        beat = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])[order]
        weight = np.array([w for v in vectors for w in v.values()], float)[order]
        first = np.searchsorted(term[order], np.arange(len(ids) + 1))

        dur, duration, i, n = (number(beats, c) for c in ("dur", "duration_ms", "i", "n"))
        sigma, cap = np.maximum(90_000.0, duration * 0.18), dur * np.minimum(1.0, (i + 4) / np.maximum(n, 1)) + 30.0
        places = [(number(beats, c) * 1000.0, share) for c, share in (("preferred", 0.14), ("expected", 0.26))]
        starts, ends, texts = number(windows, "start_ms"), number(windows, "end_ms"), windows["terms"]
        m2, top, found = np.zeros(len(starts), np.int64), np.full(len(vectors), -np.inf), []
        late = np.argsort(-starts, kind="stable")
        for at in range(0, len(late) if len(vectors) else 0, _SLAB):
            slab = late[at : at + _SLAB]
            dot = np.zeros((len(slab), len(vectors)))
            for k, text in enumerate(texts.take(slab).to_pylist()):
                v = _weights(text)
                m2[slab[k]] = sum(w * w for w in v.values())
                known = [(ids[x], w) for x, w in v.items() if x in ids]
                if known:
                    t, w = np.array(known).T
                    size = first[t + 1] - first[t]
                    rows = np.repeat(first[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    dot[k] = np.bincount(beat[rows], weight[rows] * np.repeat(w, size), len(vectors))
            start = starts[slab][:, None]
            cosine = dot / np.maximum(1.0, np.sqrt(n2) * np.sqrt(m2[slab])[:, None])
            score = cosine * 0.56 + np.where((ends - starts)[slab][:, None] < 8_000, 0.75, np.where((ends - starts)[slab][:, None] <= 36_000, 1.0, 0.75)) * 0.04
            for to, share in places:
                score += np.where(duration > 0, np.exp(-(((start - to) / sigma) ** 2)), 0.0) * share
            fits = (dot > 0) & (score >= least - 1e-9) & ((start / 1000.0 <= cap + 1e-9) | (cosine >= 0.55 - 1e-9))
            reached = np.maximum.accumulate(np.vstack([top, np.where(fits, score, -np.inf)]))
            top = reached[-1]
            x, y = np.nonzero(fits & (score >= reached[1:] - 1e-9))
            found.append((slab[x], y, dot[x, y]))
        x, y, dot = (np.concatenate(f) for f in zip(*found)) if found else (np.array([], np.int64), np.array([], np.int64), np.array([]))
        b, w = beats.take(y), windows.take(x)
        more = {"n2": pa.array(n2[y]), "m2": pa.array(m2[x]), "dot": pa.array(dot.astype(np.int64))}
        return pa.table({c: more[c] if c in more else (b if c in b.column_names else w)[c] for c in columns})

    return pairs


def align_beats(beats: DataFrame, cues: DataFrame, durations: DataFrame, stop: list[str] | None = None, least: float = 0.08, gap_s: float = 6.0) -> DataFrame:
    """``(video_id, beat_no, start_ms, end_ms, score, source)``: a transcript window for each beat, in the order of the film.

    ``beats(video_id, beat_no, text, hint_start_ms, hint_end_ms)``, ``cues(video_id, cue_no, start_ms, end_ms, text)``, ``durations(video_id, duration_ms)``. A window
    that shares terms with the beat scores 0.56 of their cosine, 0.14 of the nearness to the hint, 0.26 of the nearness to the beat's even
    place and 0.04 of a fitting length; one far ahead of its place counts from a cosine of 0.55. The best that starts ``gap_s`` after
    the beat before is taken if it scores ``least``; else the hint, else an even place. Only windows that no later one outdoes can ever
    be taken: these, found by one running maximum from the end of the film, are all that the fold holds; most others are left out where the
    products are made. Defined cases: a beat or cue without terms matches nothing; negative hints count as none; beats of a video
    without a duration are left out; of equal scores the first window counts; a video without beats has no rows.
    """
    every = Window.partitionBy("video_id")
    b = beats.join(durations.hint("merge"), "video_id").withColumn("i", F.row_number().over(every.orderBy("beat_no")) - 1).withColumn("n", F.count("*").over(every))
    hint = F.when(F.col("hint_start_ms") >= 0, F.col("hint_start_ms") / 1000.0)
    stop_hint = F.when(F.col("hint_end_ms") >= 0, F.col("hint_end_ms") / 1000.0)
    b = b.withColumn("dur", F.col("duration_ms") / 1000.0).withColumn("hint", hint).withColumn("hint_end", F.when(stop_hint > hint, stop_hint).otherwise(hint + 18.0))
    b = b.withColumn("expected", F.col("dur") * (F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)))).withColumn("preferred", F.coalesce("hint", "expected"))
    # A film's beats are dealt in blocks, and its cues go to each block: texts are shuffled, the pairs of beats and windows are not.
    b = b.withColumn("block", F.floor(F.col("i") / _BEATS))
    tasks, keys = int(beats.sparkSession.conf.get("spark.sql.shuffle.partitions")), ("video_id", "block")
    terms = F.coalesce(F.array_join(T.terms("text", stop), " "), F.lit("")).alias("terms")
    left = b.select(*keys, "beat_no", "dur", "duration_ms", "preferred", "expected", "i", "n", terms).repartition(tasks, *keys)
    dealt = cues.select("video_id", "cue_no", "start_ms", "end_ms", "text").join(b.select(*keys).distinct().hint("merge"), "video_id")
    # Names of its own, as both sides may come from one table.
    dealt = dealt.select(*[F.col(k).alias(k) for k in keys], "cue_no", "start_ms", "end_ms", "text").repartition(tasks, *keys)
    right = transcript_windows(dealt, by=keys).select(*keys, "start_no", "end_no", "start_ms", "end_ms", terms)
    fields = [f for f in left.schema.fields + right.schema.fields[2:] if f.name not in ("block", "terms")] + [StructField(c, LongType()) for c in ("n2", "m2", "dot")]
    c = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_promising(least, [f.name for f in fields]), StructType(fields))
    cosine = F.col("dot") / (F.sqrt("n2") * F.sqrt("m2"))
    length = (F.col("end_ms") - F.col("start_ms")).between(8_000, 36_000)
    close = lambda to: time_proximity(F.col("start_ms"), F.col(to) * 1000.0, F.col("duration_ms"))
    score = cosine * 0.56 + close("preferred") * 0.14 + close("expected") * 0.26 + F.when(length, 1.0).otherwise(0.75) * 0.04
    cap = F.col("dur") * F.least(F.lit(1.0), (F.col("i") + 4) / F.greatest("n", F.lit(1))) + 30.0
    c = c.withColumn("score", score).where((F.col("score") >= least) & ((F.col("start_ms") / 1000.0 <= cap) | (cosine >= 0.55)))
    rank = F.struct("score", -F.col("start_no"), -F.col("end_no"))
    later = Window.partitionBy("video_id", "beat_no").orderBy(F.desc("start_ms"))
    c = c.withColumn("rank", rank).withColumn("top", F.max(rank).over(later)).where("rank = top")
    options = c.groupBy("video_id", "beat_no").agg(F.array_sort(F.collect_list(F.struct((F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "score"))).alias("options"))
    rows = b.join(options.hint("merge"), ["video_id", "beat_no"], "left")

    def step(s: Column, r: Column) -> Column:
        dur, last = r["dur"], s["last"]
        lowest = F.when(last < 0, 0.0).otherwise(F.least(dur, last + gap_s))
        width = F.least(F.lit(24.0), F.greatest(F.lit(8.0), dur / F.greatest(r["n"] * 3, F.lit(1))))
        room = F.greatest(F.lit(0.0), dur - width)
        even = F.least(room, room * r["i"] / F.greatest(r["n"] - 1, F.lit(1)))
        found = F.get(F.filter(r["options"], lambda x: x["start"] >= lowest), F.lit(0))
        pick = lambda start, end, score, source: F.struct(start.alias("start"), end.alias("end"), score.alias("score"), F.lit(source).alias("source"))
        took = F.when(found.isNotNull(), pick(found["start"], found["end"], found["score"], "transcript_match"))
        took = took.when(r["hint"].isNotNull(), pick(r["hint"], r["hint_end"], F.lit(0.0), "ai_hint")).otherwise(pick(even, even + width, F.lit(0.0), "chronological_fallback"))

        def place(x: Column) -> Column:
            close_ = (last >= 0) & (x["start"] <= last + gap_s)
            start = F.when(close_, F.least(F.greatest(F.lit(0.0), dur - 3.0), last + gap_s)).otherwise(x["start"])
            end = F.when(close_, F.greatest(x["end"], start + 3.0)).otherwise(x["end"])
            start = F.greatest(F.lit(0.0), F.least(start, F.greatest(F.lit(0.0), dur - 1.0)))
            end = F.greatest(start + 3.0, F.least(end, dur))
            return F.struct(F.greatest(last, start).alias("last"), start.alias("start"), end.alias("end"), x["score"].alias("score"), x["source"].alias("source"))

        return bind(took, place)

    zero = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit(0.0).alias("score"), F.lit("").alias("source"))
    ms = lambda x: F.floor(x * 1000 + 0.5).cast("long")
    emit = lambda s: F.struct(ms(s["start"]).alias("start_ms"), ms(s["end"]).alias("end_ms"), s["score"].alias("score"), s["source"].alias("source"))
    return fold(rows, ["beat_no"], ["i", "n", "dur", "hint", "hint_end", "options"], zero, step, emit)


_CLIP = ("candidate_id", "start_ms", "score")


def replace_weak(decisions: DataFrame, alternatives: DataFrame, least: float = 0.75, slack_ms: int = 250) -> DataFrame:
    """``(video_id, seq, candidate_id, start_ms, score, replaced)``: clips under ``least`` give way to the best alternative that fits.

    ``decisions(video_id, seq, candidate_id, start_ms, score)`` with nulls where there is no clip; ``alternatives(video_id, seq, pos, candidate_id, start_ms, score,
    supports)``. An alternative must reach ``least``, be another clip, support the narration, start no earlier than the clip before
    as it is after its own replacement, and no later than the next clip as it is now, both with ``slack_ms``. The next clip is
    known beforehand by a window; the clip before is the fold's state. Defined cases: a decision without a clip stays so, and lets
    the one after it start anywhere; of equal scores the first position counts; alternatives of unknown decisions are not looked at.
    """
    ahead = F.first("start_ms", True).over(Window.partitionBy("video_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing))
    d = decisions.select("video_id", "seq", *_CLIP).withColumn("next", F.coalesce(ahead.cast("double"), F.lit(_FAR)))
    a = alternatives.where(F.col("supports") & (F.col("score") >= least)).select("video_id", "seq", F.struct((-F.col("score")).alias("rank"), "pos", *_CLIP).alias("x"))
    fit = (F.col("x.candidate_id") != F.col("candidate_id")) & (F.col("x.start_ms") <= F.col("next") + slack_ms)
    weak = d.where(F.col("start_ms").isNotNull() & (F.col("score") < least))
    a = a.join(weak.select("video_id", "seq", "candidate_id", "next").hint("merge"), ["video_id", "seq"]).where(fit)
    rows = d.join(a.groupBy("video_id", "seq").agg(F.array_sort(F.collect_list("x")).alias("options")).hint("merge"), ["video_id", "seq"], "left")
    clip = lambda x: [x[c].alias(c) for c in _CLIP]

    def step(s: Column, r: Column) -> Column:
        before = F.coalesce(s["start_ms"].cast("double"), F.lit(-_FAR))
        better = F.get(F.filter(r["options"], lambda x: x["start_ms"] + slack_ms >= before), F.lit(0))
        return bind(better, lambda x: F.when(x.isNotNull(), F.struct(*clip(x), F.lit(True).alias("replaced"))).otherwise(F.struct(*clip(r), F.lit(False).alias("replaced"))))

    types = {f.name: f.dataType for f in d.schema.fields}
    zero = F.struct(*[F.lit(None).cast(types[c]).alias(c) for c in _CLIP], F.lit(False).alias("replaced"))
    return fold(rows, ["seq"], [*_CLIP, "options"], zero, step, lambda s: s)


def thin_to_budget(segments: DataFrame, budgets: DataFrame) -> DataFrame:
    """The segments of each video that stay: all, or evenly spread ones if the script has more words than ``max_words``.

    ``segments(video_id, seq, narration)``, ``budgets(video_id, target_words, max_words)``. As many stay as bring the words to the target at the mean length,
    six at least. Videos without a budget keep all.
    """
    every = Window.partitionBy("video_id")
    d = segments.withColumn("__words", F.sum(F.coalesce(T.word_count("narration"), F.lit(0))).over(every)).withColumn("__n", F.count("*").over(every))
    d = d.join(budgets.select("video_id", "target_words", "max_words").hint("merge"), "video_id", "left")
    mean = F.greatest(F.lit(1.0), F.col("__words") / F.col("__n"))
    wanted = F.greatest(F.lit(6), F.least(F.col("__n"), F.bround(F.col("target_words") / mean, 0).cast("long")))
    d = d.withColumn("__wanted", F.when(F.col("__words") > F.col("max_words"), wanted).otherwise(F.col("__n")))
    return sample_evenly(d, F.greatest("__wanted", F.lit(2)), "seq").select(*segments.columns)


def repair_edit(segments: DataFrame, clips: DataFrame, budgets: DataFrame, least: float = 0.75, slack_ms: int = 250) -> DataFrame:
    """``(video_id, seq, new_seq, candidate_id, start_ms, score, replaced)`` of the segments that stay after thinning to the budget.

    ``clips(video_id, seq, pos, candidate_id, start_ms, score)``: position 0 is the selected clip, the others are alternatives. Of a clip that comes twice the
    better score counts. In order, each segment takes its selected clip if that does not go back in source time and reaches
    ``least``; else the best that does not go back, the earlier of equals; if all go back, the selected one stays. Defined cases: a segment without
    clips has nulls and lets the next one be; clips of segments that went are not looked at; equal scores and starts go by position.
    """
    kept = thin_to_budget(segments, budgets)
    kept = kept.select("video_id", "seq", F.row_number().over(Window.partitionBy("video_id").orderBy("seq")).cast("long").alias("new_seq"))
    # The first of the best entries of each clip, at the place where the clip came first.
    best = F.min(F.struct((-F.col("score")).alias("rank"), "pos", "start_ms", "score")).alias("best")
    pool = clips.groupBy("video_id", "seq", "candidate_id").agg(best, F.min("pos").alias("at"))
    selected = (F.col("at") == 0) & (F.col("best.pos") == 0)
    row = F.struct((-F.col("best.score")).alias("rank"), F.col("best.start_ms").alias("start_ms"), F.col("at").alias("pos"), "candidate_id", F.col("best.score").alias("score"), selected.alias("selected"))
    pool = pool.groupBy("video_id", "seq").agg(F.array_sort(F.collect_list(row)).alias("pool"))
    current = clips.where("pos = 0").select("video_id", "seq", F.struct(*_CLIP).alias("current"))
    rows = kept.join(pool.hint("merge"), ["video_id", "seq"], "left").join(current.hint("merge"), ["video_id", "seq"], "left")
    clip = lambda x: [x[c].alias(c) for c in _CLIP]

    def step(s: Column, r: Column) -> Column:
        def choose(ahead: Column) -> Column:
            own = F.get(F.filter(ahead, lambda x: x["selected"] & (x["score"] >= least)), F.lit(0))
            took = F.coalesce(own, F.get(ahead, F.lit(0)))
            return F.when(took.isNotNull(), F.struct(*clip(took))).otherwise(r["current"])

        ahead = F.filter(r["pool"], lambda x: x["start_ms"] + slack_ms >= s["last"])

        def after(x: Column) -> Column:
            changed = x["candidate_id"].isNotNull() & ~x["candidate_id"].eqNullSafe(r["current"]["candidate_id"])
            return F.struct(F.coalesce(x["start_ms"].cast("double"), s["last"]).alias("last"), r["new_seq"].alias("new_seq"), *clip(x), changed.alias("replaced"))

        return bind(choose(ahead), after)

    types = {f.name: f.dataType for f in clips.schema.fields}
    zero = F.struct(F.lit(-_FAR).alias("last"), F.lit(0).cast("long").alias("new_seq"), *[F.lit(None).cast(types[c]).alias(c) for c in _CLIP], F.lit(False).alias("replaced"))
    return fold(rows, ["seq"], ["new_seq", "pool", "current"], zero, step, lambda s: F.struct(s["new_seq"].alias("new_seq"), *clip(s), s["replaced"].alias("replaced")))
