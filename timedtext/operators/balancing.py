"""Balance of event counts: every part of the source has an event, large events are split, surplus neighbours are merged.

Splits halve an event's scenes in order of time. A half is never larger than its whole, so that taking the largest event again and again is
taking the first of all possible halves by size: the halves are laid out by one expression per event and ranked by a window,
without a loop. Merges do change their neighbours' costs; they are a fold over the events of one video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folding import bind

_ID = "array<bigint>"


def _limits(scenes: DataFrame, counts: DataFrame) -> DataFrame:
    """Per video: number and span of its scenes, the counts held to them, and what makes an event too large."""
    g = scenes.groupBy("video_id").agg(
        F.count("*").alias("n"),
        F.min_by("start_ms", F.struct("start_ms", "end_ms", "scene_id")).alias("lo"),
        F.max_by("end_ms", F.struct("start_ms", "end_ms", "scene_id")).alias("hi"),
    )
    d = g.join(counts.hint("merge"), "video_id").withColumn("target", F.greatest(F.lit(1), F.least("target", "n")))
    d = d.withColumn("least", F.greatest(F.lit(1), F.least("least", "target"))).withColumn("most", F.greatest("target", "most"))
    d = d.withColumn("span", F.greatest(F.lit(1000), F.col("hi") - F.col("lo")))
    return d.select("video_id", "n", "target", "least", "most", "span", F.greatest(F.lit(2), F.ceil(F.col("n") / F.col("target") * 1.5)).alias("scene_cap"), F.greatest(F.lit(30_000.0), F.col("span") / F.col("target") * 1.75).alias("span_cap"))


def _anchors(scenes: DataFrame, claimed: DataFrame, limits: DataFrame) -> DataFrame:
    """The best scene of each near-equal run of scenes that no event has: most evidence, then confidence, then the first."""
    order = Window.partitionBy("video_id").orderBy("start_ms", "end_ms", "scene_id")
    d = scenes.join(limits.select("video_id", "n", "target").hint("merge"), "video_id").withColumn("i", F.row_number().over(order) - 1)
    # The first n % target runs have one scene more than the others.
    small, more = F.floor(F.col("n") / F.col("target")), F.col("n") % F.col("target")
    large = more * (small + 1)
    d = d.withColumn("run", F.when(F.col("i") < large, F.floor(F.col("i") / (small + 1))).otherwise(more + F.floor((F.col("i") - large) / small)))
    d = d.join(claimed.withColumn("taken", F.lit(1)).hint("merge"), ["video_id", "scene_id"], "left")
    best = F.min_by(F.struct("scene_id", "start_ms"), F.struct((-F.col("n_evidence")).alias("e"), (-F.col("confidence")).alias("c"), "i"))
    return d.groupBy("video_id", "run").agg(F.max("taken").alias("taken"), best.alias("x")).where("taken is null").select("video_id", "x.*")


def _halves(ids: Column, starts: Column, ends: Column) -> Column:
    """All ranges that repeated halving of ``ids`` can give: ``(a, b, depth, lo, hi)``, the whole first."""
    piece = lambda a, b, depth: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), depth.cast("int").alias("depth"))
    whole = F.array(piece(F.lit(0), F.size(ids), F.lit(0)))

    def halve(r: Column) -> Column:
        middle = r["a"] + F.greatest(F.lit(1), F.floor((r["b"] - r["a"]) / 2))
        return F.array(piece(r["a"], middle, r["depth"] + 1), piece(middle, r["b"], r["depth"] + 1))

    def deeper(acc: Column, _: Column) -> Column:
        return bind(F.flatten(F.transform(F.filter(acc["last"], lambda r: r["b"] - r["a"] >= 2), halve)), lambda new: F.struct(F.concat(acc["all"], new).alias("all"), new.alias("last")))

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(ids), F.lit(1)))).cast("int")))
    every = F.aggregate(rounds, F.struct(whole.alias("all"), whole.alias("last")), deeper, lambda acc: acc["all"])
    reach = lambda r: (F.array_min(F.slice(starts, r["a"] + 1, r["b"] - r["a"])), F.array_max(F.slice(ends, r["a"] + 1, r["b"] - r["a"])))
    return F.transform(every, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), r["depth"].alias("depth"), reach(r)[0].alias("lo"), reach(r)[1].alias("hi")))


def _split(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Events after splitting: those too large while there is room, then the ones with most scenes up to the target."""
    every = Window.partitionBy("video_id")
    d = events.join(limits.hint("merge"), "video_id").withColumn("at", F.row_number().over(every.orderBy("start_ms", "rank", "anchor", "event_no"))).withColumn("held", F.count("*").over(every))
    p = d.select("video_id", "at", "held", "target", "most", "scene_cap", "span_cap", F.explode(_halves(F.col("scene_ids"), F.col("starts"), F.col("ends"))).alias("x"))
    p = p.select("*", "x.*").withColumn("size", F.col("b") - F.col("a"))
    ratio = F.greatest(F.col("size") / F.col("scene_cap"), (F.col("hi") - F.col("lo")) / F.col("span_cap"))
    inner = F.col("size") >= 2
    large = inner & (ratio > 1)
    place = ("at", "a", "depth")
    turn = F.row_number().over(every.orderBy(F.desc(F.when(large, ratio)), *place))
    p = p.withColumn("first", large & (turn <= F.col("most") - F.col("held")))
    p = p.withColumn("held", F.col("held") + F.sum(F.col("first").cast("int")).over(every))
    left = inner & ~F.col("first")
    turn = F.row_number().over(every.orderBy(F.desc(F.when(left, F.col("size"))), *place))
    p = p.withColumn("cut", F.col("first") | (left & (turn <= F.col("target") - F.col("held"))))
    # What stays are the ranges that are not cut, in a range that is: their parent is the shortest range that holds them.
    up = Window.partitionBy("video_id", "at").orderBy("depth", "a")
    cut = p.groupBy("video_id", "at").agg(F.collect_list(F.when(F.col("cut"), F.struct("a", "b", "depth"))).alias("cuts"))
    p = p.where("not cut").join(cut.hint("merge"), ["video_id", "at"])
    held = F.exists("cuts", lambda c: (c["a"] <= F.col("a")) & (c["b"] >= F.col("b")) & (c["depth"] == F.col("depth") - 1))
    # The scene ids join what stays: they are not copied to every range.
    p = p.where((F.col("depth") == 0) | held).join(d.select("video_id", "at", "rank", "cause_no", "effect_no", "scene_ids").hint("merge"), ["video_id", "at"])
    ids = F.slice("scene_ids", F.col("a") + 1, F.col("size"))
    whole = F.col("depth") == 0
    keep = lambda c, first: F.when(whole | first, F.col(c))
    return p.select("video_id", "at", "a", "rank", ids.alias("scene_ids"), F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"), keep("cause_no", F.col("a") == 0).alias("cause_no"), keep("effect_no", F.col("b") == F.size("scene_ids")).alias("effect_no"))


def _merge(events: DataFrame, limits: DataFrame) -> DataFrame:
    """The cheapest neighbours merged until the video has no more events than allowed; of equal costs the first."""
    row = F.struct("at", "a", "start_ms", "end_ms", "scene_ids", "cause_no", "effect_no")
    g = events.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(limits.hint("merge"), "video_id")

    def cost(x: Column, y: Column, i: Column) -> Column:
        long_ = F.greatest(x["end_ms"], y["end_ms"]) - F.least(x["start_ms"], y["start_ms"])
        n = F.size(F.array_union(x["scene_ids"], y["scene_ids"]))
        over = (n > F.col("scene_cap")) | (long_ > F.col("span_cap"))
        gap = F.greatest(F.lit(0), y["start_ms"] - x["end_ms"])
        return F.struct(over.alias("over"), (long_ / F.col("span_cap") + n / F.col("scene_cap")).alias("cost"), (gap / F.col("span")).alias("gap"), i.cast("int").alias("i"))

    def join(x: Column, y: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["a"].alias("a"), F.least(x["start_ms"], y["start_ms"]).alias("start_ms"), F.greatest(x["end_ms"], y["end_ms"]).alias("end_ms"), F.array_union(x["scene_ids"], y["scene_ids"]).alias("scene_ids"), x["cause_no"].alias("cause_no"), y["effect_no"].alias("effect_no"))

    def step(acc: Column, _: Column) -> Column:
        costs = F.transform(F.slice(acc, F.lit(1), F.size(acc) - 1), lambda x, i: cost(x, F.get(acc, i + 1), i))
        return bind(F.array_min(costs)["i"], lambda i: F.concat(F.slice(acc, F.lit(1), i), F.array(join(F.get(acc, i), F.get(acc, i + 1))), F.slice(acc, i + 3, F.size(acc))))

    surplus = F.greatest(F.lit(0), F.size("rows") - F.greatest(F.lit(1), F.col("most")))
    turns = F.when(surplus > 0, F.sequence(F.lit(1).cast("long"), surplus.cast("long"))).otherwise(F.array().cast(_ID))
    return g.select("video_id", F.explode(F.aggregate(turns, F.col("rows"), step)).alias("x")).select("video_id", "x.*")


def _spread(scenes: DataFrame, claimed: DataFrame, need: DataFrame) -> DataFrame:
    """Evenly spread scenes with evidence that no event has, as many as a video needs: ``need(video_id, need)``."""
    every = Window.partitionBy("video_id")
    d = scenes.where("n_evidence > 0").join(claimed.hint("merge"), ["video_id", "scene_id"], "left_anti").join(need.where("need > 0").hint("merge"), "video_id")
    d = d.withColumn("i", F.row_number().over(every.orderBy("scene_id")) - 1).withColumn("m", F.count("*").over(every)).withColumn("k", F.least("need", "m"))
    # Position j * (m - 1) / (k - 1), cut to a whole number: this row's, if the nearest j below or above gives it.
    step = F.when(F.col("k") > 1, (F.col("m") - 1) / F.greatest(F.col("k") - 1, F.lit(1))).otherwise(0.0)
    at = lambda j: F.when(j == F.col("k") - 1, F.when(F.col("k") > 1, F.col("m") - 1).otherwise(0)).otherwise(F.floor(j * step))
    near = F.floor(F.col("i") / F.greatest(step, F.lit(1.0)))
    hit = F.exists(F.array(near - 1, near, near + 1, near + 2), lambda j: (j >= 0) & (j < F.col("k")) & (at(j) == F.col("i")))
    return d.where(hit).select("video_id", "scene_id", "start_ms", "end_ms", (F.col("i") + 1).alias("rank"))


def balance_events(events: DataFrame, scenes: DataFrame, counts: DataFrame) -> DataFrame:
    """``(video_id, event_no, scene_ids, start_ms, end_ms, evidence_count, confidence, verified, cause_no, effect_no)`` with a fitting number of events.

    ``events(video_id, event_no, scene_ids)``, ``scenes(video_id, scene_id, start_ms, end_ms, n_evidence, confidence)``, ``counts(video_id, target, least, most)``. The
    scenes fall into ``target`` near-equal runs in order of time; a run of which no event has a scene gets its best scene as
    an event. Events over one and a half times the mean number of scenes or 1.75 times the mean span are halved, the largest first,
    up to ``most``; then those with most scenes up to ``target``. Below ``least``, scenes with evidence that no event has are added evenly.
    Above ``most``, the neighbours that are cheapest together are merged. ``cause_no`` and ``effect_no`` name the given event whose cause and
    consequence the new one keeps, null if none. Facts and summaries follow from ``scene_ids`` by ``event_facts``. Defined
    cases: unknown and repeated scene ids of an event are dropped, and so are events without a known scene; a scene may be in
    several events; videos without scenes or counts have no rows; null counts of evidence or confidence count as 0; ties go by
    place in time, then by id. The events of one video must fit a task, for the merges.
    """
    order = Window.partitionBy("video_id").orderBy("event_no")
    s = scenes.select("video_id", "scene_id", "start_ms", "end_ms", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence")).dropDuplicates(["video_id", "scene_id"])
    limits = _limits(s, counts)
    known = events.select("video_id", "event_no", F.explode(F.array_distinct("scene_ids")).alias("scene_id")).join(s.hint("merge"), ["video_id", "scene_id"])
    packed = F.array_sort(F.collect_list(F.struct("start_ms", "scene_id", "end_ms"))).alias("r")
    columns = [F.col(f"r.{c}").alias(n) for c, n in (("scene_id", "scene_ids"), ("start_ms", "starts"), ("end_ms", "ends"))]
    given = known.groupBy("video_id", "event_no").agg(packed).select("video_id", "event_no", *columns).withColumn("start_ms", F.array_min("starts"))
    given = given.withColumn("rank", F.row_number().over(order)).select("video_id", "event_no", "scene_ids", "starts", "ends", "start_ms", "rank", F.lit(0).alias("anchor"), F.col("event_no").alias("cause_no"), F.col("event_no").alias("effect_no"))
    claimed = known.select("video_id", "scene_id").distinct()
    none = F.lit(None).cast(events.schema["event_no"].dataType)
    one = _anchors(s, claimed, limits).join(s.select("video_id", "scene_id", "end_ms").hint("merge"), ["video_id", "scene_id"])
    one = one.select("video_id", none.alias("event_no"), F.array("scene_id").alias("scene_ids"), F.array("start_ms").alias("starts"), F.array("end_ms").alias("ends"), "start_ms", F.lit(1).alias("rank"), F.lit(1).alias("anchor"), none.alias("cause_no"), none.alias("effect_no"))
    parts = _split(given.unionByName(one), limits)
    have = parts.groupBy("video_id").agg(F.count("*").alias("have"))
    need = limits.join(have.hint("merge"), "video_id", "left").select("video_id", (F.col("least") - F.coalesce("have", F.lit(0))).alias("need"))
    used = parts.select("video_id", F.explode("scene_ids").alias("scene_id")).distinct()
    added = _spread(s, used, need).select("video_id", "rank", F.array("scene_id").alias("scene_ids"), "start_ms", "end_ms", none.alias("cause_no"), none.alias("effect_no"))
    merged = _merge(parts, limits).join(parts.select("video_id", "at", "a", "rank").hint("merge"), ["video_id", "at", "a"])
    every = merged.select("video_id", "at", "a", "rank", "scene_ids", "start_ms", "end_ms", "cause_no", "effect_no").unionByName(added.withColumn("at", F.lit(1 << 30)).withColumn("a", F.lit(0)))
    last = Window.partitionBy("video_id")
    grown = F.max(F.col("at") == 1 << 30).over(last)
    tie = [F.when(grown, F.col("rank")).otherwise(F.lit(0)), F.col("at"), F.col("a"), F.col("scene_ids")[0]]
    every = every.withColumn("event_new", F.row_number().over(last.orderBy("start_ms", "end_ms", *tie)).cast("long"))
    facts = every.select("video_id", "event_new", F.explode("scene_ids").alias("scene_id")).join(s.select("video_id", "scene_id", "start_ms", "n_evidence", "confidence").hint("merge"), ["video_id", "scene_id"])
    facts = facts.groupBy("video_id", "event_new").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "scene_id"))), lambda x: x["scene_id"]).alias("scene_ids"), F.sum("n_evidence").cast("long").alias("evidence_count"), F.min("confidence").alias("confidence"))
    out = every.drop("scene_ids").join(facts.hint("merge"), ["video_id", "event_new"])
    return out.select("video_id", F.col("event_new").alias("event_no"), "scene_ids", "start_ms", "end_ms", "evidence_count", "confidence", (F.col("evidence_count") > 0).alias("verified"), "cause_no", "effect_no")
