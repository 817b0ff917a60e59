"""Picture regions to cover: repeated detections are merged, and boxes that others cover are left out.

Whether a box stays depends on the boxes that stayed before it, as they are after growing. A video has some dozens of regions; they are folded
inside the JVM, and the state is the list of kept boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folding import bind

_BOX = ("x", "y", "w", "h")


def share(a: Column, b: Column) -> Column:
    """Intersection over the smaller area, which counts as 1 at least; 0 where a side is null."""
    over = lambda p, n: F.greatest(F.lit(0.0), F.least(a[p] + a[n], b[p] + b[n]) - F.greatest(a[p], b[p]))
    whole = (a["x"] + a["y"] + a["w"] + a["h"] + b["x"] + b["y"] + b["w"] + b["h"]).isNotNull()
    return F.when(whole, over("x", "w") * over("y", "h") / F.greatest(F.lit(1.0), F.least(a["w"] * a["h"], b["w"] * b["h"]))).otherwise(0.0)


def _timed(r: Column) -> Column:
    return r["start_ms"].isNotNull() & r["end_ms"].isNotNull()


def _widened(a: Column, b: Column) -> list[Column]:
    """The box around both, in whole percent."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right, low = F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"])
    return [F.bround(v, 0).alias(n) for v, n in ((x, "x"), (y, "y"), (right - x, "w"), (low - y, "h"))]


def _lists(regions: DataFrame) -> DataFrame:
    """Validated regions first, untimed before timed, larger before smaller, then by id, start, end and box: only equal rows are left open."""
    fields = ["region_id", F.coalesce("validated", F.lit(False)).alias("validated"), "start_ms", "end_ms", *[F.col(c).cast("double").alias(c) for c in _BOX]]
    row = F.struct((~F.coalesce("validated", F.lit(False))).alias("k1"), F.col("start_ms").isNotNull().alias("k2"), (-F.col("w") * F.col("h")).cast("double").alias("k3"), *fields)
    names = ("region_id", "validated", "start_ms", "end_ms", *_BOX)
    return regions.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(*[r[c].alias(c) for c in names])).alias("rows"))


def _merged(rows: Column, least: float) -> Column:
    def step(kept: Column, r: Column) -> Column:
        same = F.transform(kept, lambda e: r["start_ms"].isNull() & e["start_ms"].isNull() & (share(r, e) > least))

        def put(at: Column) -> Column:
            grown = F.transform(kept, lambda e, i: F.when((i + 1 == at) & ~e["validated"], F.struct(*[e[c].alias(c) for c in ("region_id", "validated", "start_ms", "end_ms")], *_widened(e, r))).otherwise(e))
            return F.when(at == 0, F.concat(kept, F.array(r))).otherwise(grown)

        return bind(F.array_position(same, True), put)

    return F.aggregate(rows, F.filter(rows, lambda r: F.lit(False)), step)


def merge_regions(regions: DataFrame, least: float = 0.45) -> DataFrame:
    """``(video_id, region_id, validated, start_ms, end_ms, x, y, w, h)`` of the regions that stay, in percent of the picture.

    An untimed region that covers more than ``least`` of a kept untimed one, or the other way round, widens the first such one, unless that
    was validated. Defined cases: a null ``validated`` is false; equally large regions go by id, of one id by start, end and box; a null side overlaps with nothing.
    """
    d = _lists(regions).select("video_id", F.explode(_merged(F.col("rows"), least)).alias("r"))
    return d.select("video_id", "r.*")


def blur_boxes(regions: DataFrame, subtitles: DataFrame, least: float = 0.45, band: float = 0.25, again: float = 0.6) -> DataFrame:
    """Merged regions without those in the subtitle band or on a box that stayed: the columns of `merge_regions`.

    ``subtitles(video_id, x, y, w, h)`` has the band of a video. Untimed boxes that begin in the top 15 per cent reach up to the edge and are 13
    high at most; an untimed box with more than ``band`` of the smaller area in the band goes; so does any box with more than ``again``
    in a box that stayed, if both can be seen at one time: a box without a start and an end always can. Defined cases: a video without a band
    loses no box to it; of several bands the largest counts; see `merge_regions`.
    """
    size = F.col("w") * F.col("h")
    bands = subtitles.groupBy("video_id").agg(F.max_by(F.struct(*[F.col(c).cast("double").alias(c) for c in _BOX]), F.struct(size, *_BOX)).alias("band"))
    d = _lists(regions).join(bands.hint("merge"), "video_id", "left").withColumn("kept", _merged(F.col("rows"), least))

    def step(kept: Column, r: Column) -> Column:
        def put(box: Column) -> Column:
            seen = lambda e: ~_timed(box) | ~_timed(e) | (F.greatest(box["start_ms"], e["start_ms"]) < F.least(box["end_ms"], e["end_ms"]))
            inside = ~_timed(box) & (share(box, F.col("band")) > band)
            gone = inside | F.exists(kept, lambda e: (share(box, e) > again) & seen(e))
            return F.when(gone, kept).otherwise(F.concat(kept, F.array(box)))

        top = F.coalesce((r["y"] <= 15) & ~_timed(r), F.lit(False))
        edge = F.struct(*[r[c].alias(c) for c in ("region_id", "validated", "start_ms", "end_ms", "x")], F.when(top, 0.0).otherwise(r["y"]).alias("y"), r["w"].alias("w"), F.when(top, F.least(r["h"], F.lit(13.0))).otherwise(r["h"]).alias("h"))
        return bind(edge, put)

    d = d.select("video_id", F.explode(F.aggregate("kept", F.filter("kept", lambda r: F.lit(False)), step)).alias("r"))
    return d.select("video_id", "r.*")
