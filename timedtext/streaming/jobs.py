"""Structured Streaming forms of the job operators. Each has a batch twin of the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OPEN = ("queued", "processing")


def current_jobs_stream(updates: DataFrame) -> DataFrame:
    """Latest state of each job of a feed ``(job_id, event_id, status, progress, updated_at)``.

    An update older than the stored one changes nothing, as the maximum is by time and then event. Run in update or complete mode.
    """
    last = F.max(F.struct("updated_at", "event_id", "status", "progress")).alias("x")
    return updates.groupBy("job_id").agg(last, F.count("*").alias("n_updates")).select("job_id", "x.status", "x.progress", "x.updated_at", "n_updates")


def expire_jobs_stream(updates: DataFrame, timeout: str = "30 minutes", watermark: str = "10 minutes", open_states: tuple[str, ...] = OPEN) -> DataFrame:
    """A ``failed`` row for every open job that had no update for ``timeout`` of event time, and its last row otherwise.

    State is one row per open job; a closed job's state is dropped. Rows later than the watermark are ignored.
    """
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "updated_at": [pd.Timestamp(at, unit="us")]})
            return
        best = state.get if state.exists else None
        for f in frames:
            for s, t in zip(f["status"], f["updated_at"]):
                at = int(pd.Timestamp(t).value // 1000)
                if best is None or at >= best[1]:
                    best = (s, at)
        if best[0] in open_states:
            state.update(best)
            state.setTimeoutTimestamp(max(best[1] // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": [key[0]], "status": [best[0]], "updated_at": [pd.Timestamp(best[1], unit="us")]})

    marked = updates.select("job_id", "status", F.col("updated_at").cast("timestamp").alias("updated_at")).withWatermark("updated_at", watermark)
    return marked.groupBy("job_id").applyInPandasWithState(run, "job_id long, status string, updated_at timestamp", "status string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def retain(listing: DataFrame, now: F.Column | str, ttl: str = "24 hours") -> DataFrame:
    """Rows of ``listing(..., modified_at)`` that are not older than ``ttl``; works on batches and streams."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return listing.where(F.col("modified_at") >= now - F.expr(f"interval {ttl}"))


def windowed_activity(updates: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Updates per status and event-time window, late rows beyond the watermark left out."""
    d = updates.withWatermark("updated_at", watermark).groupBy(F.window("updated_at", window).alias("w"), "status").agg(F.count("*").alias("n"), F.max("progress").alias("max_progress"))
    return d.select(F.col("w.start").alias("window_start"), "status", "n", "max_progress")


_BOXES = "video_id long, frame long, x double, y double, w double, h double"
_NO_TRACK = (-1, *(None,) * 8, 0, 0)


def _near(a: tuple, b: tuple) -> bool:
    """Centres within 18 percent of the width, and 4.5 percent of the height or one and a half boxes."""
    across, down = abs(a[0] + a[2] / 2 - b[0] - b[2] / 2), abs(a[1] + a[3] / 2 - b[1] - b[3] / 2)
    return across <= 18 and down <= max(4.5, 1.5 * max(a[3], b[3]))


def _track(state: tuple, frame: int, box: tuple | None, persist: int, hold: int) -> tuple:
    """Next state ``(frame, track x y w h, candidate x y w h, frames of the candidate, misses)``."""
    track, other, seen, missed = state[1:5], state[5:9], state[9], state[10]
    if box is not None and track[0] is not None and not _near(track, box):
        seen = seen + 1 if other[0] is not None and _near(other, box) else 1
        other = box
        if seen < persist:
            box = None
        else:
            other, seen = (None,) * 4, 0
    elif box is not None:
        other, seen = (None,) * 4, 0
    if box is not None:
        return (frame, *box, *other, seen, 0)
    kept = track[0] is not None and missed < hold
    return (frame, *(track if kept else (None,) * 4), *other, seen, missed + 1)


def _rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    for v, frame, *box in zip(*(pdf[c].tolist() for c in ("video_id", "frame", "x", "y", "w", "h"))):
        yield v, frame, None if any(pd.isna(b) for b in box) else tuple(map(float, box))


def _tracked(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["video_id", "frame", "x", "y", "w", "h"]).astype({"video_id": "int64", "frame": "int64", **{c: "float64" for c in "xywh"}})


def track_boxes(detections: DataFrame, persist: int = 3, hold: int = 15) -> DataFrame:
    """Stable boxes per video from detections ``(video_id, frame, x, y, w, h)`` in percent of the picture, null for misses.

    A box far from the tracked one must come ``persist`` frames in a row before it replaces it, and counts as a miss until then; misses keep
    the track for ``hold`` frames and then drop it. The order matters, so that rows are sorted inside their task and go by one at a time;
    what is kept of a video is two boxes. Of repeated frames the first by box counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state = None, _NO_TRACK
        for pdf in batches:
            out = []
            for v, frame, box in _rows(pdf):
                if v != video:
                    video, state = v, _NO_TRACK
                if frame > state[0]:
                    state = _track(state, frame, box, persist, hold)
                    out.append((v, frame, *state[1:5]))
            yield _tracked(out)

    rows = detections.select("video_id", "frame", "x", "y", "w", "h")
    return rows.repartition("video_id").sortWithinPartitions("video_id", "frame", "x", "y", "w", "h").mapInPandas(run, _BOXES)


def track_boxes_stream(detections: DataFrame, persist: int = 3, hold: int = 15) -> DataFrame:
    """`track_boxes` for a feed: a row per new frame, from a state of two boxes per video. Frames not later than the last one are ignored."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else _NO_TRACK
        out = []
        for v, frame, box in sorted((r for f in frames for r in _rows(f)), key=lambda r: (r[1], r[2] is not None, r[2] or ())):
            if frame > now[0]:
                now = _track(now, int(frame), box, persist, hold)
                out.append((v, frame, *now[1:5]))
        state.update(now)
        yield _tracked(out)

    kept = "frame long, " + ", ".join(f"{p}{c} double" for p in "to" for c in "xywh") + ", seen long, missed long"
    return detections.select("video_id", "frame", "x", "y", "w", "h").groupBy("video_id").applyInPandasWithState(run, _BOXES, kept, "append", GroupStateTimeout.NoTimeout)
