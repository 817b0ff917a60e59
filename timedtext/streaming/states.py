"""Stateful streams by the newer state API, and a table that a stream keeps up to date batch by batch.

Both processors hold bounded state per key: the last update of a job with a timer, or the boxes of a track and the frames that wait
for earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .jobs import _BOXES, _NO_TRACK, OPEN, _rows, _track, _tracked

_JOB = "job_id long, status string, updated_at timestamp"


class _Jobs(StatefulProcessor):
    """The last update of an open job, and a timer at which it has stalled."""

    def __init__(self, wait_ms: int, open_states: tuple[str, ...]):
        self.wait_ms, self.open_states = wait_ms, open_states

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, at long")
        self.timer = handle.getValueState("timer", "at long")

    def _set(self, at: int | None) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.last.get()[i] for i in (1, 0)) if self.last.exists() else None
        new = None
        for f in rows:
            for event, status, at in zip(f["event_id"], f["status"], f["updated_at"]):
                place = (pd.Timestamp(at).value // 1000, event)
                if best is None or place > best:
                    best, new = place, status
        if new is None:
            return
        self.last.update((int(best[1]), int(best[0])))
        self._set(max(best[0] // 1000 + self.wait_ms, timerValues.getCurrentWatermarkInMs() + 1) if new in self.open_states else None)
        yield pd.DataFrame({"job_id": [key[0]], "status": [new], "updated_at": [pd.Timestamp(best[0], unit="us")]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        at = self.last.get()[1]
        yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "updated_at": [pd.Timestamp(at, unit="us")]})

    def close(self) -> None:
        pass


def follow_jobs(updates: DataFrame, timeout: str = "30 minutes", watermark: str = "10 minutes", open_states: tuple[str, ...] = OPEN) -> DataFrame:
    """``(job_id, status, updated_at)``: a row when a job's latest update changes, and ``failed`` when an open job has none for ``timeout``.

    ``updates(job_id, event_id, status, updated_at)``. Latest is by time and then event id, so that repeated and out-of-order rows change nothing; rows
    later than the watermark are dropped before. A closed job keeps its last place, so that an older update can't open it again.
    """
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)
    rows = updates.select("job_id", "event_id", "status", F.col("updated_at").cast("timestamp").alias("updated_at")).withWatermark("updated_at", watermark)
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(wait, open_states), outputStructType=_JOB, outputMode="Update", timeMode="EventTime")


class _Tracks(StatefulProcessor):
    """A track's two boxes, and the frames that came before the one that is next."""

    def __init__(self, persist: int, hold: int, most: int):
        self.persist, self.hold, self.most = persist, hold, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = "frame long, " + ", ".join(f"{p}{c} double" for p in "to" for c in "xywh") + ", seen long, missed long"
        self.now = handle.getValueState("now", kept)
        self.early = handle.getListState("early", "frame long, x double, y double, w double, h double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.now.get()) if self.now.exists() else _NO_TRACK
        waiting = {int(r[0]): None if r[1] is None or pd.isna(r[1]) else tuple(r[1:]) for r in self.early.get()}
        for _, frame, box in sorted((r for f in rows for r in _rows(f)), key=lambda r: (r[1], r[2] is not None, r[2] or ())):
            if frame > now[0]:
                waiting.setdefault(int(frame), box)
        out = []
        while waiting and (now[0] + 1 in waiting or now[0] < 0 or len(waiting) > self.most):
            frame = min(waiting)
            now = _track(now, frame, waiting.pop(frame), self.persist, self.hold)
            out.append((key[0], frame, *now[1:5]))
        self.now.update(now)
        self.early.clear()
        if waiting:
            self.early.put([(frame, *(box or (None,) * 4)) for frame, box in sorted(waiting.items())])
        yield _tracked(out)

    def close(self) -> None:
        pass


def follow_boxes(detections: DataFrame, persist: int = 3, hold: int = 15, most: int = 64) -> DataFrame:
    """`jobs.track_boxes` for a feed whose frames come out of order: a frame waits for the one before it.

    At most ``most`` frames of a video wait; beyond that the earliest goes on, and a frame that comes after a later one has gone is dropped. Where no
    frame is more than ``most`` late and none is missing, the rows are those of the batch. A video's first frame is the earliest of
    its first batch; of repeated frames the first by box counts.
    """
    rows = detections.select("video_id", "frame", "x", "y", "w", "h")
    return rows.groupBy("video_id").transformWithStateInPandas(_Tracks(persist, hold, most), outputStructType=_BOXES, outputMode="Append", timeMode="None")


def upsert(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the last row of each key in the Parquet tables below ``path``, one folder a batch.

    A batch reads the newest folder of an earlier batch and writes its own, so that running it again, after a restart or a lost
    driver, gives the same table; folders before that are no longer needed. The last row is by ``order``, so that repeated and
    late rows change nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        before = newest(batch, path, batch_id)
        rows = batch if before is None else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/{before}"))
        last = F.max_by(F.struct(*columns), F.struct(*order, *columns)).alias("x")
        rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(last).select("x.*").write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return run


def newest(df: DataFrame, path: str, below: int | None = None) -> int | None:
    """The highest complete batch folder of `upsert`, of those below a number."""
    jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(context.hadoopConfiguration())
    if not files.exists(root):
        return None
    done = [int(s.getPath().getName()) for s in files.listStatus(root) if s.getPath().getName().isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((n for n in done if below is None or n < below), default=None)
