"""Streams by the newer state API: late, repeated and out-of-order rows, and a restart from the checkpoint, equal the batch."""

import datetime as dt
import random

import pytest

from timedtext.operators import scorecards as K
from timedtext.streaming import jobs as J
from timedtext.streaming import states as S

AT = dt.datetime(2024, 1, 1)
JOB = "job_id long, event_id long, status string, progress long, updated_at timestamp"
BOX = "video_id long, frame long, x double, y double, w double, h double"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def run(out, at, mode="append", **each):
    w = out.writeStream.outputMode(mode).option("checkpointLocation", str(at / "cp")).trigger(availableNow=True)
    q = (w.foreachBatch(each["each"]) if each else w.format("parquet").option("path", str(at / "out"))).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_upsert_equals_batch_after_restart(spark, tmp_path):
    rows = [(i % 7, i, ["queued", "processing", "completed"][i % 3], i % 101, AT + dt.timedelta(minutes=(i * 37) % 50)) for i in range(90)]
    parts = [rows[:30], rows[10:60][::-1], rows[:5] + rows[60:]]
    write = S.upsert(str(tmp_path / "table"), ["job_id"], ["updated_at", "event_id"])
    for part in parts:
        run(feed(spark, tmp_path / "feed", part, JOB), tmp_path, "append", each=write)
    last = S.newest(spark.range(1), str(tmp_path / "table"))
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table/{last}").select("job_id", "status", "progress", "updated_at").collect()))
    assert got == sorted(map(tuple, K.current_jobs(spark.createDataFrame(rows, JOB)).select("job_id", "status", "progress", "updated_at").collect()))
    write(spark.createDataFrame(parts[2], JOB), last)  # the same batch once more
    assert got == sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table/{last}").select("job_id", "status", "progress", "updated_at").collect()))


def test_jobs_stall_once(spark, tmp_path, rocks):
    m = lambda n: AT + dt.timedelta(minutes=n)
    first = [(1, 1, "processing", 0, m(0)), (2, 2, "queued", 0, m(0)), (2, 4, "completed", 0, m(6)), (2, 3, "processing", 0, m(5)), (3, 5, "queued", 0, m(100))]
    second = [(1, 1, "processing", 0, m(95)), (2, 3, "processing", 0, m(96)), (9, 9, "completed", 0, m(101))]
    third = [(1, 0, "queued", 0, m(94)), (9, 10, "completed", 0, m(150)), (3, 5, "queued", 0, m(100))]
    for part in (first, second, third, [(9, 11, "completed", 0, m(200))]):
        out = S.follow_jobs(feed(spark, tmp_path / "feed", part, JOB))
        run(out, tmp_path, "update", each=lambda d, i: d.write.mode("overwrite").parquet(f"{tmp_path}/rows/{i}"))
    got = [(r.job_id, r.status) for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "rows")).collect()]
    assert got.count((1, "failed")) >= 1 and got.count((3, "failed")) == 1 and (9, "failed") not in got
    assert got.count((2, "completed")) == 1 and got.count((3, "queued")) == 1


def test_boxes_out_of_order_equal_batch(spark, tmp_path, rocks):
    rnd, rows = random.Random(5), []
    for v in range(3):
        x = 20.0
        for frame in range(120):
            x = rnd.choice([x, x, x + 1, 70.0 - x / 2])
            rows.append((v, frame, *((x, 5.0, 10.0, 6.0) if rnd.random() < 0.8 else (None,) * 4)))
    want = sorted(map(str, J.track_boxes(spark.createDataFrame(rows, BOX)).collect()))
    start = [r for r in rows if r[1] < 3]
    mixed = sorted(rows[3:], key=lambda r: r[1] + rnd.random() * 30)
    for part in (start + mixed[:100], mixed[80:230], mixed[200:]):
        run(S.follow_boxes(feed(spark, tmp_path / "feed", part, BOX)), tmp_path)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == want
