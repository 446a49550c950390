"""Live state: restart, expiry of idle streams, ties and late rows."""

import tempfile

import pytest
from pyspark.sql import functions as F

from trustframe.registry.streams import WINDOWED
from trustframe.streaming import live
from trustframe.streaming import score as S
from trustframe.streaming.controller import ControllerParams

PARAMS = ControllerParams(**WINDOWED, log_var=(0.5,))
SCHEMA = "stream_id long, t int, id long, ts timestamp, z array<double>, r_b double, d_clean double, corrupt_start int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, old)


def table(spark, rows):
    """Rows (stream, t, id, minute, value)."""
    full = [(s, t, i, 60 * m, [float(v)], 0.9 if v < 30 else 0.2, float(v), 5) for s, t, i, m, v in rows]
    d = spark.createDataFrame(full, "stream_id long, t int, id long, sec long, z array<double>, r_b double, d_clean double, corrupt_start int")
    return d.withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000)).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def key(df):
    return sorted((r["stream_id"], r["t"], r["mode"], r["alarm"], r["bad_run"], None if r["final"] is None else round(r["final"], 9)) for r in df.collect())


def test_restart_expiry_ties_and_late_rows(spark, rocks):
    folder, out, cp = (tempfile.mkdtemp() for _ in range(3))
    value = lambda s, t: (7 * t + 3 * s) % 50
    first = [(s, t, 10, t, value(s, t)) for s in (1, 2) for t in range(12)]
    ties = [(1, 4, 11, 4, 49), (1, 4, 9, 4, 1)]  # id 9 sorts first and counts, 10 and 11 are late
    far = [(3, t, 1, 200 + t, value(3, t)) for t in range(6)]
    more = [(1, t, 1, 240 + t, value(1, t)) for t in range(12, 20)]  # stream 1 was forgotten, it starts anew
    more += [(3, 2, 7, 206, 5), *[(3, t, 1, 200 + t, value(3, t)) for t in range(6, 9)]]  # stream 3 goes on; step 2 is late

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        S.start_trace(live.score_session(stream, PARAMS, "ts", "id"), out, cp).awaitTermination(180)

    table(spark, first + ties).coalesce(1).write.mode("append").parquet(folder)
    go()
    for part in (far, more):  # restarts from the checkpoint
        table(spark, part).coalesce(1).write.mode("append").parquet(folder)
        go()
    got = spark.read.schema(f"stream_id long, t int, ts timestamp, {S.TRACE}").parquet(out).cache()
    assert got.where("late").groupBy("stream_id", "t").count().orderBy("stream_id").collect()[:] == [(1, 4, 2), (3, 2, 1)]
    once = [r for r in first if (r[0], r[1]) != (1, 4)] + [ties[1]]
    expected = [table(spark, once), table(spark, more[:8]), table(spark, far + more[9:])]
    want = sorted(sum((key(S.score_stream(e, PARAMS)) for e in expected), []))
    assert key(got.where("not late")) == want
    whole = key(S.score_stream(table(spark, [r for r in once if r[0] == 1] + more[:8]), PARAMS))
    assert whole != key(got.where("not late and stream_id = 1"))  # without expiry the state would have gone on
