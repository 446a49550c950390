"""Streaming equals batch; late rows, model swaps and resets."""

import tempfile

import pytest
from pyspark.sql import functions as F

from trustframe.registry import fixtures as fx
from trustframe.registry.streams import WINDOWED, _reference
from trustframe.streaming import score as S
from trustframe.streaming.controller import ControllerParams

PARAMS = ControllerParams(**WINDOWED, log_var=(0.5,))
COLS = ["stream_id", "t", "mode", "alarm", "bad_run", "final"]


@pytest.fixture(scope="module")
def rows(spark, sf):
    r, _ = _reference(spark, sf)
    return r.where("stream_id < 6").select("stream_id", "t", "ts", "z", "r_b", "d_clean", "corrupt_start").cache()


def run(spark, source, query):
    out, cp = tempfile.mkdtemp(), tempfile.mkdtemp()
    stream = spark.readStream.schema(source[1]).option("maxFilesPerTrigger", 1).parquet(source[0])
    S.start_trace(query(stream), out, cp).awaitTermination(120)
    return spark.read.parquet(out)


def key(df):
    return sorted((r["stream_id"], r["t"], r["mode"], r["alarm"], r["bad_run"], round(r["final"], 9)) for r in df.select(*COLS).collect())


def test_stream_equals_batch_and_marks_late_rows(spark, rows):
    folder = tempfile.mkdtemp()
    first, rest = rows.where("t < 30"), rows.where("t >= 30")
    late = rows.where("t = 3")  # delivered again after later steps
    first.coalesce(1).write.mode("append").parquet(folder)
    rest.coalesce(1).write.mode("append").parquet(folder)
    late.coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, (folder, rows.schema), lambda s: S.score_live(s, PARAMS)).cache()
    assert got.where("late").count() == late.count()
    assert key(got.where("not late")) == key(S.score_stream(rows, PARAMS))


def test_reset_clears_a_stream(spark, rows):
    folder = tempfile.mkdtemp()
    marked = rows.where("stream_id = 1").withColumn("cmd", F.when(F.col("t") == 25, "reset"))
    marked.coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, (folder, marked.schema), lambda s: S.score_live(s, PARAMS, control="cmd"))
    tail = S.score_stream(rows.where("stream_id = 1 and t >= 25"), PARAMS)
    assert key(got.where("t >= 25")) == key(tail)


def test_model_swap_between_batches(spark, rows):
    model, folder, out, cp = (tempfile.mkdtemp() for _ in range(4))
    rows.select("stream_id", "t", "z").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("stream_id long, t int, z array<double>").parquet(folder)

    def score(batch, stats):
        return S.with_reference_scores(batch, stats, 1.0, 3.0, diag=True)

    def go(mu):
        spark.createDataFrame([([mu], [1.0])], "mu array<double>, var array<double>").write.mode("overwrite").parquet(model)
        S.start_with_model(stream, model, score, out, cp).awaitTermination(120)

    go(0.0)
    rows.limit(5).select("stream_id", "t", "z").coalesce(1).write.mode("append").parquet(folder)
    go(100.0)
    got = spark.read.parquet(f"{out}/batch=0"), spark.read.parquet(f"{out}/batch=1")
    assert got[0].agg(F.max("d_clean")).first()[0] < 50 < got[1].agg(F.min("d_clean")).first()[0]


def test_batch_trace_is_ordered_per_stream(spark, rows):
    shuffled = rows.repartition(7, "t")
    assert key(S.score_stream(shuffled, PARAMS)) == key(S.score_stream(rows, PARAMS))
