"""Facts copied per salt stay on the executors, and a resampled frame needs no second ranking."""

from pyspark.sql import functions as F

from trustframe.operators import points
from trustframe.plans import lookup


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_copies_are_not_broadcast(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("k"), "id")
    for null_keys in (False, True):
        got = lookup.salted_join(df, df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], ["id"], null_keys=null_keys)
        assert "BroadcastHashJoin" not in final_plan(got)
        assert got.count() == 3000


def test_resampling_with_known_sizes(spark):
    p = spark.range(4000).select((F.col("id") % 7).alias("frame_id"), F.floor(F.col("id") / 7).alias("point_idx"))
    p = p.where((F.col("frame_id") < 4) | (F.col("point_idx") < 20))
    sized = p.join(p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")), "frame_id")
    rows = lambda d: sorted(map(tuple, d.select("frame_id", "slot", "point_idx").collect()))
    own, known = points.resample_points(p, "frame_id", 60, 50, 3), points.resample_points(sized, "frame_id", 60, 50, 3, sizes="n")
    assert rows(own) == rows(known) and len(rows(own)) == 7 * 60


def test_slots_of_small_frames_are_not_broadcast(spark):
    p = spark.range(4000).select((F.col("id") % 200).alias("frame_id"), F.floor(F.col("id") / 200).alias("point_idx"))
    got = points.resample_points(p, "frame_id", 600, 590, 3)
    assert "BroadcastHashJoin" not in final_plan(got)
    assert got.count() == 200 * 600
