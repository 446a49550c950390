"""Many small scopes share a task's call; large ones still meet block by block."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustframe.plans import tiles


@pytest.mark.parametrize("rows", [1000, 3])
def test_small_tiles_share_calls(spark, rows):
    left = spark.range(1200).select((F.col("id") % 150).alias("s"), "id")
    left = left.withColumn("s", F.when(F.col("id") < 10, F.lit(None)).otherwise(F.col("s")))
    right = spark.range(400).select((F.col("id") % 200).alias("s"), F.col("id").alias("rid"))

    def kernel(a, b):
        a, b = a.to_pydict(), b.to_pydict()
        assert len(set(a["s"]) | set(b["s"])) <= 1 and None not in a["s"]
        pairs = [(i, j) for i in a["id"] for j in b["rid"]]
        return pa.table({"id": pa.array([p[0] for p in pairs], pa.int64()), "rid": pa.array([p[1] for p in pairs], pa.int64())})

    out = tiles.scoped_cross_tiles(left, right, ["s"], "id", "rid", kernel, "id long, rid long", rows, rows)
    got = sorted(map(tuple, out.collect()))
    want = sorted(map(tuple, left.join(right, "s").select("id", "rid").collect()))
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_tile" in plan
