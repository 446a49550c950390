"""Components of long paths take few rounds; large buckets are compared in blocks."""

from pyspark.sql import functions as F
from test_operators import brute_groups, near_rows

from trustframe.llm import neardup


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    seen, keep = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, label: seen.append(label) or keep(df, label))
    n = 1000
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = neardup.components(edges).collect()
    assert len(got) == n and {r.comp for r in got} == {0}
    assert seen.count("near-parents") <= 20


def test_mixed_paths_and_stars(spark):
    pairs = [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(40)] + [(200, k) for k in range(201, 240)] + [(300, 300), (301, 302)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    head = {n: n for p in pairs for n in p}
    for _ in range(100):
        for a, b in pairs:
            head[a] = head[b] = min(head[a], head[b])
    head.pop(300)
    assert got == head


def test_bucket_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 0)
    rows = near_rows(8, 6, 12)
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(rows)
