"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``--runs N`` times (default 2); the median counts.
The run writes p50/p95 and rows per second to
``$BENCH_CSV`` when that is set.
"""

from __future__ import annotations

import csv
import json
import os
import statistics
import sys
import time

from trustframe.registry import all_queries
from trustframe.session import build_session

# Headline queries by group: family scoring, stream scoring, pair metrics, episodes, points and frames.
HEADLINE = {
    "family_nearest": "embeddings", "clean_cov_shrunk": "embeddings", "few_shot_cosine": "embeddings",
    "controller_windowed": "events", "belief_ema": "events", "rolling_bad_count": "events",
    "pair_separation": "embeddings", "pair_separation_cosine": "embeddings", "pair_auroc": "embeddings", "knn_purity": "embeddings",
    "silhouette_cosine": "embeddings", "loo_centroid": "embeddings", "permutation_pvalue": "embeddings",
    "episode_metrics_by_bucket": "events", "frame_auroc": "events",
    "grid_pillars": "lineitem", "pillarize": "lineitem", "voxel_mean": "lineitem", "knn_group": "lineitem",
    "masked_pool": "lineitem", "delta_median": "embeddings", "noise": "embeddings",
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(sys.argv[sys.argv.index("--runs") + 1]) if "--runs" in sys.argv else 2
    names = os.environ.get("BENCH_QUERIES", "").split() or list(HEADLINE)
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    queries = all_queries()
    sizes = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in set(HEADLINE.values())}
    queries["family_nearest"](spark, sf).write.format("noop").mode("overwrite").save()  # start workers
    best, rows = {}, []
    for name in names:
        times = []
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
        for _ in range(runs):
            t = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        best[name] = round(statistics.median(times), 3)
        p95 = sorted(times)[max(0, -(-95 * len(times) // 100) - 1)]
        n = sizes[HEADLINE.get(name, "lineitem")]
        rows.append([name, HEADLINE.get(name, ""), n, round(best[name], 3), round(p95, 3), round(n / best[name])])
    if os.environ.get("BENCH_CSV"):
        with open(os.environ["BENCH_CSV"], "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(["query", "table", "rows", "p50_sec", "p95_sec", "rows_per_sec"])
            w.writerows(rows)
    print(json.dumps({"metric": "headline_total", "value": round(sum(best.values()), 3), "unit": "sec", "queries": best, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
