"""Queries: episode metrics and run summaries over stateless traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import score_band
from ..operators import episodes as E
from .fixtures import TRACE, r6, traces


def episode_metrics(spark, d):
    return E.episode_metrics(traces(spark, d)).select("episode_id", "corruption_length", *[r6(m) for m in E.METRICS])


def episode_metrics_mean(spark, d):
    return E.mean_episode_metrics(traces(spark, d)).select("episode_count", *[r6(m) for m in E.METRICS])


def episode_metrics_by_bucket(spark, d):
    s = E.summarize_split(traces(spark, d))
    return s.select("bucket", "episode_count", *[r6(m) for m in E.METRICS], r6("frame_auroc"))


def frame_auroc(spark, d):
    return E.frame_auroc(traces(spark, d)).select(r6("frame_auroc"))


def run_summary(spark, d):
    return E.run_summary(traces(spark, d)).select("steps", r6("mean_final_reliability"), r6("alarm_rate"))


def mode_histogram(spark, d):
    return E.mode_histogram(traces(spark, d))


def phase_summary(spark, d):
    s = E.phase_summary(traces(spark, d))
    return s.select("episode_id", *[r6(c) for c in ("prefix_mean", "corrupt_mean", "recover_mean")], "recovered", "b_only_steps", "final_mode")


def band_penalty(spark, d):
    t = traces(spark, d).withColumn("b", score_band("severity", "is_corrupt", "t", "corrupt_start")).select("reliability", "r_a", "r_b", "b.low", "b.high")
    return E.band_penalty(t, "reliability").select(*[r6(c) for c in ("final_penalty", "a_penalty", "b_penalty", "penalty")])


def batch_means(spark, d):
    """A batch is one step across all streams."""
    return E.batch_means(traces(spark, d), "t", ["reliability", "r_a", "r_b", "alarm"]).select(*[r6(c) for c in ("reliability", "r_a", "r_b", "alarm")])


def scored_episode_metrics(spark, d):
    """Episode metrics of the windowed controller's own trace."""
    from .streams import WINDOWED, _score

    t = _score(spark, d, WINDOWED).withColumnRenamed("stream_id", "episode_id").withColumnRenamed("final", "reliability")
    return E.episode_metrics(t).select("episode_id", "corruption_length", *[r6(m) for m in E.METRICS])


def label_phase(spark, d):
    from ..functions.scoring import label_phase as phase

    return traces(spark, d).groupBy("episode_id", phase("t", "corrupt_start", "corrupt_end").alias("phase")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "episode_metrics": episode_metrics,
    "episode_metrics_mean": episode_metrics_mean,
    "episode_metrics_by_bucket": episode_metrics_by_bucket,
    "frame_auroc": frame_auroc,
    "run_summary": run_summary,
    "mode_histogram": mode_histogram,
    "phase_summary": phase_summary,
    "band_penalty": band_penalty,
    "batch_means": batch_means,
    "scored_episode_metrics": scored_episode_metrics,
    "label_phase": label_phase,
}


def _per(src):
    return f"""per AS (SELECT episode_id, max(corruption_length) AS corruption_length,
  coalesce(avg(alarm::INT) FILTER (t < corrupt_start), 0) AS prefix_false_alarm_rate,
  coalesce(avg(alarm::INT) FILTER (t >= corrupt_start AND t < corrupt_end), 0) AS corrupt_alarm_rate,
  coalesce(avg(alarm::INT) FILTER (t >= corrupt_end), 0) AS recovery_false_alarm_rate,
  coalesce(min(t - corrupt_start) FILTER (alarm AND t >= corrupt_start AND t < corrupt_end), count(*) FILTER (t >= corrupt_start AND t < corrupt_end))::DOUBLE AS time_to_detect,
  coalesce(min(t - corrupt_end) FILTER (NOT alarm AND t >= corrupt_end), count(*) FILTER (t >= corrupt_end))::DOUBLE AS time_to_recover
  FROM {src} GROUP BY episode_id)"""


_M = ", ".join(f"round({m}, 6) AS {m}" for m in E.METRICS)
_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in E.METRICS)
_BUCKET = "CASE WHEN corruption_length <= 16 THEN 'shorter' WHEN corruption_length <= 23 THEN 'medium' ELSE 'longer' END"


def _curve(key):
    return f"""SELECT {key} (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS a"""


def _scored_sql() -> str:
    from .streams import _WIN

    return _WIN + """, sc AS (SELECT c.stream_id AS episode_id, c.t, susp OR mode <> 'clean' AS alarm, corrupt_start, corrupt_end, corruption_length FROM ctl c JOIN st n USING (stream_id, t)),
""" + _per("sc") + f" SELECT episode_id, corruption_length, {_M} FROM per"


ORACLE = {
    "episode_metrics": f"WITH {TRACE}, {_per('tr')} SELECT episode_id, corruption_length, {_M} FROM per",
    "episode_metrics_mean": f"WITH {TRACE}, {_per('tr')} SELECT count(*) AS episode_count, {_AVG} FROM per",
    "episode_metrics_by_bucket": f"""WITH {TRACE}, {_per('tr')},
b AS (SELECT 'overall' AS bucket, * FROM per UNION ALL SELECT {_BUCKET}, * FROM per),
f AS (SELECT 'overall' AS bucket, 1 - reliability AS sc, is_corrupt AS y FROM tr UNION ALL SELECT {_BUCKET}, 1 - reliability, is_corrupt FROM tr),
r AS (SELECT bucket, y, rank() OVER (PARTITION BY bucket ORDER BY sc) + (count(*) OVER (PARTITION BY bucket, sc) - 1) / 2.0::DOUBLE AS r FROM f),
a AS ({_curve('bucket,')} FROM r GROUP BY bucket)
SELECT bucket, count(*) AS episode_count, {_AVG}, round(any_value(a), 6) AS frame_auroc FROM b JOIN a USING (bucket) GROUP BY bucket""",
    "frame_auroc": f"""WITH {TRACE}, f AS (SELECT 1 - reliability AS sc, is_corrupt AS y FROM tr),
r AS (SELECT y, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2.0::DOUBLE AS r FROM f)
SELECT round(a, 6) AS frame_auroc FROM ({_curve('')} FROM r)""",
    "run_summary": f"WITH {TRACE} SELECT count(*) AS steps, round(avg(reliability), 6) AS mean_final_reliability, round(avg(alarm::INT), 6) AS alarm_rate FROM tr",
    "mode_histogram": f"WITH {TRACE} SELECT mode, count(*) AS steps FROM tr GROUP BY mode",
    "phase_summary": f"""WITH {TRACE}
SELECT episode_id, round(avg(reliability) FILTER (t < corrupt_start), 6) AS prefix_mean, round(avg(reliability) FILTER (is_corrupt), 6) AS corrupt_mean,
 round(avg(reliability) FILTER (t >= corrupt_end), 6) AS recover_mean, avg(reliability) FILTER (t >= corrupt_end) > avg(reliability) FILTER (is_corrupt) AS recovered,
 count(*) FILTER (mode IN ('persistent', 'recovering')) AS b_only_steps, max_by(mode, t) AS final_mode FROM tr GROUP BY episode_id""",
    "band_penalty": f"""WITH {TRACE},
c AS (SELECT *, CASE WHEN is_corrupt THEN CASE WHEN severity <= 1 THEN 0.6 WHEN severity >= 5 THEN 0.05 WHEN severity <= 3 THEN (1 - (severity - 1) / 2.0) * 0.6 + (severity - 1) / 2.0 * 0.3 ELSE (1 - (severity - 3) / 2.0) * 0.3 + (severity - 3) / 2.0 * 0.05 END WHEN t < corrupt_start THEN 0.99 ELSE 0.9 END::DOUBLE AS lo,
 CASE WHEN is_corrupt THEN CASE WHEN severity <= 1 THEN 0.75 WHEN severity >= 5 THEN 0.2 WHEN severity <= 3 THEN (1 - (severity - 1) / 2.0) * 0.75 + (severity - 1) / 2.0 * 0.5 ELSE (1 - (severity - 3) / 2.0) * 0.5 + (severity - 3) / 2.0 * 0.2 END ELSE 1.0 END::DOUBLE AS hi FROM tr),
p AS (SELECT {', '.join(f"avg(pow(greatest(lo - {c}, 0), 2) + pow(greatest({c} - hi, 0), 2)) AS {n}" for c, n in (('reliability', 'f'), ('r_a', 'a'), ('r_b', 'b')))} FROM c)
SELECT round(f, 6) AS final_penalty, round(a, 6) AS a_penalty, round(b, 6) AS b_penalty, round(f + 0.5::DOUBLE * a + 0.25::DOUBLE * b, 6) AS penalty FROM p""",
    "batch_means": f"""WITH {TRACE}, b AS (SELECT t, avg(reliability) AS reliability, avg(r_a) AS r_a, avg(r_b) AS r_b, avg(alarm::INT) AS alarm FROM tr GROUP BY t)
SELECT round(avg(reliability), 6) AS reliability, round(avg(r_a), 6) AS r_a, round(avg(r_b), 6) AS r_b, round(avg(alarm), 6) AS alarm FROM b""",
    "scored_episode_metrics": _scored_sql(),
    "label_phase": f"""WITH {TRACE} SELECT episode_id, CASE WHEN t < corrupt_start THEN 'prefix' WHEN t < corrupt_end THEN 'corrupt' ELSE 'recovery' END AS phase, count(*) AS n FROM tr GROUP BY 1, 2""",
}
