"""Queries: beliefs, runs, the reliability controller and stream scoring."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators.frames import rolling_bad_count
from ..plans.scans import belief_scan, prefix_agg
from ..functions.scoring import reliability_a
from ..session import materialize
from ..streaming.controller import ControllerParams
from ..streaming.score import alarm_rollup, score_stream, with_reference_scores
from .fixtures import STREAM, r6, streams

BIAS, TEMPERATURE = 3.0, 1.0
EMA = 10
BASE = dict(ema_window=EMA, beta=1.0, bias_a=BIAS, threshold_a=0.8)
WINDOWED = dict(profile="windowed", window=12, start=4, switch=6, required=3, rewarm=5, allowance=2, enter_b=0.95, **BASE)
CONSECUTIVE = dict(profile="consecutive", start=3, switch=5, required=3, rewarm=4, clean_like_b=0.8, **BASE)


def _reference(spark, d):
    """Signals with reference scores; mean over the clean prefix, variance over everything."""
    s = materialize(streams(spark, d))  # read twice: statistics and scoring
    stats = s.agg(F.array(F.avg(F.when(F.col("t") < 20, F.col("s")))).alias("mu"), F.array(F.var_samp("s")).alias("var"))
    local = stats.first()  # one mean and one variance
    one = spark.createDataFrame([local], stats.schema)
    return with_reference_scores(s, one, TEMPERATURE, BIAS, diag=True), local["var"][0]


def _score(spark, d, settings):
    rows, var = _reference(spark, d)
    params = ControllerParams(**settings, log_var=(math.log(var),))
    return score_stream(rows, params, keep=["stream_id", "t", "ts", "is_corrupt", "corrupt_start", "corrupt_end", "corruption_length"])


def score_stream_query(spark, d):
    out = _score(spark, d, WINDOWED)
    return out.select("stream_id", "t", r6("r_a"), r6("r_b"), r6("final"), "suspicious", "alarm", "mode")


def _controller(settings):
    def query(spark, d):
        out = _score(spark, d, settings)
        return out.select("stream_id", "t", "mode", "bad_run", "belief_update", "bad_buffer_size", r6("d_clean"), r6("d_bad"))

    return query


def belief_ema(spark, d):
    s = streams(spark, d).select("stream_id", "t", "z")
    b = belief_scan(s, ["stream_id"], "t", "z", (EMA - 1) / EMA)
    return b.select("stream_id", "t", r6(F.element_at("belief", 1), "belief"), r6(F.element_at("belief_next", 1), "belief_next"))


def brain_a_only(spark, d):
    """Belief of window 4, frozen during corruption; reliability before each update."""
    s = streams(spark, d).select("stream_id", "t", "z", "is_corrupt")
    b = belief_scan(s, ["stream_id"], "t", "z", 3 / 4, frozen=F.col("is_corrupt"))
    return b.select("stream_id", "t", r6(reliability_a("belief", "z", 1.0, BIAS), "r_a"))


def rolling_bad_count_query(spark, d):
    s = streams(spark, d).select("stream_id", "t", "value")
    return rolling_bad_count(s, ["stream_id"], "t", F.col("value") > 30, 50).select("stream_id", "t", "bad_run")


def consecutive_run(spark, d):
    """Bad rows since the last good one."""
    s = streams(spark, d).select("stream_id", "t", "value")
    last = prefix_agg(s, ["stream_id"], "t", {"last_good": (F.max, F.when(F.col("value") <= 30, F.col("t")))})
    return last.select("stream_id", "t", (F.col("t") - F.coalesce("last_good", F.lit(-1))).alias("bad_run"))


def first_true_offset(spark, d):
    s = streams(spark, d)
    return s.groupBy("stream_id").agg(F.min(F.when(F.col("value") > 60, F.col("t"))).alias("first_t"))


def rank_ties(spark, d):
    """Mid-ranks of event values within their type, counted from distinct values."""
    from ..plans.ranks import ordered_counts
    from .fixtures import table

    e = table(spark, d, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    cum = ordered_counts(e, ["event_type"], "value", ["c"], F.floor(F.col("value") / 16))
    return cum.select("event_type", r6("value"), "c", r6(F.col("cum_c") - (F.col("c") - 1) / 2.0, "mid_rank"))


def alarm_by_hour(spark, d):
    """Hourly alarm counts of the scored streams."""
    out = alarm_rollup(_score(spark, d, WINDOWED))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "rows", "alarms")


QUERIES = {
    "belief_ema": belief_ema,
    "brain_a_only": brain_a_only,
    "rolling_bad_count": rolling_bad_count_query,
    "consecutive_run": consecutive_run,
    "first_true_offset": first_true_offset,
    "rank_ties": rank_ties,
    "controller_windowed": _controller(WINDOWED),
    "controller_consecutive": _controller(CONSECUTIVE),
    "score_stream": score_stream_query,
    "alarm_by_hour": alarm_by_hour,
}

_REF = """rf AS (SELECT avg(s) FILTER (t < 20) AS mu, var_samp(s) AS var FROM st),
rows_ AS (SELECT st.*, var, (s - mu) * (s - mu) / var AS md, 1 / (1 + exp((s - mu) * (s - mu) / var - 3.0)) AS r_b, abs(s - mu) AS d_clean FROM st JOIN rf ON true)"""

_SEED = """SELECT stream_id, CAST(-1 AS INTEGER) AS t, ts, NULL::DOUBLE AS r_a, NULL::DOUBLE AS r_b, false AS susp, false AS upd, NULL::DOUBLE AS d_clean, NULL::DOUBLE AS d_bad,
  'clean' AS mode, 0::BIGINT AS bad_run, 0::BIGINT AS good_run, []::BIGINT[] AS hist, NULL::DOUBLE AS belief, 0.0::DOUBLE AS bs, 0::BIGINT AS bn, NULL::DOUBLE AS mu_bad,
  []::DOUBLE[] AS confirm, []::DOUBLE[] AS fifo, 0::BIGINT AS wt, 0::BIGINT AS wb FROM st WHERE t = 0"""


def _recursion(window, start, switch, required, rewarm, allowance, enter, recover, windowed):
    """The controller as a recursive query over scalar signals."""
    gate = "susp AND" if windowed else ""
    run = f"list_sum((list_append(hist, susp::BIGINT))[-{window}:])" if windowed else "CASE WHEN susp THEN bad_run + 1 ELSE 0 END"
    warm_step = "wt + 1" if windowed else "wt + ok::BIGINT"
    on_fail = "0" if windowed else "bad_run"
    return f"""ctl AS ({_SEED}
UNION ALL
SELECT stream_id, t, ts, r_a, r_b, susp, upd, d_clean, d_bad, new_mode AS mode,
  CASE WHEN watch THEN CASE WHEN new_mode = 'persistent' THEN {'0' if windowed else 'br'} ELSE br END
       WHEN mode = 'persistent' THEN CASE WHEN new_mode = 'recovering' THEN 0 ELSE br END
       ELSE CASE WHEN ok THEN 0 ELSE {on_fail} END END AS bad_run,
  CASE WHEN mode = 'persistent' AND new_mode = 'persistent' THEN gr ELSE 0 END AS good_run,
  CASE WHEN watch AND new_mode <> 'persistent' THEN h WHEN watch OR new_mode = 'clean' THEN [] ELSE hist END AS hist,
  CASE WHEN upd AND NOT susp THEN 0.9::DOUBLE * b0 + 0.1::DOUBLE * s
       WHEN mode = 'persistent' AND new_mode = 'recovering' THEN list_avg(cf)
       WHEN {'true' if windowed else 'false'} AND mode = 'recovering' AND new_mode = 'clean' AND len(ff) > 0 THEN list_avg(ff) ELSE b0 END AS belief,
  CASE WHEN new_mode = 'clean' THEN 0 ELSE bs2 END AS bs, CASE WHEN new_mode = 'clean' THEN 0 ELSE bn2 END AS bn,
  CASE WHEN new_mode = 'clean' THEN NULL WHEN watch AND new_mode = 'persistent' THEN coalesce(mu_bad, bs2 / bn2) ELSE mu_bad END AS mu_bad,
  CASE WHEN mode = 'persistent' AND new_mode = 'persistent' THEN cf ELSE [] END AS confirm,
  CASE WHEN mode = 'persistent' AND new_mode = 'recovering' THEN cf WHEN mode = 'recovering' AND new_mode = 'recovering' THEN ff ELSE [] END AS fifo,
  CASE WHEN mode = 'recovering' AND new_mode = 'recovering' THEN w1 ELSE 0 END AS wt,
  CASE WHEN mode = 'recovering' AND new_mode = 'recovering' THEN wb1 ELSE 0 END AS wb
FROM (SELECT *, new_mode = 'clean' OR (new_mode = 'recovering' AND (mode <> 'recovering' OR ok)) AS upd FROM (
 SELECT *,
  CASE WHEN watch THEN CASE WHEN {gate} br >= {switch} THEN 'persistent' WHEN {gate} br >= {start} THEN 'suspect' ELSE 'clean' END
       WHEN mode = 'persistent' THEN CASE WHEN gr >= {required} THEN 'recovering' ELSE 'persistent' END
       ELSE CASE WHEN wb1 > {allowance} THEN 'persistent' WHEN w1 >= {rewarm} THEN 'clean' ELSE 'recovering' END END AS new_mode,
  bs + CASE WHEN app THEN s ELSE 0 END AS bs2, bn + app::BIGINT AS bn2 FROM (
 SELECT *, CASE WHEN watch THEN {gate} br >= {start} WHEN mode = 'persistent' THEN {'false' if windowed else f'br >= {start}'} ELSE false END AS app FROM (
 SELECT *,
  (list_append(hist, susp::BIGINT))[-{window}:] AS h,
  CASE WHEN watch THEN {run} WHEN susp THEN bad_run + 1 ELSE 0 END AS br,
  CASE WHEN ok THEN good_run + 1 ELSE 0 END AS gr, CASE WHEN ok THEN list_append(confirm, s) ELSE [] END AS cf,
  CASE WHEN ok THEN (list_append(fifo, s))[-{EMA}:] ELSE fifo END AS ff, {warm_step} AS w1, wb + (NOT ok)::BIGINT AS wb1 FROM (
 SELECT *, mode IN ('clean', 'suspect') AS watch,
  CASE mode WHEN 'persistent' THEN r_b < {enter} WHEN 'recovering' THEN false ELSE r_a < 0.8 END AND t >= 20 AS susp, {recover} AS ok FROM (
 SELECT n.stream_id, n.t, n.ts, n.s, n.r_b, n.d_clean, p.mode, p.bad_run, p.good_run, p.hist, p.bs, p.bn, p.mu_bad, p.confirm, p.fifo, p.wt, p.wb,
  coalesce(p.belief, n.s) AS b0, abs(n.s - p.mu_bad) AS d_bad,
  1 / (1 + exp(0.5::DOUBLE * (n.s - coalesce(p.belief, n.s)) * (n.s - coalesce(p.belief, n.s)) / n.var - 3.0)) AS r_a
 FROM ctl p JOIN rows_ n ON n.stream_id = p.stream_id AND n.t = p.t + 1))))))
)"""


_WIN = "WITH RECURSIVE " + STREAM + ",\n" + _REF + ",\n" + _recursion(12, 4, 6, 3, 5, 2, 0.95, "coalesce(d_clean < d_bad, false)", True)
_CON = "WITH RECURSIVE " + STREAM + ",\n" + _REF + ",\n" + _recursion(
    12, 3, 5, 3, 4, 0, 0.8, "r_b >= 0.8 AND coalesce(d_clean < d_bad, true)", False
)
_CTL_COLS = "stream_id, t, mode, bad_run, upd AS belief_update, bn AS bad_buffer_size, round(d_clean, 6) AS d_clean, round(d_bad, 6) AS d_bad"


def _ema(alpha, frozen="false"):
    keep = f"CASE WHEN {frozen} THEN b.next ELSE {alpha}::DOUBLE * b.next + {round(1 - alpha, 6)}::DOUBLE * st.s END"
    return f"""WITH RECURSIVE {STREAM},
b AS (SELECT stream_id, t, s AS belief, s AS next, s FROM st WHERE t = 0
UNION ALL SELECT st.stream_id, st.t, b.next, {keep}, st.s FROM b JOIN st ON st.stream_id = b.stream_id AND st.t = b.t + 1)"""


ORACLE = {
    "belief_ema": _ema(0.9) + " SELECT stream_id, t, round(belief, 6) AS belief, round(next, 6) AS belief_next FROM b",
    "brain_a_only": _ema(0.75, "st.is_corrupt") + " SELECT stream_id, t, round(1 / (1 + exp(0.5::DOUBLE * (s - belief) * (s - belief) - 3.0)), 6) AS r_a FROM b",
    "rolling_bad_count": f"""WITH {STREAM}
SELECT stream_id, t, CAST(sum((value > 30)::INT) OVER (PARTITION BY stream_id ORDER BY t ROWS 49 PRECEDING) AS BIGINT) AS bad_run FROM st""",
    "consecutive_run": f"""WITH {STREAM}, i AS (SELECT stream_id, t, value, sum((value <= 30)::INT) OVER (PARTITION BY stream_id ORDER BY t) AS g FROM st)
SELECT stream_id, t, CAST(sum((value > 30)::INT) OVER (PARTITION BY stream_id, g ORDER BY t) AS INTEGER) AS bad_run FROM i""",
    "first_true_offset": f"WITH {STREAM} SELECT stream_id, min(t) FILTER (value > 60) AS first_t FROM st GROUP BY stream_id",
    "rank_ties": """WITH r AS (SELECT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type, value) AS c FROM events)
SELECT DISTINCT event_type, round(value, 6) AS value, c, round(r + (c - 1) / 2.0::DOUBLE, 6) AS mid_rank FROM r""",
    "controller_windowed": f"{_WIN} SELECT {_CTL_COLS} FROM ctl WHERE t >= 0",
    "controller_consecutive": f"{_CON} SELECT {_CTL_COLS} FROM ctl WHERE t >= 0",
    "score_stream": f"""{_WIN} SELECT stream_id, t, round(r_a, 6) AS r_a, round(r_b, 6) AS r_b,
 round(CASE WHEN mode IN ('persistent', 'recovering') THEN r_b ELSE r_a END, 6) AS final, susp AS suspicious, susp OR mode <> 'clean' AS alarm, mode FROM ctl WHERE t >= 0""",
    "alarm_by_hour": f"""{_WIN} SELECT strftime(date_trunc('hour', n.ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS rows, count(*) FILTER (susp OR mode <> 'clean') AS alarms
FROM ctl JOIN st n USING (stream_id, t) GROUP BY 1""",
}
