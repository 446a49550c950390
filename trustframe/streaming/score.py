"""Stream scoring: a sorted-partition job for tables, a stateful query for streams.

Both prepare the stream-independent parts (reference distance, r_b, d_clean) as
ordinary columns, then run the same controller per stream in step order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scoring import reliability_b
from ..functions.vectors import l2_distance
from ..plans.lookup import spread
from .controller import ControllerParams, Mean, State, inverse_variance, score_row

TRACE = (
    "r_a double, r_b double, final double, suspicious boolean, alarm boolean, mode string, bad_run long, "
    "belief_update boolean, bad_buffer_size long, d_clean double, r_b_recover double, d_bad double, late boolean"
)
NUMBERS = ("r_a", "r_b", "final", "d_clean", "r_b_recover", "d_bad")


def with_reference_scores(rows: DataFrame, stats: DataFrame, temperature: float, bias: float, z: str = "z", diag: bool = False) -> DataFrame:
    """Add ``md_clean``, ``r_b`` and ``d_clean`` against a one-row clean reference.

    ``stats`` holds ``mu`` and ``precision`` (or ``mu`` and ``var`` with ``diag``).
    """
    from ..functions.vectors import mahalanobis_diag_sq
    from ..operators.family import mahalanobis_full

    mu = F.array(*[F.lit(float(v)) for v in stats.select("mu").first()["mu"]])
    if diag:
        var = F.array(*[F.lit(float(v)) for v in stats.select("var").first()["var"]])
        md = mahalanobis_diag_sq(z, mu, var)
    else:
        md = mahalanobis_full(z, stats)
    out = rows.withColumn("md_clean", md)
    return out.withColumn("r_b", reliability_b("md_clean", temperature, bias)).withColumn("d_clean", l2_distance(z, mu))


def _ddl(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def _value(x):
    return None if x is None or (isinstance(x, float) and np.isnan(x)) else x


class Walker:
    """Runs rows of one stream after another through the controller, keeping the current state."""

    def __init__(self, params: ControllerParams, state: State | None = None, stream=None):
        self.params, self.state, self.stream = params, state, stream
        self.inv_var = inverse_variance(params, len(params.log_var)) if params.log_var else None

    def run(self, ids: list, pdf: pd.DataFrame, t: str, z: str, start: str | None) -> pd.DataFrame:
        """Trace of a sorted chunk; rows not after their stream's last step are late."""
        out = []
        starts = pdf[start].tolist() if start else [None] * len(pdf)
        columns = zip(ids, pdf[t].tolist(), pdf[z], pdf["r_b"].tolist(), pdf["d_clean"].tolist(), starts)
        for sid, ti, zi, rb, dc, cs in columns:
            if self.state is None or sid != self.stream:
                self.stream, self.state = sid, State()
            state = self.state
            if state.last_t is not None and ti <= state.last_t:
                out.append({"mode": state.mode, "r_b": rb, "late": True})
                continue
            vec = np.asarray(zi, dtype=float)
            if self.inv_var is None:
                self.inv_var = np.ones(len(vec))
            cs = _value(cs)
            row = score_row(self.params, state, self.inv_var, int(ti), vec, rb, _value(dc), None if cs is None else int(cs))
            row["late"] = False
            out.append(row)
        trace = pd.DataFrame(out, columns=[c.split()[0] for c in TRACE.split(", ")], index=pdf.index)
        for c in NUMBERS:
            trace[c] = trace[c].astype(float)
        return trace


def score_stream(rows: DataFrame, params: ControllerParams, stream: str = "stream_id", t: str = "t", z: str = "z", corrupt_start: str | None = "corrupt_start", keep: list[str] | None = None) -> DataFrame:
    """Trace of every stream: the controller consumes each stream's rows in step order.

    Feedback from suspicion to belief makes a stream sequential, so streams are the unit
    of parallelism.  A task walks its sorted rows chunk by chunk and holds one state, so a
    very long stream costs time but no memory.
    """
    keep = keep if keep is not None else [c for c in rows.columns if c not in (z, "md_clean", "r_b", "d_clean")]
    need = list(dict.fromkeys([*keep, stream, t, z, "r_b", "d_clean", *([corrupt_start] if corrupt_start else [])]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = Walker(params)
        for pdf in batches:
            if len(pdf):
                trace = walker.run(pdf[stream].tolist(), pdf, t, z, corrupt_start)
                yield pd.concat([pdf[keep], trace], axis=1)

    schema = _ddl([f for f in rows.schema.fields if f.name in keep])
    ordered = spread(rows.select(*need), stream).sortWithinPartitions(stream, t)
    return ordered.mapInPandas(walk, f"{schema}, {TRACE}")


# ---- Structured Streaming ----------------------------------------------------------------

STATE = T.StructType(
    [
        T.StructField("flags", T.StringType()),
        T.StructField("belief", T.ArrayType(T.DoubleType())),
        T.StructField("bad_total", T.ArrayType(T.DoubleType())),
        T.StructField("mu_bad", T.ArrayType(T.DoubleType())),
        T.StructField("confirm", T.ArrayType(T.DoubleType())),
        T.StructField("fifo", T.ArrayType(T.DoubleType())),
    ]
)
_COUNTERS = ("mode", "bad_run", "good_run", "history", "rb_ema", "warm_run", "warm_total", "warm_bad", "last_t")


def pack(s: State) -> tuple:
    flags = {c: getattr(s, c) for c in _COUNTERS} | {"bad_count": s.bad.count}
    flat = lambda v: None if v is None else [float(x) for x in np.ravel(v)]
    return json.dumps(flags), flat(s.belief), flat(s.bad.total), flat(s.mu_bad), flat(s.confirm), flat(s.fifo)


def unpack(row: tuple) -> State:
    flags = json.loads(row[0])
    vec = lambda v: None if v is None else np.asarray(v, float)
    belief = vec(row[1])
    dim = 1 if belief is None else len(belief)
    rows = lambda v: [] if v is None or not len(v) else list(np.asarray(v, float).reshape(-1, dim))
    s = State(**{c: flags[c] for c in _COUNTERS})
    s.belief, s.mu_bad, s.confirm, s.fifo = belief, vec(row[3]), rows(row[4]), rows(row[5])
    s.bad = Mean(vec(row[2]), flags["bad_count"])
    return s


def score_live(rows: DataFrame, params: ControllerParams, stream: str = "stream_id", t: str = "t", z: str = "z", corrupt_start: str | None = "corrupt_start", control: str | None = None) -> DataFrame:
    """Streaming counterpart of ``score_stream`` (append mode).

    Rows are ordered by step inside each micro-batch.  A row at or before the stream's
    last step comes out with ``late`` set and leaves the state alone.  A row whose
    ``control`` column says 'reset' clears its stream first.
    """
    keep = [c for c in (stream, t) if c]
    need = list(dict.fromkeys([*keep, z, "r_b", "d_clean", *([corrupt_start] if corrupt_start else []), *([control] if control else [])]))

    def update(key: Any, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = unpack(held.get) if held.exists else State()
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(t, kind="stable")
        pieces = []
        if control:
            marks = np.flatnonzero(pdf[control].to_numpy() == "reset")
            spans = np.split(np.arange(len(pdf)), marks)
        else:
            marks, spans = np.array([], int), [np.arange(len(pdf))]
        for i, span in enumerate(spans):
            if i > 0:
                state = State()
            if len(span):
                sub = pdf.iloc[span]
                walker = Walker(params, state, 0)
                pieces.append(pd.concat([sub[keep], walker.run([0] * len(sub), sub, t, z, corrupt_start)], axis=1))
        held.update(pack(state))
        yield pd.concat(pieces)

    schema = _ddl([f for f in rows.schema.fields if f.name in keep])
    order = [f.name for f in rows.schema.fields if f.name in keep]
    keep = order
    return rows.select(*need).groupBy(stream).applyInPandasWithState(
        update, f"{schema}, {TRACE}", STATE, "append", GroupStateTimeout.NoTimeout
    )


def dedupe(rows: DataFrame, ids: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries inside the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(ids)


def alarm_rollup(trace: DataFrame, ts: str = "ts", size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Alarms and rows per clock window."""
    src = trace.withWatermark(ts, delay) if trace.isStreaming else trace
    return src.groupBy(F.window(ts, size)).agg(F.count(F.lit(1)).alias("rows"), F.count_if("alarm").alias("alarms"))


def start_trace(trace: DataFrame, path: str, checkpoint: str, name: str | None = None, **trigger):
    """Append the trace to a Parquet folder."""
    w = trace.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def start_with_model(rows: DataFrame, model_path: str, score, path: str, checkpoint: str, **trigger):
    """Score micro-batches with the clean reference found at ``model_path`` when each batch starts.

    ``score(batch, stats)`` returns the rows to append, so replacing the model table
    changes scoring from the next batch on.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        stats = batch.sparkSession.read.parquet(model_path)
        out = score(batch, stats).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def describe(params: ControllerParams) -> dict:
    """Settings as a plain dict for reports."""
    return asdict(params)
