"""Stream scoring with state that expires: ``transformWithState`` and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .controller import ControllerParams, State
from .score import STATE, TRACE, Walker, pack, unpack


class ScoreProcessor(StatefulProcessor):
    """One stream's controller state and the timer that ends it."""

    def __init__(self, params: ControllerParams, columns: dict[str, str | None], out: list[str], idle_ms: int):
        self.params, self.columns, self.out, self.idle_ms = params, columns, out, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("controller", STATE)
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = self.columns
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([c["t"], "tie_order"], kind="stable", ignore_index=True)
        state = unpack(tuple(self.held.get())) if self.held.exists() else State()
        walker = Walker(self.params, state, 0)
        trace = walker.run([0] * len(pdf), pdf, c["t"], c["z"], c["start"])
        self.held.update(pack(walker.state))
        last = max(int(pdf["event_ms"].max()), int(self.latest.get()[0]) if self.latest.exists() else 0)
        self.latest.update((last,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.concat([pdf[self.out], trace], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def score_session(
    rows: DataFrame, params: ControllerParams, ts: str, order: str, stream: str = "stream_id", t: str = "t", z: str = "z",
    corrupt_start: str | None = "corrupt_start", delay: str = "10 minutes", idle: str = "30 minutes",
) -> DataFrame:
    """``score_live`` for streams that end (append mode): a stream idle for ``idle`` of event time is forgotten.

    Inside a micro-batch rows go by (``t``, ``order``), so of rows at one step the one that sorts first counts
    and the others are ``late``, as are rows at or before the stream's last step; they leave the state alone.
    Rows older than the watermark (``delay``) are dropped by Spark.  After it was forgotten a stream starts anew.
    Needs the RocksDB state store provider.
    """
    idle_ms = int(np.timedelta64(pd.Timedelta(idle).value, "ns") / np.timedelta64(1, "ms"))
    out = [stream, t, ts]
    need = list(dict.fromkeys([*out, z, "r_b", "d_clean", *([corrupt_start] if corrupt_start else [])]))
    d = rows.withWatermark(ts, delay).select(*need, F.col(order).alias("tie_order"), F.unix_millis(F.col(ts).cast("timestamp")).alias("event_ms"))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out)
    processor = ScoreProcessor(params, {"t": t, "z": z, "start": corrupt_start}, out, idle_ms)
    return d.groupBy(stream).transformWithStateInPandas(processor, f"{schema}, {TRACE}", "Append", "EventTime")
