"""The break monitor by event time: rows out of order, forgotten pairs, restarts.

A pair's rows wait in a list of the state store until the watermark has passed them; a timer of
their time then takes them in order, so the events don't depend on how rows arrived, as long as
they weren't later than the watermark allows (later ones are left out by Spark). A pair that has
shown nothing for as long as `forget` loses its window, and its state goes by another timer. Wants the RocksDB store
(use_rocksdb), whose lists are appended to without being rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelflow.operators.monitor import EVENT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def judged(held: list[float], te: float, z: float, decay: float, least: int) -> list[tuple[str, float]]:
    """(kind, mean) of the events that a value is, against those before it."""
    out = []
    if len(held) + 1 >= least:
        m, s = float(np.mean(held)), float(np.std(held))
        if s > 1e-10 and (te - m) / s > z:
            out.append(("te_spike", m))
        if m > 1e-10 and te < decay * m:
            out.append(("te_decay", m))
    return out


class BreakMonitor(StatefulProcessor):
    """Rows (source, target, bar, ts, te) of a pair, in the order of their times."""

    def __init__(self, window: int, z: float, decay: float, least: int, forget_ms: int):
        self.window, self.z, self.decay, self.least, self.forget_ms = window, z, decay, least, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, bar long, te double")
        self.held = handle.getListState("held", "te double")
        self.seen = handle.getValueState("seen", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            times = (pdf["ts"].astype("datetime64[ms]").astype("int64")).tolist()
            self.waiting.appendList([(int(t), int(b), float(v)) for t, b, v in zip(times, pdf["bar"], pdf["te"], strict=True)])
            for t in set(times):
                self.handle.registerTimer(t)
        yield self.events([], key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        last = self.seen.get()[0] if self.seen.exists() else None
        if not due:
            if last is not None and last + self.forget_ms <= now:
                self.held.clear()
                self.seen.clear()
            yield self.events([], key)
            return
        held, found = [r[0] for r in self.held.get()] if self.held.exists() else [], []
        for ts, bar, te in due:
            if last is not None and ts - last >= self.forget_ms:
                held = []
            found += [(bar, kind, m, te) for kind, m in judged(held, te, self.z, self.decay, self.least)]
            held, last = [*held, te][1 - self.window :], ts
        self.held.put([(v,) for v in held])
        self.seen.update((last,))
        self.waiting.put(later) if later else self.waiting.clear()
        self.handle.registerTimer(last + self.forget_ms)
        yield self.events(found, key)

    def events(self, found: list[tuple], key: tuple) -> pd.DataFrame:
        place = {"te_spike": "above", "te_decay": "below"}
        rows = [(bar, kind, *key, m, te, f"{key[0]} > {key[1]}: transfer entropy {te:.4f} is {place[kind]} its mean {m:.4f}") for bar, kind, m, te in found]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in EVENT.split(", ")])

    def close(self) -> None:
        pass


def timed_events(updates: DataFrame, window: int = 60, z: float = 2.0, decay: float = 0.5, least: int = 5, late: str = "1 day", forget_ms: int = 90 * 86_400_000) -> DataFrame:
    """Events (EVENT) of a stream of updates (source, target, bar, ts timestamp, te), told once the watermark is past them."""
    rows = updates.withWatermark("ts", late).groupBy("source", "target")
    return rows.transformWithStateInPandas(BreakMonitor(window, z, decay, least, forget_ms), EVENT, "append", "EventTime")
