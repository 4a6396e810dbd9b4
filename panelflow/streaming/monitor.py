"""The break monitor on a stream: a pair's window of values is its keyed state.

The same rules as operators.monitor.breaks, row by row: on one input both give the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelflow.operators.monitor import EVENT


def break_events(updates: DataFrame, window: int = 60, z: float = 2.0, decay: float = 0.5, least: int = 5) -> DataFrame:
    """Events (EVENT) of a stream of updates (source, target, bar, te); each batch's rows are taken by bar."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values("bar").itertuples(index=False):
            if len(held) + 1 >= least:
                m, s = float(np.mean(held)), float(np.std(held))
                if s > 1e-10 and (r.te - m) / s > z:
                    out.append((r.bar, "te_spike", *key, m, r.te, f"{key[0]} > {key[1]}: transfer entropy {r.te:.4f} is above its mean {m:.4f}"))
                if m > 1e-10 and r.te < decay * m:
                    out.append((r.bar, "te_decay", *key, m, r.te, f"{key[0]} > {key[1]}: transfer entropy {r.te:.4f} is below its mean {m:.4f}"))
            held = [*held, float(r.te)][1 - window :]
        state.update((held,))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in EVENT.split(", ")])

    return updates.groupBy("source", "target").applyInPandasWithState(run, EVENT, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def regime_events(probabilities: DataFrame) -> DataFrame:
    """Regime changes (EVENT) of a stream (key, bar, prob): the likeliest regime against the last one."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("bar").itertuples(index=False):
            now = int(np.argmax(r.prob))
            if last is not None and now != last:
                out.append((r.bar, "regime_change", "", "", float(last), float(now), f"regime {last} became {now}"))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in EVENT.split(", ")])

    return probabilities.groupBy("key").applyInPandasWithState(run, EVENT, "last int", "append", GroupStateTimeout.NoTimeout)
