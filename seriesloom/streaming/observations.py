"""Structured Streaming: returns, running sums and rolling means of each key's observations.

State is bounded: for each key the last value that was there, the running sum and the last w values. Rows
of a key must come in order of time from batch to batch; inside a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last double, total double, ring array<double>"


def observe(stream: DataFrame, key: str, time: str, value: str, w: int) -> DataFrame:
    """key, time, value, dlog, cs1 of dlog, and the strict rolling mean of the last w values of the input."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {kinds[key]}, {time} {kinds[time]}, {value} double, dlog double, cs1 double, rolling_mean double"

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, ring = state.get if state.exists else (None, 0.0, [])
        ring = list(ring)
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        returns, levels, means = [], [], []
        for x in rows[value].astype(float):
            r = np.nan
            if not np.isnan(x):
                if last is not None and last > 0 and x > 0:
                    r = float(np.log(x) - np.log(last))
                    total += r
                last = float(x)
                ring = [*ring, float(x)][-w:]
            returns.append(r)
            levels.append(np.nan if np.isnan(r) else 1 + total)
            means.append(float(np.mean(ring)) if len(ring) == w else np.nan)
        state.update((last, total, ring))
        # missing values leave as NULL, not as NaN
        gone = lambda v: [None if np.isnan(z) else z for z in v]
        yield pd.DataFrame({key: group[0], time: rows[time].to_numpy(), value: pd.Series(gone(rows[value].astype(float)), dtype=object).to_numpy(), "dlog": gone(returns), "cs1": gone(levels), "rolling_mean": gone(means)})

    return stream.select(key, time, value).groupBy(key).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)
