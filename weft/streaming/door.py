"""The causal smoothers over a stream of lines, with state for each unit.

Lines of a unit must come in order between micro-batches; within one they are
sorted by order_by.  State is the last averages, or the last rows of the window,
of the unit's current run; idle units can be given a timeout.  A unit's rows of a
micro-batch are smoothed run by run, in vectorised form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _run(df: DataFrame, unit: Sequence[str], order_by: Sequence[str], cols: Sequence[str], segment: str | None, smooth: Callable[[np.ndarray, np.ndarray, pd.DataFrame], tuple[np.ndarray, np.ndarray]], idle_ms: int | None) -> DataFrame:
    """smooth(state of the run so far, new values, their rows) gives (smoothed
    values, state); a state is a matrix with a column for each of cols."""
    columns, width = df.columns, len(cols)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, mark = (np.array(state.get[0], float).reshape(-1, width), state.get[1]) if state.exists else (np.empty((0, width)), None)
        rows = pd.concat(list(batches)).sort_values(list(order_by), ignore_index=True)
        marks = rows[segment].astype(str) if segment else pd.Series("", index=rows.index)
        before = marks.shift(fill_value=mark) if mark is not None else marks.shift()
        starts = np.flatnonzero((marks != before).to_numpy())
        values = rows[list(cols)].to_numpy(float)
        out = np.empty_like(values)
        for a, b in zip(np.unique([0, *starts]), [*np.unique([0, *starts])[1:], len(rows)], strict=True):
            if a in starts:
                held = np.empty((0, width))
            out[a:b], held = smooth(held, values[a:b], rows.iloc[a:b])
        rows[list(cols)] = out
        state.update((held.ravel().tolist(), marks.iloc[-1]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield rows[columns]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(*unit).applyInPandasWithState(fold, _schema(df), "held array<double>, mark string", "append", timeout)


def ema(df: DataFrame, unit: Sequence[str], order_by: Sequence[str], cols: Sequence[str], alpha: float = 0.1, segment: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """operators.door.ema for a stream: cols must be double.  State holds one
    number for each of cols."""
    a = min(1.0, max(1e-6, float(alpha)))

    def smooth(held: np.ndarray, values: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        whole = np.concatenate((held[-1:], values))
        done = pd.DataFrame(whole).ewm(alpha=a, adjust=False, ignore_na=True).mean().to_numpy()
        done[:, np.isnan(whole[0])] = np.nan  # a run that starts with a missing value
        return done[len(whole) - len(values) :], done[-1:]

    return _run(df, unit, order_by, cols, segment, smooth, idle_ms)


def lookback(df: DataFrame, unit: Sequence[str], order_by: Sequence[str], cols: Sequence[str], size: int | str = 20, mean: bool = False, linear: bool = False, segment: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """operators.door.lookback for a stream: cols must be double; size is a number,
    or the column that has each unit's own.  State holds size * len(cols) numbers
    at most."""

    def smooth(held: np.ndarray, values: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        k = max(1, int(rows[size].iloc[0] if isinstance(size, str) else size))
        whole = np.concatenate((held[max(0, len(held) - k + 1) :], values))
        place = np.arange(1, len(whole) + 1.0)
        start = np.maximum(0, np.arange(len(whole)) - k + 1)
        known = ~np.isnan(whole)
        cells = np.where(known, whole, 0.0)

        def window(x: np.ndarray) -> np.ndarray:
            total = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))
            return total[1:] - total[start]

        top, weight = window(cells), window(known.astype(float))
        if linear:
            top = window(cells * place[:, None]) - start[:, None] * top
            weight = window(known * place[:, None]) - start[:, None] * weight
        done = np.where(weight > 0, top / np.maximum(weight, 1e-300), np.nan) if mean else top
        return done[len(whole) - len(values) :], whole[max(0, len(whole) - k + 1) :]

    return _run(df, unit, order_by, cols, segment, smooth, idle_ms)
