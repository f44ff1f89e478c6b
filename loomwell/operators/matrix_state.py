"""Recurrence with a matrix state for each head, one sequence per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def step(state: np.ndarray, r, w, k, v, neg, adapt):
    """One position: state (heads, n, n); the vectors are (heads, n)."""
    state = state * np.exp(w)[:, None, :] + state @ (neg[:, :, None] * adapt[:, None, :]) + v[:, :, None] * k[:, None, :]
    return state, (state @ r[:, :, None])[:, :, 0]


def run(df: DataFrame, heads: int, size: int) -> DataFrame:
    """(seq, t, r, w, k, v, neg, adapt) arrays of heads * size -> (seq, t, y), from a zero state."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        state, out = np.zeros((heads, size, size)), []
        cols = {c: np.stack(frame[c].to_numpy()).reshape(-1, heads, size) for c in ("r", "w", "k", "v", "neg", "adapt")}
        for i in range(len(frame)):
            state, y = step(state, *(cols[c][i] for c in ("r", "w", "k", "v", "neg", "adapt")))
            out.append(y.ravel().tolist())
        return pd.DataFrame({"seq": frame["seq"], "t": frame["t"], "y": out})

    return df.groupBy("seq").applyInPandas(one, "seq long, t long, y array<double>")
