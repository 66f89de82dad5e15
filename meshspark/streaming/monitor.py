"""Sequential monitoring of a stream of parts: the rank chart's statistic, part by part.

This extends the batch chart to Structured Streaming; it claims no parity beyond ``operators.spc.rank_chart``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.spc import LAMBDA, WINDOW

OUTPUT = "sim_id int, t int, t_stat double, n_late long"
STATE = "t int, features array<string>, history array<double>, late long"


def monitor(parts: DataFrame, m0: int, lam: float = LAMBDA, longest: int = WINDOW, most_history: int = 10_000) -> DataFrame:
    """parts(sim_id, t, feature_id, value) as a stream -> (sim_id, t, t_stat, n_late) of every t above m0.

    State per simulation: all parts' values, since a rank is taken among all of them; beyond ``most_history`` parts the
    stream fails, for a shorter history would give other ranks. Parts must come whole and in order of t within and across
    batches; one with a t not above the last is late and left out, and n_late counts the late rows so far.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, features, history, late = state.get if state.exists else (0, [], [], 0)
        features = list(features)
        matrix = np.array(history, dtype=float).reshape(-1, len(features)) if features else None
        rows = []
        batch = pd.concat(list(frames))
        late += int((batch["t"] <= last).sum())
        for t, part in batch[batch["t"] > last].groupby("t", sort=True):
            part = part.sort_values("feature_id")
            if matrix is None:
                features = part["feature_id"].astype(str).tolist()
                matrix = np.zeros((0, len(features)))
            matrix = np.vstack([matrix, part["value"].to_numpy(dtype=float)])
            if len(matrix) > most_history:
                raise ValueError(f"simulation {key[0]} has more than {most_history} parts")
            last = int(t)
            if last > m0:
                n, win = len(matrix), min(last - m0, longest)
                order = np.argsort(matrix, axis=0, kind="stable")
                ranks = np.empty_like(order)
                np.put_along_axis(ranks, order, np.arange(1, n + 1)[:, None] + np.zeros_like(order), axis=0)
                weight = (1 - lam) ** np.arange(win - 1, -1, -1)
                first, second = weight.sum(), (weight * weight).sum()
                sd = math.sqrt(second * (n * n - 1) / 12 - (first * first - second) * (n + 1) / 12)
                score = ((weight @ ranks[n - win :] - first * (n + 1) / 2) / sd) ** 2
                rows.append((key[0], last, float(score.max()), late))
        if matrix is not None:
            state.update((last, features, matrix.reshape(-1).tolist(), late))
        yield pd.DataFrame(rows, columns=["sim_id", "t", "t_stat", "n_late"])

    return parts.groupBy("sim_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
