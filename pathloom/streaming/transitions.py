"""Transitions of a stream of states, per sequence, and windowed counts of states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "last string, last_order double"


def _pairs(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adjacent pairs of a sequence's new rows; the last state waits for the next batch."""
    rows = pd.concat(list(parts)).sort_values("sequence_order", kind="stable")
    last, at = state.get if state.exists else (None, None)
    if at is not None:
        rows = rows[rows["sequence_order"] > at]  # what comes behind the sequence's end is late
    states, orders = rows["state"].tolist(), rows["sequence_order"].tolist()
    path = ([last] if last is not None else []) + states
    if states:
        state.update((states[-1], float(orders[-1])))
    yield pd.DataFrame({"sequence_id": key[0], "from_state": path[:-1], "to_state": path[1:]}, columns=["sequence_id", "from_state", "to_state"])


def stream_transitions(stream: DataFrame, sequence_id_col: str, order_col: str, state_col: str) -> DataFrame:
    """sequence_id, from_state, to_state of each adjacent pair, as its second state arrives.

    State is one row per sequence. Rows that come after later ones of their sequence are dropped;
    null ids or states are ignored.
    """
    rows = stream.select(F.col(sequence_id_col).cast("string").alias("sequence_id"), F.col(order_col).cast("double").alias("sequence_order"), F.col(state_col).cast("string").alias("state"))
    rows = rows.where("sequence_id is not null and state is not null and sequence_order is not null")
    return rows.groupBy("sequence_id").applyInPandasWithState(_pairs, "sequence_id string, from_state string, to_state string", _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_state_counts(stream: DataFrame, state_col: str, time_col: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window, state, n: counts per event-time window; rows later than ``late`` are dropped."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), F.col(state_col).cast("string").alias("state")).agg(F.count(F.lit(1)).alias("n"))
