"""Encoding and descriptive summaries: states, transitions and paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import arrays, by_sequence, canonical, levels, ratio


@dataclass(frozen=True)
class EncodeResult:
    data: DataFrame
    state_dictionary: DataFrame


@dataclass(frozen=True)
class SummaryResult:
    by_sequence: DataFrame
    overall: DataFrame


def state_dictionary(spark, names: Sequence[str], observed: set[str], prefix: str = "S", width: int | None = None) -> DataFrame:
    digits = len(str(len(names)))
    if width is not None and width < digits:
        raise ValidationError(f"width must be {digits} or more")
    rows = [(s, k, f"{prefix}{k:0{width or digits}d}", s in observed) for k, s in enumerate(names, 1)]
    return spark.createDataFrame(rows, "state string, state_index long, state_code string, observed boolean")


def encode_sequence_data(data, sequence_id_col, order_col, state_col, duration_col=None, metadata_cols=None, expected_states=None, state_levels=None, prefix="S", width=None, row_col=None) -> EncodeResult:
    """Rows with state_index and a zero-padded state_code, and the dictionary of states."""
    df = canonical(data, sequence_id_col, order_col, state_col, duration_col, metadata_cols, row_col)
    observed = set(levels(df))
    names = levels(df, state_levels if state_levels is not None else expected_states)
    dictionary = state_dictionary(df.sparkSession, names, observed, prefix, width)
    more = (["duration"] if duration_col else []) + list(metadata_cols or [])
    coded = df.join(F.broadcast(dictionary), "state").select("sequence_id", "sequence_order", "state", "state_index", "state_code", "original_row", *more)
    return EncodeResult(coded, dictionary)


def summarise_sequence_states(data, sequence_id_col, order_col, state_col, duration_col=None, metadata_cols=None, expected_states=None, row_col=None) -> SummaryResult:
    """Counts, shares and durations of states, by sequence and overall."""
    meta = list(metadata_cols or [])
    df = canonical(data, sequence_id_col, order_col, state_col, duration_col, meta, row_col)
    total = [F.sum("duration").alias("duration_sum"), F.count("duration").alias("_nd")] if duration_col else []
    per = df.groupBy("sequence_id", "state").agg(F.count(F.lit(1)).alias("n_observations"), *total, *[F.min(c).alias(c) for c in meta])
    own = Window.partitionBy("sequence_id")

    def shares(t: DataFrame, w) -> list:
        out = [ratio(F.col("n_observations"), F.sum("n_observations").over(w)).alias("observation_proportion")]
        if duration_col:
            out += ["duration_sum", ratio(F.col("duration_sum"), F.sum("duration_sum").over(w)).alias("duration_proportion"), ratio(F.col("duration_sum"), F.col("_nd")).alias("mean_duration")]
        return out

    if meta:
        per = per.select("sequence_id", "state", "n_observations", *(["duration_sum", "_nd"] if duration_col else []), *[F.min(c).over(own).alias(c) for c in meta])
    by = per.select("sequence_id", *meta, "state", "n_observations", *shares(per, own))
    sums = [F.sum("n_observations").alias("n_observations")] + ([F.sum("duration_sum").alias("duration_sum"), F.sum("_nd").alias("_nd")] if duration_col else [])
    whole = per.groupBy("state").agg(F.count(F.lit(1)).alias("n_sequences"), *sums)
    size = per.select("sequence_id").distinct().agg(F.count(F.lit(1)).alias("_sequences"))
    everything = Window.partitionBy()  # one row per kind of state
    overall = whole.crossJoin(F.broadcast(size)).select("state", "n_sequences", ratio(F.col("n_sequences"), F.col("_sequences")).alias("sequence_proportion"), "n_observations", *shares(whole, everything))
    return SummaryResult(by, overall)


def transitions(df: DataFrame, include_self: bool = True) -> DataFrame:
    """sequence_id, from_state, to_state of all adjacent pairs."""
    pairs = df.select("sequence_id", F.col("state").alias("from_state"), F.lead("state").over(by_sequence()).alias("to_state")).where("to_state is not null")
    return pairs if include_self else pairs.where("from_state != to_state")


def summarise_sequence_transitions(data, sequence_id_col, order_col, state_col, metadata_cols=None, expected_states=None, include_self=True, row_col=None) -> SummaryResult:
    """Counts and shares of adjacent pairs, by sequence and overall."""
    meta = list(metadata_cols or [])
    df = canonical(data, sequence_id_col, order_col, state_col, None, meta, row_col)
    order = by_sequence()
    whole_sequence = Window.partitionBy("sequence_id")
    pairs = df.select("sequence_id", *[F.min(c).over(whole_sequence).alias(c) for c in meta], F.col("state").alias("from_state"), F.lead("state").over(order).alias("to_state"))
    pairs = pairs.where("to_state is not null" if include_self else "to_state is not null and from_state != to_state")
    per = pairs.groupBy("sequence_id", *meta, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n_transitions"))
    own, origin = Window.partitionBy("sequence_id"), Window.partitionBy("sequence_id", "from_state")
    n = F.col("n_transitions")
    by = per.select("sequence_id", *meta, "from_state", "to_state", "n_transitions", ratio(n, F.sum(n).over(own)).alias("sequence_transition_proportion"), ratio(n, F.sum(n).over(origin)).alias("origin_transition_proportion"))
    total = per.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum(n).alias("n_transitions"))
    size = df.agg(F.countDistinct("sequence_id").alias("_sequences"))
    overall = total.crossJoin(F.broadcast(size)).select(
        "from_state", "to_state", "n_sequences", ratio(F.col("n_sequences"), F.col("_sequences")).alias("sequence_proportion"), "n_transitions",
        ratio(n, F.sum(n).over(Window.partitionBy())).alias("transition_proportion"), ratio(n, F.sum(n).over(Window.partitionBy("from_state"))).alias("origin_transition_proportion"),
    )
    return SummaryResult(by, overall)


def format_sequence_paths(data, sequence_id_col, order_col, state_col, metadata_cols=None, expected_states=None, separator=" > ", collapse_repeats=False, row_col=None) -> DataFrame:
    """One path text per sequence, with its lengths and end states."""
    meta = list(metadata_cols or [])
    df = canonical(data, sequence_id_col, order_col, state_col, None, meta, row_col)
    rows = arrays(df, meta)
    shown = F.expr("filter(states, (x, i) -> i = 0 or x != states[i - 1])") if collapse_repeats else F.col("states")
    rows = rows.withColumn("_shown", shown)
    return rows.select(
        "sequence_id", *meta, F.size("states").cast("long").alias("n_observations"), F.size("_shown").cast("long").alias("n_states"),
        F.size(F.array_distinct("states")).cast("long").alias("n_unique_states"), F.element_at("states", 1).alias("start_state"),
        F.element_at("states", -1).alias("end_state"), F.array_join("_shown", separator).alias("path"),
    )
