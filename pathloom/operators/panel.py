"""Panels: sequences of the same unit at several occasions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import arrays, canonical, levels, ratio, without_metadata_variation
from .distance import pair_distance


@dataclass(frozen=True)
class PanelResult:
    """One row per sequence with its place in the panel, and its states."""

    index: DataFrame
    states: DataFrame
    levels: tuple[str, ...]


def _changes(states):
    return F.expr(f"cast(size(filter({states}, (x, i) -> i > 0 and x != {states}[i - 1])) as bigint)")


def prepare_sequence_panel(data, panel_id_col, occasion_col, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", metadata_cols=None, require_unique_occasions=True, row_col=None) -> PanelResult:
    """Ranks each unit's sequences by occasion (ties by id)."""
    meta = list(metadata_cols or [])
    df = canonical(data, sequence_id_col, order_col, state_col, None, [panel_id_col, occasion_col, *meta], row_col)
    without_metadata_variation(df, [panel_id_col, occasion_col])
    seqs = arrays(df, [panel_id_col, occasion_col, *meta])
    if not seqs.where(F.col(panel_id_col).isNull() | F.col(occasion_col).isNull()).isEmpty():
        raise ValidationError("panel ids and occasions may not be missing")
    if require_unique_occasions and not seqs.groupBy(panel_id_col, occasion_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValidationError("a unit has two sequences at one occasion")
    order = Window.partitionBy(panel_id_col).orderBy(occasion_col, "sequence_id")
    index = seqs.select(
        "sequence_id", F.col(panel_id_col).cast("string").alias("panel_id"), F.col(occasion_col).alias("_occasion"), F.col(occasion_col).cast("string").alias("occasion"),
        F.row_number().over(order).cast("long").alias("occasion_rank"), F.size("states").cast("long").alias("sequence_length"), _changes("states").alias("transition_count"), "states", *meta,
    )
    return PanelResult(index.drop("states", "_occasion"), index.select("sequence_id", "panel_id", "occasion", "_occasion", "occasion_rank", "sequence_length", "transition_count", "states"), tuple(levels(df)))


def summarise_sequence_panel(panel: PanelResult) -> tuple[DataFrame, DataFrame]:
    """(occasions, occasions by state): sizes, lengths, and shares of states, zero-filled."""
    occasions = panel.index.groupBy("occasion").agg(
        F.countDistinct("panel_id").alias("n_panels"), F.count(F.lit(1)).alias("n_sequences"), F.avg("sequence_length").alias("mean_length"),
        F.percentile("sequence_length", F.lit(0.5)).alias("median_length"), F.avg("transition_count").alias("mean_transitions"),
    )
    rows = panel.states.select("occasion", "sequence_id", F.explode("states").alias("state"))
    per = rows.groupBy("occasion", "state").agg(F.count(F.lit(1)).alias("occurrence_count"), F.countDistinct("sequence_id").alias("sequence_count"))
    names = panel.index.sparkSession.createDataFrame([(s,) for s in panel.levels], "state string")
    full = occasions.select("occasion", "n_sequences").crossJoin(F.broadcast(names)).join(per, ["occasion", "state"], "left").fillna(0, ["occurrence_count", "sequence_count"])
    total = F.sum("occurrence_count").over(Window.partitionBy("occasion"))
    states = full.select("occasion", "state", "occurrence_count", ratio(F.col("occurrence_count"), total).alias("occurrence_share"), "sequence_count", ratio(F.col("sequence_count"), F.col("n_sequences")).alias("sequence_prevalence"))
    return occasions, states


def compare_sequence_panel_changes(panel: PanelResult, method="levenshtein", normalise="none", indel_cost=1, substitution_cost=1, substitution_matrix=None, transition_smoothing=0) -> DataFrame:
    """Distances and differences between a unit's consecutive sequences; each row is measured in place, without a pair join."""
    order = Window.partitionBy("panel_id").orderBy("occasion_rank")
    ahead = {c: F.lead(c).over(order).alias(f"to_{c}") for c in ("sequence_id", "occasion", "occasion_rank", "sequence_length", "transition_count", "states")}
    rows = panel.states.select("*", *ahead.values()).where("to_sequence_id is not null")
    if method == "transition":
        if transition_smoothing:
            raise ValidationError("smoothed profiles of a panel's pairs come from compute_sequence_distance")
        both = F.array_distinct(F.concat("states", "to_states"))
        moves = lambda s: F.expr(f"transform(filter(sequence(1, greatest(size({s}) - 1, 1)), i -> i < size({s})), i -> concat({s}[i - 1], '\\u0001', {s}[i]))")
        rows = rows.withColumns({"_a": moves("states"), "_b": moves("to_states"), "_k": both})
        cell = "array_distinct(concat(_a, _b))"
        share = lambda m: f"coalesce(size(filter({m}, x -> x = k)) / nullif(cast(size(filter({m}, x -> substring_index(x, '\\u0001', 1) = substring_index(k, '\\u0001', 1))) as double), 0.0D), 0.0D)"
        d = F.expr(f"sqrt(aggregate({cell}, 0.0D, (s, k) -> s + pow({share('_a')} - {share('_b')}, 2)))")
    else:
        d = pair_distance(F.col("states"), F.col("to_states"), list(panel.levels), method, indel_cost, substitution_cost, substitution_matrix)
    scale = {"none": F.lit(1), "max_length": F.greatest("sequence_length", "to_sequence_length"), "path_length": F.col("sequence_length") + F.col("to_sequence_length")}[normalise]
    return rows.select(
        "panel_id", F.col("sequence_id").alias("from_sequence_id"), "to_sequence_id", F.col("occasion").alias("from_occasion"), "to_occasion",
        F.col("occasion_rank").alias("from_rank"), F.col("to_occasion_rank").alias("to_rank"), ratio(d, scale).alias("distance"),
        (F.col("to_sequence_length") - F.col("sequence_length")).alias("length_change"), (F.col("to_transition_count") - F.col("transition_count")).alias("transition_change"),
    )


def plot_sequence_panel_changes(changes: DataFrame, metric="distance", type="individual") -> DataFrame:
    label = F.concat_ws(" -> ", "from_occasion", "to_occasion").alias("transition")
    if type == "individual":
        return changes.select("panel_id", "from_rank", label, F.col(metric).cast("double").alias("value"))
    rows = changes.select("from_rank", label, F.col(metric).cast("double").alias("value"))
    return rows.groupBy("transition").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"))
