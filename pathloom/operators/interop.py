"""Shapes that other sequence tools read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import arrays, canonical, levels
from .audit import PrepareResult, prepare_sequence_data

# Column names that are recognised for each role, in order of preference.
CANDIDATES = {
    "sequence_id": ("sequence_id", "scanpath_id", "trial_id", "participant_trial_id"),
    "sequence_order": ("sequence_order", "position", "event_order", "fixation_index", "row_order"),
    "state": ("state", "aoi", "aoi_label", "event", "event_name"),
    "duration": ("duration", "fixation_duration", "event_duration"),
}


def _wide(data, sequence_id_col, order_col, state_col, row_col=None) -> DataFrame:
    df = canonical(data, sequence_id_col, order_col, state_col, None, None, row_col)
    orders = [r[0] for r in df.select("sequence_order").distinct().orderBy("sequence_order").collect()]
    label = lambda v: str(int(v)) if float(v).is_integer() else str(v)
    wide = df.groupBy("sequence_id").pivot("sequence_order", orders).agg(F.first("state"))
    return wide.toDF("sequence_id", *[f"position_{label(v)}" for v in orders])


def as_traminer_sequences(data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", missing=None, right="DEL", row_col=None) -> DataFrame:
    """Wide: one row per sequence, one column per position; gaps read ``missing``."""
    wide = _wide(data, sequence_id_col, order_col, state_col, row_col)
    return wide.fillna(missing) if missing is not None else wide


def as_seqhmm_sequences(data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", missing=None, right="DEL", row_col=None) -> DataFrame:
    return as_traminer_sequences(data, sequence_id_col, order_col, state_col, missing, right, row_col)


def as_arules_sequences(data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", row_col=None) -> DataFrame:
    """Singleton item sets: items, sequenceID, eventID."""
    df = canonical(data, sequence_id_col, order_col, state_col, None, None, row_col)
    ids = df.select("sequence_id").distinct().select("sequence_id", F.row_number().over(Window.orderBy("sequence_id")).cast("long").alias("sequenceID"))
    event = F.row_number().over(Window.partitionBy("sequence_id").orderBy("sequence_order", "original_row")).cast("long")
    return df.withColumn("eventID", event).join(ids, "sequence_id").select("sequence_id", F.array("state").alias("items"), "sequenceID", "eventID")


def as_grpstring_data(data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", alphabet: Sequence[str] | None = None, row_col=None) -> tuple[DataFrame, DataFrame]:
    """(strings, key): one character per state and one string per sequence.

    The default alphabet is the visible ASCII characters: letters in the order of their code points,
    then digits, then the others.
    """
    df = canonical(data, sequence_id_col, order_col, state_col, None, None, row_col)
    names = levels(df)
    visible = [chr(c) for c in range(33, 127)]
    letters = list(alphabet or sorted(visible, key=lambda c: (not c.isalpha(), not c.isdigit(), c)))
    if len(letters) < len(names) or len(set(letters)) < len(letters) or any(len(c) != 1 for c in letters):
        raise ValidationError("the alphabet needs a different character for each state")
    key = list(zip(names, letters, strict=False))
    code = F.create_map(*[F.lit(x) for kv in key for x in kv])
    strings = arrays(df).select("sequence_id", F.array_join(F.transform("states", lambda s: F.element_at(code, s)), "").alias("sequence_string"))
    return strings, df.sparkSession.createDataFrame(key, "event_name string, character string")


def as_igraph_transition_network(network: DataFrame, directed=True) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges); undirected edges sum the weights of both directions."""
    vertices = network.select(F.col("from_state").alias("name")).union(network.select("to_state")).where("name is not null").distinct()
    edges = network.select(F.col("from_state").alias("source"), F.col("to_state").alias("target"), "weight", "count")
    if not directed:
        edges = edges.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum("weight").alias("weight"), F.sum("count").alias("count"))
    return vertices, edges


def infer_columns(data: DataFrame, **given: str | None) -> dict[str, str | None]:
    """A column for each role: the one given, else the only candidate there is."""
    found = {}
    for role, names in CANDIDATES.items():
        if given.get(role):
            found[role] = given[role]
            continue
        there = [n for n in names if n in data.columns]
        if len(there) > 1:
            raise ValidationError(f"{role} is ambiguous: {there}")
        if not there and role != "duration":
            raise ValidationError(f"no column for {role}")
        found[role] = there[0] if there else None
    return found


def prepare_inferred_sequences(data, sequence_id_col=None, order_col=None, state_col=None, duration_col=None, metadata_cols=None, **policies) -> PrepareResult:
    """Preparation with columns found by their usual names."""
    c = infer_columns(data, sequence_id=sequence_id_col, sequence_order=order_col, state=state_col, duration=duration_col)
    return prepare_sequence_data(data, c["sequence_id"], c["sequence_order"], c["state"], c["duration"], metadata_cols, **policies)
