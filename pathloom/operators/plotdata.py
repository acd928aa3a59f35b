"""Plot data: the rows that a plot of sequences would draw."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import arrays, by_sequence, canonical, levels, ratio


def _indexed(df: DataFrame, declared) -> tuple[list[str], F.Column]:
    names = levels(df, declared)
    return names, F.create_map(*[F.lit(x) for kv in ((s, k) for k, s in enumerate(names, 1)) for x in kv])


def plot_sequence_index(data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", sort_by="input", state_levels=None, row_col=None) -> DataFrame:
    """One cell per state: plot_row of its sequence, position, state, state_index."""
    if sort_by not in ("input", "length", "path"):
        raise ValidationError("sort_by must be input, length or path")
    df = canonical(data, sequence_id_col, order_col, state_col, None, None, row_col)
    _, index = _indexed(df, state_levels)
    seqs = arrays(df)
    order = {"input": [F.array_min("rows")], "length": [F.size("states").desc()], "path": [F.array_join("states", "\x01")]}[sort_by]
    # one row per sequence is ranked, as a plot of sequences shows them all
    ranked = seqs.select("sequence_id", "states", F.row_number().over(Window.orderBy(*order, "sequence_id")).cast("long").alias("plot_row"))
    cells = ranked.select("sequence_id", "plot_row", F.posexplode("states").alias("p", "state"))
    return cells.select("sequence_id", "plot_row", (F.col("p") + 1).cast("long").alias("position"), "state", F.element_at(index, F.col("state")).cast("long").alias("state_index"))


def plot_sequence_state_distribution(data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", proportion=True, state_levels=None, row_col=None) -> DataFrame:
    """sequence_order, state, n and proportion, zero-filled over the alphabet."""
    df = canonical(data, sequence_id_col, order_col, state_col, None, None, row_col)
    names = levels(df, state_levels)
    counts = df.groupBy("sequence_order", "state").agg(F.count(F.lit(1)).alias("n"))
    level = df.sparkSession.createDataFrame([(s,) for s in names], "state string")
    full = counts.select("sequence_order").distinct().crossJoin(F.broadcast(level)).join(counts, ["sequence_order", "state"], "left").fillna(0, ["n"])
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy("sequence_order")))
    return full.select("sequence_order", "state", "n", (share if proportion else F.col("n").cast("double")).alias("value"))


def plot_sequence_entropy(data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", base=2, normalise=True, row_col=None) -> DataFrame:
    """Shannon entropy of the states at each order value; normalised by that of the whole alphabet."""
    df = canonical(data, sequence_id_col, order_col, state_col, None, None, row_col)
    counts = df.groupBy("sequence_order", "state").agg(F.count(F.lit(1)).alias("n"))
    size = df.agg(F.countDistinct("state").alias("_k"))
    p = counts.withColumn("p", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("sequence_order"))))
    raw = p.groupBy("sequence_order").agg((-F.sum(F.col("p") * F.log("p")) / math.log(base)).alias("e"), F.sum("n").alias("n"))
    top = F.log(F.col("_k").cast("double")) / math.log(base)
    value = F.when(F.col("_k") > 1, F.col("e") / F.when(F.col("_k") > 1, top)).otherwise(0.0) if normalise else F.col("e")
    return raw.crossJoin(F.broadcast(size)).select("sequence_order", "n", value.alias("entropy"))
