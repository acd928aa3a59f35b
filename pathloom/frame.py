"""The canonical long table that all operators read.

One row per observed state: sequence_id (text), sequence_order (as given), state (text), row (a
unique physical position), then duration and metadata columns. Windows are by sequence_id only,
so one exchange serves an operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ValidationError

RESERVED = ("sequence_id", "sequence_order", "state", "original_row", "duration")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0 or null."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def require(df: DataFrame, columns: Sequence[str]) -> None:
    if len(set(columns)) != len(columns):
        raise ValidationError(f"column roles must be distinct: {list(columns)}")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValidationError(f"missing columns: {missing}")
    nested = [c for c in columns if _nested(df.schema[c].dataType)]
    if nested:
        raise ValidationError(f"columns must be atomic: {nested}")


def canonical(
    data: DataFrame,
    sequence_id_col: str,
    order_col: str,
    state_col: str,
    duration_col: str | None = None,
    metadata_cols: Sequence[str] | None = None,
    row_col: str | None = None,
    check: bool = True,
    missing_state_policy: str = "error",
    missing_state_label: str = "<MISSING>",
) -> DataFrame:
    """The canonical table. With ``check``, one aggregation refuses what no operator may take:
    missing ids, orders or states, orders that are not finite, and duplicated positions."""
    meta = list(metadata_cols or [])
    require(data, [sequence_id_col, order_col, state_col, *([duration_col] if duration_col else []), *meta])
    if not isinstance(data.schema[order_col].dataType, T.NumericType):
        raise ValidationError("the order column must be numeric")
    if clash := [c for c in meta if c in RESERVED and c not in (sequence_id_col, order_col, state_col, duration_col)]:
        raise ValidationError(f"metadata columns clash with reserved names: {clash}")
    state = F.when(~blank(F.col(state_col)), F.col(state_col).cast("string"))
    df = data.select(
        F.col(sequence_id_col).cast("string").alias("sequence_id"),
        F.col(order_col).alias("sequence_order"),
        state.alias("state"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id() + 1).cast("long").alias("original_row"),
        *([F.col(duration_col).cast("double").alias("duration")] if duration_col else []),
        *meta,
    )
    if missing_state_policy == "drop":
        df = df.where("state is not null")
    elif missing_state_policy == "state":
        df = df.withColumn("state", F.coalesce("state", F.lit(missing_state_label)))
    elif missing_state_policy not in ("error", "keep"):
        raise ValidationError(f"unknown missing_state_policy {missing_state_policy!r}")
    if check:
        order = F.col("sequence_order").cast("double")
        found = (
            df.groupBy("sequence_id", order.alias("o"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state").isNull()).alias("no_state"))
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.count_if(blank(F.col("sequence_id"))).alias("missing_sequence_id"),
                F.count_if(F.col("o").isNull() | F.isnan("o") | (F.abs("o") == float("inf"))).alias("missing_or_non_finite_order"),
                F.sum("no_state").alias("missing_state"),
                F.count_if(F.col("n") > 1).alias("duplicated_position"),
            )
            .first()
            .asDict()
        )
        if not found.pop("rows"):
            raise ValidationError("no rows")
        if missing_state_policy == "keep":
            found.pop("missing_state")
        if bad := {k: v for k, v in found.items() if v}:
            raise ValidationError(f"invalid sequence data: {bad}")
    return df


def by_sequence() -> Window:
    return Window.partitionBy("sequence_id").orderBy("sequence_order", "original_row")


def arrays(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per sequence: its states in order, and the named columns' least values."""
    packed = F.array_sort(F.collect_list(F.struct("sequence_order", "original_row", "state")))
    grouped = df.groupBy("sequence_id").agg(packed.alias("_s"), *[F.min(c).alias(c) for c in extra])
    return grouped.select(
        "sequence_id",
        F.transform("_s", lambda x: x["state"]).alias("states"),
        F.transform("_s", lambda x: x["sequence_order"].cast("double")).alias("orders"),
        F.transform("_s", lambda x: x["original_row"]).alias("rows"),
        *extra,
    )


def levels(df: DataFrame, declared: Sequence[str] | None = None) -> list[str]:
    """The state alphabet, sorted by code point or in the declared order. It is small by nature: one
    value per kind of state."""
    seen = {r[0] for r in df.select("state").where("state is not null").distinct().collect()}
    if declared is None:
        return sorted(seen)
    if left := sorted(seen - set(declared)):
        raise ValidationError(f"states that are not declared: {left}")
    return list(declared)


def without_metadata_variation(df: DataFrame, meta: Sequence[str]) -> None:
    """Refuses metadata that vary within a sequence (null counts as a value)."""
    if not meta:
        return
    text = [F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in meta]
    row = df.groupBy("sequence_id").agg(*[(F.min(t) != F.max(t)).alias(f"v{i}") for i, t in enumerate(text)])
    bad = row.agg(*[F.count_if(f"v{i}").alias(c) for i, c in enumerate(meta)]).first().asDict()
    if any(bad.values()):
        raise ValidationError(f"metadata vary within sequences: {[c for c, n in bad.items() if n]}")
