"""Validation and preparation of sequence tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..frame import _nested, blank

AUDIT = "sequence_id string, `row` long, `column` string, issue_code string, severity string, value string, message string, action string"

# Severity of each issue.
ERRORS = (
    "duplicate_column_names missing_required_column missing_metadata_column empty_data invalid_sequence_id_type invalid_state_type "
    "invalid_order_type missing_sequence_id missing_state missing_sequence_order non_finite_order duplicated_position invalid_duration_type "
    "non_finite_duration negative_duration invalid_metadata_type inconsistent_metadata zero_duration_disallowed unknown_state_disallowed"
).split()
REVIEWS = "unordered_rows missing_positions consecutive_repeated_state single_state_sequence missing_duration zero_duration unknown_state".split()
#: Issues that end preparation before any policy applies.
FATAL = (
    "duplicate_column_names missing_required_column missing_metadata_column empty_data invalid_sequence_id_type invalid_state_type "
    "invalid_order_type missing_sequence_id missing_sequence_order non_finite_order invalid_duration_type non_finite_duration "
    "negative_duration invalid_metadata_type inconsistent_metadata"
).split()


def _severity(code: str) -> str:
    return "error" if code in ERRORS else "review" if code in REVIEWS else "info"


def _issue(df: DataFrame, code: str, column: str, row: Column, value: Column, message: str, action: str, sequence: Column | None = None) -> DataFrame:
    return df.select(
        (F.col("_id") if sequence is None else sequence).cast("string").alias("sequence_id"), row.cast("long").alias("row"), F.lit(column).alias("column"),
        F.lit(code).alias("issue_code"), F.lit(_severity(code)).alias("severity"), value.cast("string").alias("value"),
        F.lit(message).alias("message"), F.lit(action).alias("action"),
    )


def _table_issues(data: DataFrame, rows: list[tuple[str, str, str]]) -> DataFrame:
    full = [(None, None, column, code, _severity(code), None, message, "Correct the input table.") for code, column, message in rows]
    return data.sparkSession.createDataFrame(full, AUDIT)


def audit_sequence_data(
    data: DataFrame,
    sequence_id_col: str,
    order_col: str,
    state_col: str,
    duration_col: str | None = None,
    metadata_cols: Sequence[str] | None = None,
    expected_states: Sequence[str] | None = None,
    row_col: str | None = None,
    has_rows: bool = False,
) -> DataFrame:
    """All issues of a sequence table, one row each; the input is not changed.

    ``row_col`` names a column with physical positions; without one, Spark's row ids serve. ``has_rows`` saves looking for a row.
    """
    meta = list(metadata_cols or [])
    roles = {"sequence_id": sequence_id_col, "sequence_order": order_col, "state": state_col} | ({"duration": duration_col} if duration_col else {})
    if len({*roles.values(), *meta}) < len(roles) + len(meta):
        raise ValidationError("column roles must be distinct")
    if len(set(data.columns)) < len(data.columns):
        return _table_issues(data, [("duplicate_column_names", "<table>", "Column names are not unique.")])
    absent = [("missing_required_column", c, "A required column is missing.") for c in roles.values() if c not in data.columns]
    absent += [("missing_metadata_column", c, "A metadata column is missing.") for c in meta if c not in data.columns]
    if absent:
        return _table_issues(data, absent)
    if not has_rows and data.isEmpty():
        return _table_issues(data, [("empty_data", "<table>", "The table has no rows.")])
    kinds = {c: data.schema[c].dataType for c in [*roles.values(), *meta]}
    typed = [(f"invalid_{r}_type", roles[r], "The column must be atomic.") for r in ("sequence_id", "state") if _nested(kinds[roles[r]])]
    if typed:
        return _table_issues(data, typed)
    if not isinstance(kinds[order_col], T.NumericType):
        typed.append(("invalid_order_type", order_col, "The order must be numeric."))
    if duration_col and not isinstance(kinds[duration_col], T.NumericType):
        typed.append(("invalid_duration_type", duration_col, "Durations must be numeric."))
    typed += [("invalid_metadata_type", c, "Metadata must be atomic.") for c in meta if _nested(kinds[c])]
    good_order = not any(c == "invalid_order_type" for c, _, _ in typed)
    atomic = [c for c in meta if not _nested(kinds[c])]

    df = data.select(
        F.when(~blank(F.col(sequence_id_col)), F.col(sequence_id_col).cast("string")).alias("_id"),
        (F.col(order_col).cast("double") if good_order else F.lit(None).cast("double")).alias("_order"),
        F.when(~blank(F.col(state_col)), F.col(state_col).cast("string")).alias("_state"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id() + 1).cast("long").alias("_row"),
        *([F.col(duration_col).cast("double").alias("_duration")] if duration_col and isinstance(kinds[duration_col], T.NumericType) else []),
        *[F.col(c).cast("string").alias(f"_m{i}") for i, c in enumerate(atomic)],
    )
    finite = F.col("_order").isNotNull() & ~F.isnan("_order") & (F.abs("_order") != float("inf"))
    usable = F.col("_id").isNotNull() & finite
    by_row = Window.partitionBy("_id").orderBy("_row")
    by_order = Window.partitionBy("_id").orderBy("_order", "_row")
    same = Window.partitionBy("_id", "_order")
    rows = df.where(usable).select(
        "*",
        F.lag("_order").over(by_row).alias("_before"),
        F.lag("_order").over(by_order).alias("_left"),
        F.lag("_state").over(by_order).alias("_last"),
        F.count(F.lit(1)).over(same).alias("_same"),
    )
    none = F.lit(None)
    order_text = F.format_string("%s", F.col("_order"))
    out = [_table_issues(data, typed)] if typed else []
    out.append(_issue(df.where("_id is null"), "missing_sequence_id", sequence_id_col, F.col("_row"), none, "The sequence id is missing.", "Give every row an id."))
    out.append(_issue(df.where("_state is null"), "missing_state", state_col, F.col("_row"), none, "The state is missing.", "Drop or fill the row."))
    if good_order:
        lost = F.col("_order").isNull() | F.isnan("_order")
        out += [
            _issue(df.where(lost), "missing_sequence_order", order_col, F.col("_row"), none, "The order is missing.", "Give every row an order."),
            _issue(df.where(F.abs("_order") == float("inf")), "non_finite_order", order_col, F.col("_row"), order_text, "The order is not finite.", "Use finite orders."),
            _issue(rows.where("_same > 1"), "duplicated_position", order_col, F.col("_row"), order_text, "The position occurs more than once.", "Keep one row a position."),
            _issue(
                rows.groupBy("_id").agg(F.max(F.col("_order") < F.col("_before")).alias("_bad")).where("_bad"),
                "unordered_rows", order_col, none, none, "Rows are not in order.", "They are sorted by order.",
            ),
            _issue(rows.where(F.col("_state") == F.col("_last")), "consecutive_repeated_state", state_col, F.col("_row"), F.col("_state"), "The state repeats the one before.", "Keep or collapse."),
        ]
        whole = F.abs(F.col("_order") - F.round("_order")) <= 1.49e-8
        gap = F.when((F.col("_order") - F.col("_left")) > 1, F.concat(F.col("_left").cast("long").cast("string"), F.lit("->"), F.col("_order").cast("long").cast("string")))
        gaps = rows.groupBy("_id").agg(F.min(whole).alias("_whole"), F.array_sort(F.collect_list(F.when(gap.isNotNull(), F.struct(F.col("_order").alias("o"), gap.alias("g"))))).alias("_gaps"))
        gaps = gaps.where(F.col("_whole") & (F.size("_gaps") > 0))
        out.append(_issue(gaps, "missing_positions", order_col, none, F.array_join(F.transform("_gaps", lambda g: g["g"]), ", "), "Integral positions are missing.", "Check for lost rows."))
    single = df.where("_id is not null").groupBy("_id").agg(F.count("_state").alias("_n")).where("_n = 1")
    out.append(_issue(single, "single_state_sequence", state_col, none, none, "The sequence has one state.", "Transitions are undefined."))
    if "_duration" in df.columns:
        d = F.col("_duration")
        for code, bad, text in (
            ("missing_duration", d.isNull() | F.isnan(d), "The duration is missing."),
            ("non_finite_duration", F.abs(d) == float("inf"), "The duration is not finite."),
            ("negative_duration", (d < 0) & (d != float("-inf")), "The duration is negative."),
            ("zero_duration", d == 0, "The duration is zero."),
        ):
            out.append(_issue(df.where(bad), code, duration_col, F.col("_row"), d, text, "Check the duration."))
    for i, c in enumerate(atomic):
        varied = df.where("_id is not null").groupBy("_id").agg(F.min(f"_m{i}").alias("_lo"), F.max(f"_m{i}").alias("_hi")).where("_lo != _hi")
        out.append(_issue(varied, "inconsistent_metadata", c, none, F.concat_ws(" | ", "_lo", "_hi"), "The value varies within the sequence.", "Use one value a sequence."))
    if expected_states is not None:
        strange = ~F.col("_state").isin([str(s) for s in expected_states])
        out.append(_issue(df.where(strange), "unknown_state", state_col, F.col("_row"), F.col("_state"), "The state is not expected.", "Check the state."))
        declared = data.sparkSession.createDataFrame([(str(s),) for s in expected_states] or [("",)], "_state string").where("_state != ''")
        unused = declared.join(df.select("_state").distinct(), "_state", "left_anti")
        out.append(_issue(unused, "unused_state_levels", state_col, none, F.col("_state"), "A declared state does not occur.", "None needed.", sequence=none))
    return reduce(DataFrame.unionByName, out)


def _flagged(data: DataFrame, sequence_id_col: str, order_col: str, state_col: str, duration_col=None, metadata_cols=None, expected_states=None, row_col=None) -> tuple[DataFrame, dict[str, Column]] | None:
    """The audit's columns, and the issues that a row shows alone. None if the table's form is at fault."""
    meta = list(metadata_cols or [])
    names = [sequence_id_col, order_col, state_col, *([duration_col] if duration_col else []), *meta]
    if len(set(data.columns)) < len(data.columns) or set(names) - set(data.columns):
        return None
    kinds = {c: data.schema[c].dataType for c in names}
    if any(_nested(kinds[c]) for c in names) or not all(isinstance(kinds[c], T.NumericType) for c in (order_col, *([duration_col] if duration_col else []))):
        return None
    # ids that are text or integers are as distinct as their text, so rows that are dealt by them needn't be dealt again
    key = F.col(sequence_id_col) if isinstance(kinds[sequence_id_col], (T.StringType, T.IntegralType)) else F.lit(0)
    df = data.select(
        key.alias("_key"), F.when(~blank(F.col(sequence_id_col)), F.col(sequence_id_col).cast("string")).alias("_id"), F.col(order_col).cast("double").alias("_order"),
        F.when(~blank(F.col(state_col)), F.col(state_col).cast("string")).alias("_state"), (F.col(row_col) if row_col else F.monotonically_increasing_id() + 1).cast("long").alias("_row"),
        *([F.col(duration_col).cast("double").alias("_duration")] if duration_col else []), *[F.col(c).cast("string").alias(f"_m{i}") for i, c in enumerate(meta)],
    )
    lost, endless, d = F.col("_order").isNull() | F.isnan("_order"), F.abs("_order") == float("inf"), F.col("_duration")
    each = {"missing_sequence_id": F.col("_id").isNull(), "missing_state": F.col("_state").isNull(), "missing_sequence_order": lost, "non_finite_order": endless}
    if duration_col:
        each |= {"missing_duration": d.isNull() | F.isnan(d), "non_finite_duration": F.abs(d) == float("inf"), "negative_duration": (d < 0) & (d != float("-inf")), "zero_duration": d == 0}
    if expected_states is not None:
        each["unknown_state"] = ~F.col("_state").isin([str(s) for s in expected_states])
    return df.withColumn("_ok", F.col("_id").isNotNull() & ~lost & ~endless), each


def _tally(data: DataFrame, *columns, expected_states=None, **more) -> DataFrame | None:
    """One row of n_errors, n_reviews and n_info: the numbers of issues of the audit, by one pass over the rows. None if the table's form is at fault."""
    if (found := _flagged(data, *columns, expected_states=expected_states, **more)) is None:
        return None
    df, each = found
    meta = [c for c in df.columns if c.startswith("_m")]
    by_row, by_order = (Window.partitionBy("_key", "_id", "_ok").orderBy(*c) for c in (("_row",), ("_order", "_row")))
    same = Window.partitionBy("_key", "_id", "_ok", "_order")
    rows = df.withColumns({"_left": F.lag("_order").over(by_order), "_last": F.lag("_state").over(by_order), "_same": F.count(F.lit(1)).over(same)}).withColumn("_before", F.lag("_order").over(by_row))
    ok, whole = F.col("_ok"), F.abs(F.col("_order") - F.round("_order")) <= 1.49e-8
    held = rows.groupBy("_key", "_id").agg(
        *[F.count_if(c).alias(code) for code, c in each.items()], F.count_if(ok & (F.col("_same") > 1)).alias("duplicated_position"), F.count_if(ok & (F.col("_state") == F.col("_last"))).alias("consecutive_repeated_state"),
        F.max(ok & (F.col("_order") < F.col("_before"))).cast("long").alias("unordered_rows"), (F.min(F.when(ok, whole)) & (F.count_if(ok & (F.col("_order") - F.col("_left") > 1)) > 0)).cast("long").alias("missing_positions"),
        (F.col("_id").isNotNull() & (F.count("_state") == 1)).cast("long").alias("single_state_sequence"), *[(F.col("_id").isNotNull() & (F.min(c) != F.max(c))).cast("long").alias(f"inconsistent_metadata{c[2:]}") for c in meta],
    )
    found = held.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in held.columns[2:]]).withColumn("empty_data", (F.col("_rows") == 0).cast("long")).drop("_rows")
    if expected_states is not None:
        states = list({str(s) for s in expected_states} - {""})
        seen = df.where(F.col("_state").isin(states)).agg(F.count_distinct("_state").alias("seen"))
        found = found.crossJoin(seen).withColumn("unused_state_levels", F.lit(sum(str(s) != "" for s in expected_states)) - F.col("seen")).drop("seen")
    total = lambda kind: sum((F.coalesce(F.col(c), F.lit(0)) for c in found.columns if _severity(c.rstrip("0123456789")) == kind), F.lit(0).cast("long"))
    return found.select(total("error").alias("n_errors"), total("review").alias("n_reviews"), total("info").alias("n_info"))


@dataclass(frozen=True)
class ValidationResult:
    """An audit with its counts; ``summary`` has one row."""

    audit: DataFrame
    summary: DataFrame
    mapping: DataFrame

    @property
    def valid(self) -> bool:
        return bool(self.summary.first()["valid"])


def column_mapping(data: DataFrame, sequence_id_col: str, order_col: str, state_col: str, duration_col: str | None, metadata_cols: Sequence[str] | None) -> DataFrame:
    rows = [("sequence_id", sequence_id_col), ("sequence_order", order_col), ("state", state_col)]
    rows += [("duration", duration_col)] if duration_col else []
    rows += [(f"metadata:{c}", c) for c in metadata_cols or []]
    return data.sparkSession.createDataFrame(rows, "role string, source_column string")


def validate_sequence_data(data: DataFrame, sequence_id_col: str, order_col: str, state_col: str, duration_col=None, metadata_cols=None, expected_states=None, row_col=None) -> ValidationResult:
    """The audit, and one row: valid, status, n_errors, n_reviews, n_info, n_rows, n_sequences, n_states."""
    audit = audit_sequence_data(data, sequence_id_col, order_col, state_col, duration_col, metadata_cols, expected_states, row_col)
    counts = _tally(data, sequence_id_col, order_col, state_col, duration_col, metadata_cols, expected_states=expected_states, row_col=row_col)
    if counts is None:
        counts = audit.agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "n_errors"), ("review", "n_reviews"), ("info", "n_info"))])
    has = [c for c in (sequence_id_col, state_col) if c in data.columns]
    size = data.agg(F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(F.when(~blank(F.col(c)), F.col(c).cast("string"))).alias(n) for c, n in zip(has, ("n_sequences", "n_states"), strict=False)])
    status = F.when(F.col("n_errors") > 0, "fail").when(F.col("n_reviews") > 0, "review").otherwise("pass")
    summary = counts.crossJoin(size).select((F.col("n_errors") == 0).alias("valid"), status.alias("status"), *counts.columns, *size.columns)
    return ValidationResult(audit, summary, column_mapping(data, sequence_id_col, order_col, state_col, duration_col, metadata_cols))


@dataclass(frozen=True)
class PrepareResult:
    """``data`` is None if the input or the policies failed."""

    data: DataFrame | None
    audit: DataFrame
    decisions: DataFrame
    mapping: DataFrame
    status: str


def _choose(name: str, value: str, known: Sequence[str]) -> None:
    if value not in known:
        raise ValidationError(f"{name} must be one of {list(known)}")


def prepare_sequence_data(
    data: DataFrame, sequence_id_col: str, order_col: str, state_col: str, duration_col: str | None = None, metadata_cols: Sequence[str] | None = None,
    expected_states: Sequence[str] | None = None, missing_state_policy: str = "error", duplicate_position_policy: str = "error", repeated_state_policy: str = "preserve",
    zero_duration_policy: str = "preserve", unknown_state_policy: str = "preserve", unused_state_levels: str = "preserve", row_col: str | None = None,
) -> PrepareResult:
    """The canonical table under explicit policies, with audits of input and output and a decision log."""
    for name, value, known in (
        ("missing_state_policy", missing_state_policy, ("error", "drop")), ("duplicate_position_policy", duplicate_position_policy, ("error", "first", "last")),
        ("repeated_state_policy", repeated_state_policy, ("preserve", "collapse")), ("zero_duration_policy", zero_duration_policy, ("preserve", "drop", "error")),
        ("unknown_state_policy", unknown_state_policy, ("preserve", "drop", "error")), ("unused_state_levels", unused_state_levels, ("preserve", "drop")),
    ):
        _choose(name, value, known)
    spark, meta = data.sparkSession, list(metadata_cols or [])
    mapping = column_mapping(data, sequence_id_col, order_col, state_col, duration_col, metadata_cols)
    log = "step string, policy string, affected_rows long, details string"
    fatal = {*FATAL} | ({"missing_state"} if missing_state_policy == "error" else set()) | ({"duplicated_position"} if duplicate_position_policy == "error" else set())
    alone, has_rows, failed = None if meta or duplicate_position_policy == "error" else _flagged(data, sequence_id_col, order_col, state_col, duration_col, row_col=row_col), False, False
    if alone is not None:
        bad = reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for code, c in alone[1].items() if code in fatal])
        has_rows, failed = alone[0].agg(F.count(F.lit(1)) > 0, F.coalesce(F.bool_or(bad), F.lit(True))).first()
    before = audit_sequence_data(data, sequence_id_col, order_col, state_col, duration_col, metadata_cols, expected_states, row_col, has_rows)
    staged = before.select(F.lit("input").alias("stage"), "*")
    if alone is None:
        failed = not before.where(F.col("issue_code").isin(sorted(fatal))).isEmpty()
    if failed:
        return PrepareResult(None, staged, spark.createDataFrame([], log), mapping, "fail")
    df = data.select(
        F.col(sequence_id_col).alias("sequence_id"), F.col(order_col).alias("sequence_order"), F.when(~blank(F.col(state_col)), F.col(state_col).cast("string")).alias("state"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id() + 1).cast("long").alias("original_row"),
        *([F.col(duration_col).cast("double").alias("duration")] if duration_col else []), *meta,
    )
    expected = [str(s) for s in expected_states or []]
    missing = F.col("state").isNull()
    unknown = ~missing & ~F.col("state").isin(expected) if expected else F.lit(False)
    zero = F.coalesce(F.col("duration") == 0, F.lit(False)) if duration_col else F.lit(False)
    dropped = F.when(missing, "missing").when(unknown & F.lit(unknown_state_policy == "drop"), "unknown").when(zero & F.lit(zero_duration_policy == "drop"), "zero")
    marked = df.withColumn("_drop", dropped)
    last = duplicate_position_policy == "last"
    same = Window.partitionBy("sequence_id", F.col("sequence_order").cast("double")).orderBy(F.col("original_row").desc() if last else F.col("original_row"))
    kept = marked.where("_drop is null").withColumn("_n", F.row_number().over(same))
    chosen = kept.where("_n = 1").drop("_n", "_drop")
    order = Window.partitionBy("sequence_id").orderBy("sequence_order", "original_row")
    runs = chosen.withColumn("_new", F.coalesce((F.col("state") != F.lag("state").over(order)).cast("int"), F.lit(1)))
    if repeated_state_policy == "collapse":
        runs = runs.withColumn("_run", F.sum("_new").over(order))
        first = F.min(F.struct("sequence_order", "original_row", "state", *meta)).alias("s")
        collapsed = runs.groupBy("sequence_id", "_run").agg(first, *([F.sum("duration").alias("duration")] if duration_col else []))
        result = collapsed.select("sequence_id", "s.sequence_order", "s.state", "s.original_row", *(["duration"] if duration_col else []), *[f"s.{c}" for c in meta])
    else:
        result = chosen.select("sequence_id", "sequence_order", "state", "original_row", *(["duration"] if duration_col else []), *meta)
    # one pass: rows that are dropped or not the first of a position stand aside in windows of their own
    taken = F.col("_drop").isNull()
    every = marked.withColumn("_n", F.row_number().over(Window.partitionBy("sequence_id", F.col("sequence_order").cast("double"), taken).orderBy(F.col("original_row").desc() if last else F.col("original_row"))))
    every = every.withColumn("_one", taken & (F.col("_n") == 1))
    again = F.lag("state").over(Window.partitionBy("sequence_id", "_one").orderBy("sequence_order", "original_row"))
    every = every.withColumn("_again", F.col("_one") & (F.col("state") == again))
    counts = every.agg(
        *[F.count_if(F.col("_drop") == k).alias(k) for k in ("missing", "unknown", "zero")], F.count_if(unknown).alias("seen_unknown"), F.count_if(zero).alias("seen_zero"),
        F.count_if(taken & (F.col("_n") > 1)).alias("twice"), F.count_if("_again").alias("repeats"), F.count_if("_one").alias("left"),
    ).first()
    twice, repeats = counts["twice"], counts["repeats"]
    decisions = [
        ("missing_states", missing_state_policy, counts["missing"], "rows dropped"), ("unknown_states", unknown_state_policy, counts["unknown"], "rows dropped"),
        ("zero_durations", zero_duration_policy, counts["zero"], "rows dropped"), ("duplicated_positions", duplicate_position_policy, twice, "rows dropped"),
        ("row_order", "sort", 0, "rows are read by sequence and order"), ("consecutive_repeats", repeated_state_policy, repeats if repeated_state_policy == "collapse" else 0, "rows merged"),
        ("unused_state_levels", unused_state_levels, 0, "levels are declared, not stored"), ("column_mapping", "canonical", 0, "columns renamed"),
    ]
    after = audit_sequence_data(result, "sequence_id", "sequence_order", "state", "duration" if duration_col else None, meta, None if unused_state_levels == "drop" and not expected else expected_states, "original_row", counts["left"] > 0)
    extra = []
    if zero_duration_policy == "error" and counts["seen_zero"]:
        extra.append(_issue(df.where(zero).withColumnRenamed("sequence_id", "_id"), "zero_duration_disallowed", "duration", F.col("original_row"), F.col("duration"), "Zero durations are not allowed.", "Remove them."))
    if unknown_state_policy == "error" and counts["seen_unknown"]:
        extra.append(_issue(df.where(unknown).withColumnRenamed("sequence_id", "_id"), "unknown_state_disallowed", "state", F.col("original_row"), F.col("state"), "Unknown states are not allowed.", "Remove them."))
    after = reduce(DataFrame.unionByName, [after, *extra]).select(F.lit("output").alias("stage"), "*")
    found = _tally(result, "sequence_id", "sequence_order", "state", "duration" if duration_col else None, meta, expected_states=None if unused_state_levels == "drop" and not expected else expected_states, row_col="original_row")
    errors, reviews, _ = (1, 0, 0) if found is None else found.first()
    status = "fail" if errors or extra else "review" if reviews else "pass"
    return PrepareResult(None if status == "fail" else result, staged.unionByName(after), spark.createDataFrame(decisions, log), mapping, status)
