"""Consensus sequences and comparisons of groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import by_sequence, canonical, levels, ratio

#: Weights nearer than this tie.
TOLERANCE = 1.49e-8


def group_text(cols: Sequence[str]) -> Column:
    """A composite key of group columns; null reads <NA>, no columns __all__."""
    if not cols:
        return F.lit("__all__")
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in cols])


def create_consensus_sequence(
    data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", group_cols=None, weight_col=None, missing_state_policy="exclude",
    missing_state_label="<MISSING>", tie_method="first", state_levels=None, min_support=1, row_col=None,
) -> DataFrame:
    """The weighted modal state of each group and position. Rows of weight 0 are no support, but their sequences count."""
    if tie_method not in ("first", "last", "missing", "all"):
        raise ValidationError("tie_method must be first, last, missing or all")
    groups = list(group_cols or [])
    policy = {"exclude": "keep", "state": "state", "error": "error"}[missing_state_policy]
    meta = [*groups, *([weight_col] if weight_col and weight_col not in groups else [])]
    df = canonical(data, sequence_id_col, order_col, state_col, None, meta, row_col, missing_state_policy=policy, missing_state_label=missing_state_label)
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    df = df.select("sequence_id", "sequence_order", "state", weight.alias("_w"), *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")).alias(c) for c in groups])
    if weight_col and not df.where("_w is null or isnan(_w) or _w < 0 or _w = double('inf')").isEmpty():
        raise ValidationError("weights must be finite and not negative")
    declared = {s: k for k, s in enumerate(state_levels or [])}
    rank = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv])[F.col("state")] if declared else F.lit(None).cast("int")
    keys = [*groups, "sequence_order"]
    counts = df.groupBy(*groups).agg(F.countDistinct("sequence_id").alias("n_sequences"))
    per = df.where("state is not null and _w > 0").groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"))
    place = Window.partitionBy(*keys)
    marked = per.withColumn("_max", F.max("_w").over(place)).withColumn("_rank", F.coalesce(rank, F.lit(len(declared))))
    tied = F.array_sort(F.collect_list(F.when(F.col("_w") >= F.col("_max") - TOLERANCE, F.struct("_rank", "state"))))
    found = marked.groupBy(*keys).agg(
        F.sum("_n").alias("support_n"), F.sum("_w").alias("support_weight"), F.max("_w").alias("_top"), F.transform(tied, lambda x: x["state"]).alias("_tied")
    ).where(F.col("support_n") >= min_support)
    first, last = F.element_at("_tied", 1), F.element_at("_tied", -1)
    joined = F.array_join("_tied", " | ")
    tie = {"first": first, "last": last, "missing": F.when(F.size("_tied") == 1, first), "all": joined}[tie_method]
    named = found.select(*keys, tie.alias("consensus_state"), "support_n", "support_weight", ratio(F.col("_top"), F.col("support_weight")).alias("agreement"), F.size("_tied").cast("long").alias("tie_n"), joined.alias("tied_states"))
    return named.join(counts, groups) if groups else named.crossJoin(F.broadcast(counts))


_CONSENSUS = {"sequence_order", "consensus_state", "support_n", "support_weight", "agreement", "tie_n", "tied_states", "n_sequences"}


def _groups(consensus: DataFrame) -> list[str]:
    return [c for c in consensus.columns if c not in _CONSENSUS]


def summarise_consensus_agreement(consensus: DataFrame, by="overall", threshold=0.5) -> DataFrame:
    keys = {"overall": [], "group": _groups(consensus), "position": ["sequence_order"]}[by]
    a, w = F.col("agreement"), F.col("support_weight")
    return consensus.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_positions"), F.avg(a).alias("mean_agreement"), F.percentile(a, F.lit(0.5)).alias("median_agreement"), F.min(a).alias("min_agreement"),
        F.max(a).alias("max_agreement"), ratio(F.sum(a * w), F.sum(w)).alias("weighted_agreement"), F.count_if(F.col("tie_n") > 1).alias("n_ties"),
        F.count_if(a < threshold).alias("n_below_threshold"), F.lit(float(threshold)).alias("threshold"),
    )


def format_consensus_sequence(consensus: DataFrame, separator=" -> ", include_order=False, include_agreement=False, digits=3) -> DataFrame:
    """One path per group; an open tie reads <TIE>."""
    part = F.coalesce("consensus_state", F.lit("<TIE>"))
    if include_order:
        part = F.concat(F.col("sequence_order").cast("string"), F.lit(":"), part)
    if include_agreement:
        part = F.concat(part, F.lit(" ("), F.format_string(f"%.{digits}f", "agreement"), F.lit(")"))
    packed = F.array_sort(F.collect_list(F.struct("sequence_order", part.alias("p"))))
    return consensus.groupBy(*_groups(consensus)).agg(packed.alias("_p")).select(
        *_groups(consensus), F.array_join(F.transform("_p", lambda x: x["p"]), separator).alias("path"), F.size("_p").cast("long").alias("n_positions")
    )


@dataclass(frozen=True)
class GroupComparison:
    states: DataFrame
    transitions: DataFrame
    lengths: DataFrame
    state_contrasts: DataFrame
    transition_contrasts: DataFrame
    length_contrasts: DataFrame


def _contrasts(df: DataFrame, key: str, measures: Sequence[str], pairs: DataFrame, zero_policy: str) -> DataFrame:
    """Measures of each key in both groups of each pair; what a group lacks is 0."""
    keys = df.select(key).distinct()
    base = keys.crossJoin(F.broadcast(pairs))  # keys times the few pairs of groups
    out = base
    for side in ("group_1", "group_2"):
        own = df.select(F.col("grp").alias(side), key, *[F.col(m).cast("double").alias(f"{m}_{side}") for m in measures])
        out = out.join(own, [side, key], "left").fillna(0.0, [f"{m}_{side}" for m in measures])
    cols = []
    for m in measures:
        a, b = F.col(f"{m}_group_1"), F.col(f"{m}_group_2")
        quotient = F.when(b != 0, a / F.when(b != 0, b))
        if zero_policy == "infinite":
            quotient = F.when((b == 0) & (a > 0), F.lit(float("inf"))).otherwise(quotient)
        cols += [a, b, (a - b).alias(f"{m}_difference"), quotient.alias(f"{m}_ratio")]
    return out.select("group_1", "group_2", key, *cols)


def compare_sequence_groups(
    data, group_col, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", reference=None, metrics=("state", "transition", "length"),
    include_self=True, transition_separator=" -> ", zero_policy="missing", row_col=None,
) -> GroupComparison:
    """States, transitions and lengths by group, and contrasts of all pairs of groups (or each with the reference)."""
    df = canonical(data, sequence_id_col, order_col, state_col, None, [group_col], row_col)
    df = df.select("sequence_id", "sequence_order", "original_row", "state", F.coalesce(F.col(group_col).cast("string"), F.lit("<NA>")).alias("grp"))
    spark = df.sparkSession
    lengths = df.groupBy("grp", "sequence_id").agg(F.count(F.lit(1)).alias("n"))
    size = lengths.groupBy("grp").agg(F.count(F.lit(1)).alias("_sequences"))
    names = sorted(r[0] for r in size.select("grp").collect())
    if len(names) < 2:
        raise ValidationError("at least two groups are needed")
    if reference is not None and reference not in names:
        raise ValidationError("the reference is not a group")
    pairs = [(g, reference) for g in names if g != reference] if reference is not None else [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    pairs = spark.createDataFrame(pairs, "group_1 string, group_2 string")

    def shares(rows: DataFrame, key: str, count: str, share: str, full: bool) -> DataFrame:
        per = rows.groupBy("grp", key).agg(F.count(F.lit(1)).alias(count), F.countDistinct("sequence_id").alias("sequence_count"))
        if full:
            per = size.select("grp").crossJoin(per.select(key).distinct()).join(per, ["grp", key], "left").fillna(0, [count, "sequence_count"])
        per = per.join(F.broadcast(size), "grp")
        total = F.sum(count).over(Window.partitionBy("grp"))
        return per.select("grp", key, count, ratio(F.col(count), total).alias(share), "sequence_count", ratio(F.col("sequence_count"), F.col("_sequences")).alias("sequence_prevalence"))

    states = shares(df, "state", "event_count", "event_share", True)
    nxt = df.withColumn("_to", F.lead("state").over(by_sequence())).where("_to is not null" if include_self else "_to is not null and _to != state")
    moves = nxt.select("grp", "sequence_id", F.concat(F.col("state"), F.lit(transition_separator), F.col("_to")).alias("transition"))
    moved = shares(moves, "transition", "occurrence_count", "occurrence_share", False)
    length = lengths.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_sequences"), F.avg("n").alias("mean_length"), F.percentile("n", F.lit(0.5)).alias("median_length"), F.min("n").alias("min_length"),
        F.max("n").alias("max_length"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd_length"),
    )
    left = length.select(F.col("grp").alias("group_1"), F.col("mean_length").alias("mean_length_group_1"), F.col("median_length").alias("median_length_group_1"))
    right = length.select(F.col("grp").alias("group_2"), F.col("mean_length").alias("mean_length_group_2"), F.col("median_length").alias("median_length_group_2"))
    diff = lambda m: (F.col(f"{m}_group_1") - F.col(f"{m}_group_2")).alias(f"{m}_difference")
    length_contrasts = pairs.join(left, "group_1").join(right, "group_2").select(
        "group_1", "group_2", "mean_length_group_1", "mean_length_group_2", diff("mean_length"), "median_length_group_1", "median_length_group_2", diff("median_length")
    )
    named = lambda t: t.withColumnRenamed("grp", "group")
    return GroupComparison(
        named(states), named(moved), named(length), _contrasts(states, "state", ["event_share", "sequence_prevalence"], pairs, zero_policy),
        _contrasts(moved, "transition", ["occurrence_share", "sequence_prevalence"], pairs, zero_policy), length_contrasts,
    )


def plot_consensus_sequence(consensus: DataFrame, type="agreement", group=None) -> DataFrame:
    keys = _groups(consensus)
    rows = consensus.where(group_text(keys) == group) if group is not None and keys else consensus
    return rows.withColumn("plot_label", F.coalesce("consensus_state", F.lit("<TIE>")))


def plot_sequence_group_comparison(comparison: GroupComparison, component="state", measure=None, top_n=12) -> DataFrame:
    """key, group, value of the top keys by their greatest value; what a group lacks is 0."""
    if component == "length":
        return comparison.lengths.select(F.lit("length").alias("key"), "group", F.col(measure or "mean_length").cast("double").alias("value"))
    table, key, usual = {"state": (comparison.states, "state", "event_share"), "transition": (comparison.transitions, "transition", "occurrence_share")}[component]
    m = measure or usual
    chosen = table.groupBy(key).agg(F.max(m).alias("_m")).orderBy(F.col("_m").desc(), key).limit(top_n).select(key)
    full = chosen.crossJoin(F.broadcast(table.select("group").distinct()))
    return full.join(table.select(key, "group", F.col(m).cast("double").alias("value")), [key, "group"], "left").fillna(0.0, ["value"]).withColumnRenamed(key, "key")
