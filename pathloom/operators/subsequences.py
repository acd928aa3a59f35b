"""Subsequences with gaps: ordered choices of positions, bounded by gap and span."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import arrays, by_sequence, canonical, ratio, without_metadata_variation
from ..functions import stats
from .motifs import top


@dataclass(frozen=True)
class SubsequenceResult:
    occurrences: DataFrame
    sequences: DataFrame
    meta: tuple[str, ...] = ()


def extract_sequence_subsequences(
    data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", metadata_cols=None, min_length=2, max_length=5,
    max_gap=float("inf"), max_span=float("inf"), repeated_state_policy="preserve", separator=" > ", max_combinations_per_sequence=100_000, row_col=None,
) -> SubsequenceResult:
    """All ordered choices of ``min_length`` to ``max_length`` positions.

    The gap counts positions skipped between neighbours (after collapsing, if asked for), the span
    is in order units. Each added element is bounded at once, so no unbounded choice is formed. A
    sequence with more unbounded choices than ``max_combinations_per_sequence`` is refused.
    """
    if not 1 <= min_length <= max_length:
        raise ValidationError("lengths must be 1 <= min_length <= max_length")
    meta = list(metadata_cols or [])
    df = canonical(data, sequence_id_col, order_col, state_col, None, meta, row_col)
    without_metadata_variation(df, meta)
    if not df.where(F.contains("state", F.lit(separator))).isEmpty():
        raise ValidationError("states may not contain the separator")
    if repeated_state_policy == "collapse":
        df = df.withColumn("_last", F.lag("state").over(by_sequence())).where("_last is null or _last != state").drop("_last")
    seqs = arrays(df, meta).withColumn("_n", F.size("states"))
    product = lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda a, i: a * (F.col("_n") - k + i) / i)
    choices = sum((F.when(F.col("_n") >= k, product(k)).otherwise(0.0) for k in range(min_length, max_length + 1)), F.lit(0.0))
    worst = seqs.select("sequence_id", choices.alias("c")).where(F.round("c") > max_combinations_per_sequence).limit(1).collect()
    if worst:
        raise ValidationError(f"sequence {worst[0]['sequence_id']} has more than {max_combinations_per_sequence} choices")
    items = seqs.select("sequence_id", *meta, F.posexplode(F.arrays_zip("states", "orders")).alias("_p", "_x")).select("sequence_id", *meta, "_p", F.col("_x.states").alias("_s"), F.col("_x.orders").alias("_o"))
    grown = items.select("sequence_id", *meta, F.array("_s").alias("_states"), F.array("_p").alias("_places"), F.array("_o").alias("_orders"), F.lit(0).alias("_gap"))
    right = items.select(F.col("sequence_id").alias("_id"), F.col("_p").alias("_q"), F.col("_s").alias("_t"), F.col("_o").alias("_u"))
    out = [grown] if min_length == 1 else []
    for length in range(2, max_length + 1):
        last = F.element_at("_places", -1)
        on = (F.col("sequence_id") == F.col("_id")) & (F.col("_q") > last)
        if max_gap != float("inf"):
            on &= F.col("_q") - last - 1 <= max_gap
        if max_span != float("inf"):
            on &= F.col("_u") - F.element_at("_orders", 1) <= max_span
        grown = grown.join(right, on).select(
            "sequence_id", *meta, F.concat("_states", F.array("_t")).alias("_states"), F.concat("_places", F.array("_q")).alias("_places"),
            F.concat("_orders", F.array("_u")).alias("_orders"), F.greatest("_gap", F.col("_q") - last - 1).alias("_gap"),
        )
        if length >= min_length:
            out.append(grown)
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    occurrences = rows.select(
        "sequence_id", *meta, F.array_join("_states", separator).alias("subsequence"), F.size("_states").cast("long").alias("subsequence_length"),
        F.element_at("_orders", 1).alias("start_order"), F.element_at("_orders", -1).alias("end_order"),
        (F.element_at("_orders", -1) - F.element_at("_orders", 1)).alias("span"), F.col("_gap").cast("double").alias("max_observed_gap"),
        text(F.transform("_places", lambda p: p + 1)).alias("selected_positions"), text("_orders").alias("selected_orders"),
    )
    return SubsequenceResult(occurrences, seqs.select("sequence_id", *meta), tuple(meta))


def summarise_sequence_subsequences(x: SubsequenceResult) -> DataFrame:
    total = x.sequences.agg(F.count(F.lit(1)).alias("_sequences"))
    per = x.occurrences.groupBy("subsequence", "subsequence_length").agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.countDistinct("sequence_id").alias("sequence_count"), F.avg("span").alias("mean_span"),
        F.percentile("span", F.lit(0.5)).alias("median_span"), F.avg("max_observed_gap").alias("mean_max_gap"),
    )
    return per.crossJoin(F.broadcast(total)).select(
        "subsequence", "subsequence_length", "occurrence_count", "sequence_count", ratio(F.col("sequence_count"), F.col("_sequences")).alias("sequence_prevalence"),
        "mean_span", "median_span", "mean_max_gap",
    )


def filter_sequence_subsequences(summary: DataFrame, min_sequences=1, min_prevalence=0, max_mean_gap=float("inf"), top_n=None, ties="include") -> DataFrame:
    kept = summary.where((F.col("sequence_count") >= min_sequences) & (F.col("sequence_prevalence") >= min_prevalence) & (F.col("mean_max_gap") <= max_mean_gap))
    order = [F.col("sequence_prevalence").desc(), F.col("occurrence_count").desc(), F.col("subsequence_length"), F.col("subsequence")]
    return top(kept, top_n, "sequence_prevalence", "include" if ties == "include" else "first", order) if top_n else kept


def subsequence_group_counts(x: SubsequenceResult, group_col: str, min_sequence_count: int = 1) -> DataFrame:
    """subsequence, subsequence_length, group, n_group and n_present, zero-filled over all groups."""
    sizes = x.sequences.groupBy(F.col(group_col).cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n_group"))
    present = x.occurrences.select("subsequence", "subsequence_length", F.col(group_col).cast("string").alias("grp"), "sequence_id").distinct()
    counts = present.groupBy("subsequence", "subsequence_length", "grp").agg(F.count(F.lit(1)).alias("n_present"))
    patterns = counts.groupBy("subsequence", "subsequence_length").agg(F.sum("n_present").alias("_n")).where(F.col("_n") >= min_sequence_count).drop("_n")
    full = patterns.crossJoin(F.broadcast(sizes))  # patterns times the few groups
    return full.join(counts, ["subsequence", "subsequence_length", "grp"], "left").fillna(0, ["n_present"])


def compare_sequence_subsequences(x: SubsequenceResult, group_col: str, test="auto", p_adjust="BH", min_sequence_count=1) -> DataFrame:
    """A test of each pattern's presence against the groups, with prevalences and adjusted p values.

    A pattern that all or no sequences have can't be tested: its statistic and p are null.
    """
    counts = subsequence_group_counts(x, group_col, min_sequence_count)
    groups = sorted(r[0] for r in counts.select("grp").distinct().collect())
    if len(groups) < 2:
        raise ValidationError("at least two groups are needed")
    wide = counts.groupBy("subsequence", "subsequence_length").pivot("grp", groups).agg(F.first("n_present").alias("p"), F.first("n_group").alias("n"))
    columns = [(f"{g}_p", f"{g}_n") for g in groups]

    @F.pandas_udf("test string, statistic double, df double, p_value double")
    def tested(*values: pd.Series) -> pd.DataFrame:
        rows = []
        for row in zip(*values, strict=True):
            present, total = row[::2], row[1::2]
            table = pd.DataFrame({"a": present, "b": [n - p for p, n in zip(present, total, strict=True)]}).to_numpy(float)
            x2, df, p, least = stats.chi_square(table)
            if test == "fisher" or (test == "auto" and len(present) == 2 and x2 is not None and least < 5):
                odds, p = stats.fisher(*[int(v) for v in table.ravel()])
                rows.append(("fisher", odds, None, p))
            else:
                rows.append(("chisq", x2, float(df), p))
        return pd.DataFrame(rows, columns=["test", "statistic", "df", "p_value"])

    scored = wide.withColumn("_t", tested(*[F.col(f"`{c}`").cast("double") for pair in columns for c in pair])).select("*", "_t.*").drop("_t")
    share = {g: ratio(F.col(f"`{g}_p`"), F.col(f"`{g}_n`")) for g in groups}
    safe = {g: "".join(c if c.isalnum() else "." for c in g) for g in groups}
    low, high = F.least(*share.values()), F.greatest(*share.values())
    out = scored.select(
        "subsequence", "subsequence_length", "test", "statistic", "df", "p_value", high.alias("max_prevalence"), low.alias("min_prevalence"), (high - low).alias("prevalence_range"),
        *[c for g in groups for c in (share[g].alias(f"prevalence_{safe[g]}"), F.col(f"`{g}_n`").alias(f"n_{safe[g]}"))],
        *([(share[groups[1]] - share[groups[0]]).alias("prevalence_difference")] if len(groups) == 2 else []),
    )
    return out.join(adjusted(out.select("subsequence", "p_value"), p_adjust), "subsequence")


def adjusted(p: DataFrame, method: str = "BH") -> DataFrame:
    """subsequence, p_adjusted: Benjamini-Hochberg, or p itself under any other method."""
    if method != "BH":
        return p.select("subsequence", F.col("p_value").alias("p_adjusted"))
    order = Window.orderBy(F.col("p_value"), F.col("subsequence"))  # one row per pattern
    ranked = p.where("p_value is not null").select("subsequence", "p_value", F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    onward = Window.orderBy("r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = ranked.select("subsequence", F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("n") / F.col("r")).over(onward)).alias("p_adjusted"))
    return p.select("subsequence").join(found, "subsequence", "left")


def plot_sequence_subsequences(x: DataFrame, metric="sequence_prevalence", top_n=10, decreasing=True) -> DataFrame:
    order = F.col(metric).desc() if decreasing else F.col(metric)
    return x.orderBy(order, "subsequence").limit(top_n)
