"""Contiguous motifs: windows of states, their summaries, filters and positions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import arrays, canonical, levels, ratio
from .describe import SummaryResult, state_dictionary

METRICS = ("sequence_prevalence", "n_occurrences", "n_sequences")
MOTIF = ["motif_id", "motif_key", "motif", "motif_length"]


@dataclass(frozen=True)
class MotifResult:
    """All windows, the sequences they come from, and the motifs; ``meta`` names the metadata columns."""

    occurrences: DataFrame
    sequences: DataFrame
    motifs: DataFrame
    meta: tuple[str, ...] = ()


def extract_sequence_ngrams(
    data, sequence_id_col, order_col, state_col, duration_col=None, metadata_cols=None, expected_states=None,
    min_length=2, max_length=3, overlap="allow", separator=" > ", state_levels=None, row_col=None,
) -> MotifResult:
    """Every window of each length; with overlap 'disallow', per sequence and motif the greedy choice from the left."""
    if not 1 <= min_length <= max_length:
        raise ValidationError("lengths must be 1 <= min_length <= max_length")
    if overlap not in ("allow", "disallow"):
        raise ValidationError("overlap must be allow or disallow")
    meta = list(metadata_cols or [])
    df = canonical(data, sequence_id_col, order_col, state_col, duration_col, meta, row_col)
    names = levels(df, state_levels if state_levels is not None else expected_states)
    codes = {r["state"]: r["state_code"] for r in state_dictionary(df.sparkSession, names, set(names)).collect()}
    code = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    seqs = arrays(df, meta).withColumn("n_states", F.size("states").cast("long"))
    sized = seqs.withColumn("_length", F.explode(F.sequence(F.lit(min_length), F.lit(max_length)))).where("_length <= n_states")
    starts = sized.withColumn("_start", F.explode(F.sequence(F.lit(1), (F.col("n_states") - F.col("_length") + 1).cast("int"))))
    stop = F.col("_start") + F.col("_length") - 1
    window = F.slice("states", F.col("_start"), F.col("_length"))
    key = F.array_join(F.transform(window, lambda s: F.element_at(code, s)), "|")
    rows = starts.select(
        "sequence_id", *meta, F.concat(F.lit("L"), F.col("_length").cast("string"), F.lit(":"), key).alias("motif_id"), key.alias("motif_key"),
        F.array_join(window, separator).alias("motif"), F.col("_length").cast("long").alias("motif_length"), F.col("_start").cast("long").alias("start_index"),
        stop.cast("long").alias("end_index"), F.element_at("orders", F.col("_start")).alias("start_order"), F.element_at("orders", stop).alias("end_order"),
        F.element_at("rows", F.col("_start")).alias("start_original_row"), F.element_at("rows", stop).alias("end_original_row"), "n_states",
    )
    per = Window.partitionBy("sequence_id", "motif_id").orderBy("start_index")
    candidates = rows.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_candidate_occurrences"))
    if overlap == "disallow":
        chosen = F.aggregate(
            F.array_sort(F.collect_list("start_index")),
            F.array().cast("array<bigint>"),
            lambda acc, s: F.when((F.size(acc) == 0) | (s >= F.try_element_at(acc, F.lit(-1)) + F.col("motif_length")), F.concat(acc, F.array(s))).otherwise(acc),
        )
        keep = rows.groupBy("sequence_id", "motif_id", "motif_length").agg(chosen.alias("_k")).select("sequence_id", "motif_id", F.explode("_k").alias("start_index"))
        rows = rows.join(keep, ["sequence_id", "motif_id", "start_index"], "left_semi")
    rows = rows.withColumn("occurrence_index", F.row_number().over(per).cast("long"))
    occurrences = rows.select(
        "sequence_id", *meta, *MOTIF, "start_index", "end_index", "start_order", "end_order", "start_original_row", "end_original_row", "occurrence_index",
    )
    kept = rows.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_retained_occurrences"), F.countDistinct("motif_id").alias("n_distinct_motifs"))
    sequences = seqs.select("sequence_id", *meta, "n_states").join(candidates, "sequence_id", "left").join(kept, "sequence_id", "left").fillna(
        0, ["n_candidate_occurrences", "n_retained_occurrences", "n_distinct_motifs"]
    )
    return MotifResult(occurrences, sequences, occurrences.select(*MOTIF).distinct(), tuple(meta))


def summarise_sequence_motifs(x: MotifResult) -> SummaryResult:
    """Motif counts by sequence, and overall with prevalence over all sequences."""
    meta = list(x.meta)
    by = x.occurrences.groupBy("sequence_id", *meta, *MOTIF).agg(
        F.count(F.lit(1)).alias("n_occurrences"), F.min("start_index").alias("first_start_index"), F.max("start_index").alias("last_start_index")
    )
    whole = by.groupBy(*MOTIF).agg(F.sum("n_occurrences").alias("n_occurrences"), F.count(F.lit(1)).alias("n_sequences"))
    totals = x.sequences.agg(F.count(F.lit(1)).alias("_sequences"), F.sum("n_retained_occurrences").alias("_occurrences"))
    n, s = F.col("n_occurrences"), F.col("n_sequences")
    overall = whole.crossJoin(F.broadcast(totals)).select(
        *MOTIF, "n_occurrences", "n_sequences", ratio(s, F.col("_sequences")).alias("sequence_prevalence"), ratio(n, F.col("_occurrences")).alias("occurrence_share"),
        ratio(n, F.col("_sequences")).alias("mean_occurrences_per_sequence"), ratio(n, s).alias("mean_occurrences_when_present"),
    )
    return SummaryResult(by, overall)


def canonical_order(rank_by: str = "sequence_prevalence") -> list[Column]:
    if rank_by not in METRICS:
        raise ValidationError(f"rank_by must be one of {METRICS}")
    return [F.col(c).desc() for c in (rank_by, *[m for m in METRICS if m != rank_by])] + [F.col("motif_length"), F.col("motif_key")]


def top(df: DataFrame, n: int, rank_by: str, ties: str, order: list[Column]) -> DataFrame:
    """The first ``n`` rows by ``rank_by``; 'include' also gives those that tie with the last."""
    if ties == "first":
        return df.orderBy(*order).limit(n)
    edge = df.orderBy(F.col(rank_by).desc()).limit(n).agg(F.min(rank_by).alias("_edge"))
    return df.crossJoin(F.broadcast(edge)).where(F.col(rank_by) >= F.col("_edge")).drop("_edge")


def filter_sequence_motifs(x, min_occurrences=1, min_sequences=1, min_prevalence=0, motif_lengths=None, top_n=None, rank_by="sequence_prevalence", ties="include") -> SummaryResult:
    """Motifs that reach thresholds, or the top of them; by_sequence follows."""
    summary = summarise_sequence_motifs(x) if isinstance(x, MotifResult) else x
    kept = summary.overall.where((F.col("n_occurrences") >= min_occurrences) & (F.col("n_sequences") >= min_sequences) & (F.col("sequence_prevalence") >= min_prevalence))
    if motif_lengths:
        kept = kept.where(F.col("motif_length").isin(list(motif_lengths)))
    if top_n:
        kept = top(kept, top_n, rank_by, ties, canonical_order(rank_by))
    return SummaryResult(summary.by_sequence.join(kept.select("motif_id"), "motif_id", "left_semi"), kept)


def format_sequence_motifs(x, digits=3, prevalence="proportion", include_rank=True, rank_by="sequence_prevalence", ties="min", include_ids=True) -> DataFrame:
    """A display table with ranks; shares are rounded half to even, and times 100 as percent."""
    table = (summarise_sequence_motifs(x) if isinstance(x, MotifResult) else x).overall
    # one row per motif, as many as a reader looks at
    order = Window.orderBy(F.col(rank_by).desc()) if ties == "min" else Window.orderBy(*canonical_order(rank_by))
    rank = (F.rank() if ties == "min" else F.row_number()).over(order).cast("long").alias("rank")
    percent = prevalence == "percent"
    share = lambda c: F.bround((100 if percent else 1) * F.col(c), digits).alias(c + ("_percent" if percent else ""))
    return table.select(
        *([rank] if include_rank else []), *(["motif_id", "motif_key"] if include_ids else []), "motif", "motif_length", "n_occurrences", "n_sequences",
        share("sequence_prevalence"), share("occurrence_share"), *[F.bround(c, digits).alias(c) for c in ("mean_occurrences_per_sequence", "mean_occurrences_when_present")],
    )


@dataclass(frozen=True)
class PositionResult:
    summary: DataFrame
    occurrences: DataFrame
    by: tuple[str, ...] = ()


def summarise_sequence_motif_positions(x: MotifResult, position="start", scale="absolute", by: Sequence[str] | None = None) -> PositionResult:
    """Where motifs stand: least, greatest, mean and median position, as places or as shares of the length."""
    if position not in ("start", "centre", "end") or scale not in ("absolute", "relative"):
        raise ValidationError("position is start, centre or end; scale is absolute or relative")
    by = list(by or [])
    place = {"start": F.col("start_index").cast("double"), "end": F.col("end_index").cast("double"), "centre": (F.col("start_index") + F.col("end_index")) / 2.0}[position]
    joined = x.occurrences.join(x.sequences.select("sequence_id", "n_states"), "sequence_id")
    share = F.when(F.col("n_states") <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("absolute_position") - 1) / F.when(F.col("n_states") > 1, F.col("n_states") - 1))))
    rows = joined.withColumn("absolute_position", place).withColumn("relative_position", share)
    rows = rows.select(
        "sequence_id", *by, *MOTIF, "start_index", "end_index", "n_states", F.lit(position).alias("position_basis"), F.lit(scale).alias("position_scale"),
        "absolute_position", "relative_position", F.col(f"{scale}_position").alias("position_value"),
    )
    v = F.col("position_value")
    summary = rows.groupBy(*by, *MOTIF, "position_basis", "position_scale").agg(
        F.count(F.lit(1)).alias("n_occurrences"), F.countDistinct("sequence_id").alias("n_sequences"), F.min(v).alias("min_position"), F.max(v).alias("max_position"),
        F.avg(v).alias("mean_position"), F.percentile(v, F.lit(0.5)).alias("median_position"),
    )
    return PositionResult(summary, rows, tuple(by))


def format_sequence_motif_positions(x: PositionResult, digits=3, position_units="proportion", include_rank=True) -> DataFrame:
    """Motifs from earliest to latest within their group."""
    scale = 100 if position_units == "percent" else 1
    rank = F.rank().over(Window.partitionBy(*x.by).orderBy("mean_position")).cast("long").alias("rank")
    names = ["min_position", "max_position", "mean_position", "median_position"]
    return x.summary.select(*([rank] if include_rank else []), *[c for c in x.summary.columns if c not in names], *[F.bround(scale * F.col(c), digits).alias(c) for c in names])


def plot_sequence_motifs(x, metric="sequence_prevalence", top_n=20, motif_lengths=None, ties="include", horizontal=True) -> DataFrame:
    """Ranked bars: plot_rank, plot_value, plot_label."""
    found = filter_sequence_motifs(x, motif_lengths=motif_lengths, top_n=top_n, rank_by=metric, ties=ties).overall
    return found.withColumns({"plot_rank": F.row_number().over(Window.orderBy(*canonical_order(metric))).cast("long"), "plot_value": F.col(metric).cast("double"), "plot_label": F.col("motif")})


def plot_sequence_motif_positions(x: MotifResult, motifs=None, position="start", scale="absolute", top_n=10, display="strip") -> DataFrame:
    """Positions of selected motifs; for strips each with its offset from the motif's line."""
    rows = summarise_sequence_motif_positions(x, position, scale).occurrences
    if motifs:
        rows = rows.where(F.col("motif_id").isin(motifs) | F.col("motif_key").isin(motifs) | F.col("motif").isin(motifs))
    else:
        rows = rows.join(filter_sequence_motifs(x, top_n=top_n, ties="first").overall.select("motif_id"), "motif_id", "left_semi")
    same = Window.partitionBy("motif_id", "position_value")
    place = F.row_number().over(same.orderBy("sequence_id", "start_index"))
    count = F.count(F.lit(1)).over(same)
    return rows.withColumn("plot_offset", (place - (count + 1) / 2.0) / F.greatest(count, F.lit(1)) * 0.6)
