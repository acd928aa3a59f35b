"""Transfer between domains, and what smoothing preserves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ratio


@dataclass(frozen=True)
class TransferResult:
    domain: DataFrame
    prediction: DataFrame
    sources: DataFrame


def _divergence(rows: DataFrame, key: str, name: str) -> DataFrame:
    """source, target, Jensen-Shannon divergence in bits of the key's distributions."""
    p = rows.groupBy("ds", key).agg(F.count(F.lit(1)).alias("n"))
    p = p.select("ds", key, ratio(F.col("n"), F.sum("n").over(Window.partitionBy("ds"))).alias("p"))
    names = rows.select("ds").distinct()
    pairs = names.select(F.col("ds").alias("source")).join(names.select(F.col("ds").alias("target")), F.col("source") < F.col("target"))
    full = pairs.crossJoin(rows.select(key).distinct())  # pairs of data sets times the alphabet
    a = full.join(p.select(F.col("ds").alias("source"), key, F.col("p").alias("pa")), ["source", key], "left").join(p.select(F.col("ds").alias("target"), key, F.col("p").alias("pb")), ["target", key], "left").fillna(0.0, ["pa", "pb"])
    m = (F.col("pa") + F.col("pb")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.when(F.col(c) > 0, F.col(c)) / F.when(m > 0, m))).otherwise(0.0)
    return a.groupBy("source", "target").agg((0.5 * F.sum(term("pa")) + 0.5 * F.sum(term("pb"))).alias(name))


def sequence_transfer_audit(data: DataFrame, *, dataset_col, participant_col, sequence_col, order_col="step", state_col) -> TransferResult:
    """Divergence of data sets' tokens and transitions; held-out add-one bigram loss of a model of the own data set, of all, and of each other.

    Participants alternate between training and test by their rank within the data set.
    """
    base = data.select(F.col(dataset_col).cast("string").alias("ds"), F.col(participant_col).alias("who"), F.col(sequence_col).alias("seq"), F.col(order_col).alias("ord"), F.col(state_col).cast("string").alias("state"))
    order = Window.partitionBy("ds", "who", "seq").orderBy("ord")
    moves = base.withColumn("nxt", F.lead("state").over(order)).where("nxt is not null").withColumn("move", F.concat_ws("\x01", "state", "nxt"))
    domain = _divergence(base, "state", "token_js_bits").join(_divergence(moves, "move", "transition_js_bits"), ["source", "target"])
    people = base.select("ds", "who").distinct()
    split = people.select("ds", "who", (F.row_number().over(Window.partitionBy("ds").orderBy("who")) % 2 == 1).alias("train"))
    moves = moves.join(split, ["ds", "who"])
    size = base.agg(F.countDistinct("state").alias("k"))
    held = moves.where("not train").groupBy(F.col("ds").alias("target"), "state", "nxt").agg(F.count(F.lit(1)).alias("w"))

    def nll(counts: DataFrame, name: str) -> DataFrame:
        """source, target, mean held-out loss under a model of the source's counts."""
        total = counts.groupBy("source", "state").agg(F.sum("c").alias("t"))
        grid = counts.select("source").distinct().crossJoin(held)
        p = grid.join(counts, ["source", "state", "nxt"], "left").join(total, ["source", "state"], "left").crossJoin(size)
        loss = -F.log((F.coalesce("c", F.lit(0)) + 1.0) / (F.coalesce("t", F.lit(0)) + F.col("k")))
        return p.groupBy("source", "target").agg(ratio(F.sum(loss * F.col("w")), F.sum("w")).alias(name))

    own = moves.where("train").groupBy(F.col("ds").alias("source"), "state", "nxt").agg(F.count(F.lit(1)).alias("c"))
    sources = nll(own, "target_holdout_nll")
    pooled = nll(own.groupBy(F.lit("<all>").alias("source"), "state", "nxt").agg(F.sum("c").alias("c")), "pooled_nll").drop("source")
    counts = moves.groupBy("ds", "state", "nxt").agg(F.count(F.lit(1)).alias("n"))
    p = counts.withColumn("p", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("ds", "state"))))
    entropy = p.groupBy("ds").agg(ratio(F.sum(-F.col("n") * F.log2("p")), F.sum("n")).alias("transition_conditional_entropy")).withColumnRenamed("ds", "target")
    mixture = sources.where("source != target").groupBy("target").agg(F.avg("target_holdout_nll").alias("mean_source_nll"))
    prediction = sources.where("source = target").select("target", F.col("target_holdout_nll").alias("target_nll")).join(pooled, "target").join(mixture, "target", "left").join(entropy, "target")
    return TransferResult(domain, prediction, sources)


def audit_smoothing_event_preservation(frame: DataFrame, *, participant_col, trial_col, order_col, true_col, raw_col, smoothed_col, brief_event_max_samples=2) -> tuple[DataFrame, DataFrame]:
    """(events, trials): runs of the reference label and whether raw and smoothed labels keep them whole; errors and transitions."""
    df = frame.select(*[F.col(c).alias(a) for c, a in ((participant_col, "participant_id"), (trial_col, "trial_id"), (order_col, "o"), (true_col, "ref"), (raw_col, "raw"), (smoothed_col, "smooth"))])
    w = Window.partitionBy("participant_id", "trial_id").orderBy("o")
    changed = lambda c: F.coalesce((F.col(c) != F.lag(c).over(w)).cast("int"), F.lit(0))
    rows = df.withColumns({f"_{c}": changed(c) for c in ("ref", "raw", "smooth")}).withColumn("_run", F.sum("_ref").over(w))
    events = rows.groupBy("participant_id", "trial_id", "_run").agg(
        F.min("ref").alias("reference_label"), F.min("o").alias("start_sample"), F.count(F.lit(1)).alias("duration_samples"), F.bool_and(F.col("raw") == F.col("ref")).alias("raw_whole_event_preserved"),
        F.bool_and(F.col("smooth") == F.col("ref")).alias("smoothed_whole_event_preserved"),
    ).drop("_run").withColumn("brief_reference_event", F.col("duration_samples") <= brief_event_max_samples)
    trials = rows.groupBy("participant_id", "trial_id").agg(
        F.avg((F.col("raw") != F.col("ref")).cast("double")).alias("raw_error"), F.avg((F.col("smooth") != F.col("ref")).cast("double")).alias("smoothed_error"),
        *[F.sum(f"_{c}").alias(n) for c, n in (("ref", "reference_transitions"), ("raw", "raw_transitions"), ("smooth", "smoothed_transitions"))],
    )
    return events, trials
