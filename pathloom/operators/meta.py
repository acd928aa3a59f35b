"""What the library offers, and audits and comparisons of results."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import Clustering, ClusterBootstrap
from .distance import DistanceResult, dealt, grid

_FAMILIES = {
    "preparation": ["audit", "validate", "prepare"], "description": ["encode", "states", "transitions", "paths"], "motifs": ["n-grams", "positions"],
    "subsequences": ["extract", "compare"], "consensus": ["consensus", "group comparison"], "distance": ["pairs", "clustering", "stability"],
    "network": ["network", "centrality", "communities", "Markov"], "panel": ["panel"], "latent": ["hidden Markov"], "inference": ["permutation"], "time": ["time-varying model"],
}


def sequence_capabilities(spark: SparkSession) -> DataFrame:
    """family, capability, role, native, backend, available: every row runs on Spark and NumPy alone."""
    rows = [(f, c, "core", True, "spark", True) for f, names in _FAMILIES.items() for c in names]
    return spark.createDataFrame(rows, "family string, capability string, role string, native boolean, backend string, available boolean")


def _family(x) -> str:
    return {"DistanceResult": "distance", "Clustering": "clustering", "ClusterBootstrap": "clustering", "HMM": "latent", "CovariateHMM": "latent", "PanelResult": "panel", "MotifResult": "motifs", "SubsequenceResult": "subsequences", "InferenceResult": "inference", "TimeModel": "time"}.get(type(x).__name__, "generic")


def audit_sequence_analysis(x, spark: SparkSession, tolerance=1e-8) -> tuple[DataFrame, DataFrame]:
    """(summary, issues) of a result: distances must be finite and not negative with one row a pair, clusters must cover the sequences."""
    issues: list[tuple[str, str, str, str]] = []
    if isinstance(x, DistanceResult):
        d = F.col("distance")
        twins, between = x.grouped()
        bad, key = F.when(d.isNull() | F.isnan(d) | (d < -tolerance), F.col("w")).otherwise(0), ("like_1", "like_2")
        found = between.groupBy(*key).agg(F.sum(bad).alias("bad"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
        found = found.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 1).alias("again"), F.count_if(F.col("like_1") > F.col("like_2") if x.between is not None else F.col("like_1") >= F.col("like_2")).alias("turned")).first()
        n = x.sequences.count()
        n_twins, n_ids = twins.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        issues += [("invalid_distance", "error", "distance", f"{found['bad']} distances are missing or negative")] * (found["bad"] > 0)
        issues += [("pair_count", "error", "pairs", "pairs are missing or repeated")] * (found["n"] != n * (n - 1) // 2 or found["again"] > 0 or found["turned"] > 0 or not n == n_twins == n_ids)
    elif isinstance(x, (Clustering, ClusterBootstrap)):
        c = x if isinstance(x, Clustering) else x.clustering
        left = c.distance.sequences.join(c.assignments, "sequence_id", "full").where("cluster is null").count()
        issues += [("unassigned", "error", "assignments", f"{left} sequences have no cluster")] * (left > 0)
    elif not is_dataclass(x) and not isinstance(x, DataFrame):
        issues.append(("unknown_result", "review", "class", "the class is not known"))
    status = "fail" if any(i[1] == "error" for i in issues) else "review" if issues else "pass"
    summary = spark.createDataFrame([(_family(x), type(x).__name__, status, len(issues))], "family string, primary_class string, status string, n_issues long")
    return summary, spark.createDataFrame(issues, "code string, severity string, field string, message string")


def _far_pairs(x: DistanceResult, y: DistanceResult, tolerance: float) -> int:
    """Pairs of either result that the other has not, or further apart than the tolerance. Sequences that are alike in both are counted together."""
    if x.twins is None or y.twins is None:
        both = x.pairs.join(y.pairs.withColumnRenamed("distance", "other"), ["sequence_id_1", "sequence_id_2"], "full")
        return both.where(F.col("distance").isNull() | F.col("other").isNull() | (F.abs(F.col("distance") - F.col("other")) > tolerance)).count()
    kinds = x.twins.withColumnRenamed("like", "p").join(y.twins.withColumnRenamed("like", "q"), "sequence_id", "full").groupBy("p", "q").agg(F.count(F.lit(1)).alias("size"), F.min("sequence_id").alias("id"))
    blocks, count = dealt(kinds, "id", kinds.count())
    a, b = F.col("x"), F.col("y")
    pairs = grid(blocks.agg(F.collect_list(F.struct("p", "q", "size", "id")).alias("all")), count).where(~F.col("same") | (a["id"] <= b["id"]))
    w = F.when(a["id"] == b["id"], (a["size"] * (a["size"] - 1) / 2).cast("long")).otherwise(a["size"] * b["size"])
    ends = lambda c: (F.when(b[c].isNotNull(), F.least(a[c], b[c])), F.when(a[c].isNotNull() & b[c].isNotNull(), F.greatest(a[c], b[c])))
    (p1, p2), (q1, q2) = ends("p"), ends("q")
    pairs = pairs.select(w.alias("w"), p1.alias("p1"), p2.alias("p2"), q1.alias("q1"), q2.alias("q2")).where("w > 0 and (p2 is not null or q2 is not null)").groupBy("p1", "p2", "q1", "q2").agg(F.sum("w").alias("w"))
    of = lambda r, c, d: r.between.select(F.col("like_1").alias(f"{c}1"), F.col("like_2").alias(f"{c}2"), F.col("distance").alias(d))
    both = pairs.join(of(x, "p", "d"), ["p1", "p2"], "left").join(of(y, "q", "e"), ["q1", "q2"], "left")
    bad = F.col("d").isNull() | F.col("e").isNull() | (F.abs(F.col("d") - F.col("e")) > tolerance)
    return both.where(bad).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]


def compare_sequence_analysis_results(x, y, spark: SparkSession, tolerance=1e-8, compare_values=False) -> DataFrame:
    """field, x, y, equal of two results; with ``compare_values`` also their pairs' distances, within the tolerance."""
    rows = [("family", _family(x), _family(y)), ("primary_class", type(x).__name__, type(y).__name__)]
    rows += [(f.name, str(getattr(x, f.name)), str(getattr(y, f.name, None))) for f in (fields(x) if is_dataclass(x) else []) if isinstance(getattr(x, f.name), (str, int, float, tuple))]
    out = [(f, a, b, a == b) for f, a, b in rows]
    if compare_values and isinstance(x, DistanceResult) and isinstance(y, DistanceResult):
        far = _far_pairs(x, y, tolerance)
        out.append(("values", "0", str(far), far == 0))
    return spark.createDataFrame(out, "field string, x string, y string, equal boolean")
