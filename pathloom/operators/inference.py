"""Group differences of sequence measures: permutation tests and bootstrap intervals."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import arrays, canonical, ratio
from ..functions.stats import quantile_weibull

METRICS = ("sequence_length", "transition_count", "state_prevalence", "subsequence_presence")


@dataclass(frozen=True)
class ComparisonDesign:
    group_col: str
    unit_col: str
    design: str = "observational"
    pair_col: str | None = None
    cluster_col: str | None = None


def declare_sequence_comparison_design(group_col, unit_col, design="observational", pair_col=None, cluster_col=None) -> ComparisonDesign:
    if design not in ("observational", "randomized", "paired_randomized"):
        raise ValidationError("design must be observational, randomized or paired_randomized")
    if (design == "paired_randomized") != (pair_col is not None):
        raise ValidationError("a paired design, and no other, has a pair column")
    if pair_col and cluster_col:
        raise ValidationError("pairs and clusters exclude each other")
    return ComparisonDesign(group_col, unit_col, design, pair_col, cluster_col)


def unit_table(data, design: ComparisonDesign, metric="sequence_length", target_state=None, target_subsequence=None, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", separator=" > ", row_col=None) -> DataFrame:
    """unit, group, [pair], [cluster], metric (mean over the unit's sequences), n_sequences."""
    if metric not in METRICS:
        raise ValidationError(f"metric must be one of {METRICS}")
    roles = {"unit": design.unit_col, "group": design.group_col} | ({"pair": design.pair_col} if design.pair_col else {}) | ({"cluster": design.cluster_col} if design.cluster_col else {})
    df = canonical(data, sequence_id_col, order_col, state_col, None, list(dict.fromkeys(c for c in roles.values() if c != sequence_id_col)), row_col)
    seqs = arrays(df, [c for c in dict.fromkeys(roles.values()) if c != sequence_id_col])
    if metric == "subsequence_presence":
        parts = [p for p in (target_subsequence or "").split(separator) if p]
        k = len(parts)
        found = F.exists(F.sequence(F.lit(1), F.size("states") - k + 1), lambda i: F.slice("states", i, k) == F.array(*[F.lit(p) for p in parts])) if k else F.lit(False)
        value = F.when(F.size("states") >= k, found).otherwise(False).cast("double")
    else:
        value = {
            "sequence_length": F.size("states").cast("double"),
            "transition_count": F.expr("cast(size(filter(states, (x, i) -> i > 0 and x != states[i - 1])) as double)"),
            "state_prevalence": ratio(F.size(F.filter("states", lambda s: s == target_state)), F.size("states")),
        }[metric]
    keys = [F.col("sequence_id" if c == sequence_id_col else c).cast("string").alias(r) for r, c in roles.items()]
    return seqs.select(*keys, value.alias("metric")).groupBy(*roles).agg(F.avg("metric").alias("metric"), F.count(F.lit(1)).alias("n_sequences"))


@dataclass(frozen=True)
class InferenceResult:
    estimate: DataFrame
    units: DataFrame
    permuted: np.ndarray
    groups: tuple[str, str]
    interval: DataFrame | None = None
    boot: np.ndarray | None = None


def observed_difference(units: DataFrame) -> DataFrame:
    """group_1, group_2, their means of unit values, and the difference."""
    means = units.groupBy("group").agg(F.avg("metric").alias("m"))
    edge = means.agg(F.min("group").alias("group_1"), F.max("group").alias("group_2"))
    one, two = means.select(F.col("group").alias("group_1"), F.col("m").alias("mean_group_1")), means.select(F.col("group").alias("group_2"), F.col("m").alias("mean_group_2"))
    return edge.join(one, "group_1").join(two, "group_2").select("group_1", "group_2", "mean_group_1", "mean_group_2", (F.col("mean_group_2") - F.col("mean_group_1")).alias("difference_group_2_minus_group_1"))


def _difference(value: np.ndarray, second: np.ndarray) -> float:
    return float(value[second].mean() - value[~second].mean())


def _permute(second: np.ndarray, pair, cluster, rng: np.random.Generator) -> np.ndarray:
    if pair is not None:
        out = second.copy()
        for p in dict.fromkeys(pair):
            own = pair == p
            if rng.random() < 0.5:
                out[own] = ~out[own]
        return out
    if cluster is not None:
        names = list(dict.fromkeys(cluster))
        label = rng.permutation([bool(second[cluster == c][0]) for c in names])
        return np.array([dict(zip(names, label, strict=True))[c] for c in cluster], bool)
    return rng.permutation(second)


def test_sequence_group_difference(data, design: ComparisonDesign, metric="sequence_length", n_permutations=999, alternative="two.sided", seed=1, **more) -> InferenceResult:
    """The difference of unit means between two groups and its permutation p, (1 + extreme) / (n + 1)."""
    if alternative not in ("two.sided", "greater", "less"):
        raise ValidationError("alternative must be two.sided, greater or less")
    units = unit_table(data, design, metric, **more)
    rows = units.orderBy("group", "unit").toPandas()  # one value per unit of the design
    groups = sorted(rows["group"].unique())
    if len(groups) != 2:
        raise ValidationError("exactly two groups are compared")
    value, second = rows["metric"].to_numpy(float), (rows["group"] == groups[1]).to_numpy()
    pair = rows["pair"].to_numpy() if "pair" in rows else None
    cluster = rows["cluster"].to_numpy() if "cluster" in rows else None
    rng = np.random.default_rng(seed)
    observed = _difference(value, second)
    null = np.array([_difference(value, _permute(second, pair, cluster, rng)) for _ in range(n_permutations)])
    extreme = {"two.sided": np.abs(null) >= abs(observed) - 1e-12, "greater": null >= observed - 1e-12, "less": null <= observed + 1e-12}[alternative]
    p = (1 + int(extreme.sum())) / (n_permutations + 1)
    estimate = data.sparkSession.createDataFrame(
        [(groups[0], groups[1], float(value[~second].mean()), float(value[second].mean()), observed, p, alternative, n_permutations)],
        "group_1 string, group_2 string, mean_group_1 double, mean_group_2 double, difference_group_2_minus_group_1 double, p_value double, alternative string, n_permutations long",
    )
    return InferenceResult(estimate, units, null, (groups[0], groups[1]))


test_sequence_group_difference.__test__ = False


def bootstrap_sequence_group_difference(x: InferenceResult, n_boot=999, level=0.95, seed=1) -> InferenceResult:
    """An interval from units resampled within groups, at the (n + 1) p quantiles."""
    rows = x.units.orderBy("group", "unit").toPandas()
    parts = [rows.loc[rows["group"] == g, "metric"].to_numpy(float) for g in x.groups]
    rng = np.random.default_rng(seed)
    boot = np.array([float(rng.choice(parts[1], len(parts[1])).mean() - rng.choice(parts[0], len(parts[0])).mean()) for _ in range(n_boot)])
    low, high = (quantile_weibull(boot, q) for q in ((1 - level) / 2, 1 - (1 - level) / 2))
    interval = x.units.sparkSession.createDataFrame([(float(level), low, high, n_boot, seed)], "level double, lower double, upper double, n_boot long, seed long")
    return replace(x, interval=interval, boot=boot)


def summarise_sequence_group_inference(x: InferenceResult) -> dict[str, DataFrame | None]:
    return {"estimate": x.estimate, "interval": x.interval, "groups": x.units.groupBy("group").agg(F.count(F.lit(1)).alias("n_units"), F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("sd"))}


def plot_sequence_group_inference(x: InferenceResult, type="permutation", bins=30) -> DataFrame:
    if type == "group_means":
        return x.units.groupBy("group").agg(F.avg("metric").alias("mean"))
    counts, edges = np.histogram(x.permuted, bins=bins)
    return x.units.sparkSession.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(edges[:-1], edges[1:], counts, strict=True)], "low double, high double, n long")
