"""Pairwise distances of sequences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import arrays, by_sequence, canonical, levels, ratio

METHODS = ("levenshtein", "lcs", "optimal_matching", "transition")


@dataclass(frozen=True)
class DistanceResult:
    """Pairs (sequence_id_1 < sequence_id_2, distance) and the sequences."""

    pairs: DataFrame
    sequences: DataFrame
    method: str
    #: sequence_id and ``like``, the first sequence with the same path, where equal paths are at distance 0.
    twins: DataFrame | None = None
    #: With twins: like_1 <= like_2, size_1, size_2 (sequences) and distance of distinct paths, and of each path with itself.
    between: DataFrame | None = None

    def grouped(self) -> tuple[DataFrame, DataFrame]:
        """twins, and between with ``w``, the pairs that a row stands for; without twins, each sequence is its own."""
        if self.twins is None or self.between is None:
            one = F.lit(1).cast("long")
            ids = self.sequences.select("sequence_id", F.col("sequence_id").alias("like"))
            return ids, self.pairs.select(F.col("sequence_id_1").alias("like_1"), F.col("sequence_id_2").alias("like_2"), one.alias("size_1"), one.alias("size_2"), "distance", one.alias("w"))
        a, b = F.col("size_1"), F.col("size_2")
        return self.twins, self.between.withColumn("w", F.when(F.col("like_1") == F.col("like_2"), F.expr("size_1 * (size_1 - 1) div 2")).otherwise(a * b)).where("w > 0")


def edit_distance(a: list[str], b: list[str], indel: float, substitution) -> float:
    """Least cost of turning a into b; equal states cost nothing. ``substitution`` maps a pair to its cost."""
    n = len(b)
    row = np.arange(n + 1) * indel
    offset = np.arange(n + 1) * indel
    for i, x in enumerate(a, 1):
        cost = np.array([0.0 if x == y else substitution(x, y) for y in b])
        best = np.empty(n + 1)
        best[0] = i * indel
        best[1:] = np.minimum(row[1:] + indel, row[:-1] + cost)
        row = np.minimum.accumulate(best - offset) + offset
    return float(row[-1])


def lcs_length(a: list[str], b: list[str]) -> int:
    return int((len(a) + len(b) - edit_distance(a, b, 1, lambda x, y: 2.0)) // 2)


def _letters(n: int) -> list[str]:
    """Distinct single characters for an alphabet: visible ASCII first, then other scripts."""
    return [chr(c) for r in (range(48, 127), range(0x4E00, 0xD800), range(0x10000, 0x110000)) for c in r[:n]][:n]


def _check_matrix(matrix: pd.DataFrame, names: list[str]) -> None:
    values = matrix.to_numpy(float)
    if list(matrix.index) != list(matrix.columns) or set(names) - set(matrix.index):
        raise ValidationError("the substitution matrix must be labelled alike and cover all states")
    if not np.isfinite(values).all() or (values < 0).any() or np.abs(values - values.T).max() > 1.49e-8 or np.abs(np.diag(values)).max() > 1.49e-8:
        raise ValidationError("the substitution matrix must be symmetric, not negative, and 0 on its diagonal")


def path_text(states: Column, names: list[str]) -> Column:
    """A state array as a string of one character a state."""
    code = F.create_map(*[F.lit(x) for kv in zip(names, _letters(len(names)), strict=True) for x in kv])
    return F.array_join(F.transform(states, lambda s: F.element_at(code, s)), "")


def text_distance(x: Column, y: Column, names: list[str], method: str, indel_cost=1.0, substitution_cost=1.0, substitution_matrix: pd.DataFrame | None = None) -> Column:
    """The distance of two paths as text (methods but 'transition')."""
    if method == "levenshtein":
        return F.levenshtein(x, y).cast("double")
    if method == "lcs":
        indel_cost, substitution_cost, substitution_matrix = 1.0, 2.0, None
    if substitution_matrix is not None:
        _check_matrix(substitution_matrix, names)
        table = substitution_matrix.loc[names, names].to_numpy(float)
    else:
        table = np.full((len(names), len(names)), float(substitution_cost))
    table = np.where(np.eye(len(names), dtype=bool), 0.0, table)
    indel, at, seen = float(indel_cost), {c: k for k, c in enumerate(_letters(len(names)))}, {}

    def measure(a: str, b: str) -> float:
        if (a, b) not in seen:  # equal paths meet again and again
            if len(seen) >= 100_000:
                seen.clear()
            own = np.array([at[c] for c in b], int)
            row = offset = np.arange(len(b) + 1) * indel
            for i, c in enumerate(a, 1):
                best = np.append(i * indel, np.minimum(row[1:] + indel, row[:-1] + table[at[c]][own]))
                row = np.minimum.accumulate(best - offset) + offset
            seen[a, b] = float(row[-1])
        return seen[a, b]

    @F.pandas_udf("double")
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measure(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return kernel(F.least(x, y), F.greatest(x, y))


def pair_distance(states_1, states_2, names: list[str], method: str, indel_cost=1.0, substitution_cost=1.0, substitution_matrix: pd.DataFrame | None = None):
    """The distance of two state arrays as a column (methods but 'transition')."""
    return text_distance(path_text(states_1, names), path_text(states_2, names), names, method, indel_cost, substitution_cost, substitution_matrix)


def dealt(items: DataFrame, key: str, n: int, *more: str) -> tuple[DataFrame, int]:
    """``items`` with ``block`` by the hash of ``key``, grouped by it and ``more``, and the number of blocks for ``n`` rows."""
    count = max(1, -(-n // max(64, min(n // 48, 2048))))
    return items.groupBy(F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("block"), *more), count


def grid(packed: DataFrame, count: int) -> DataFrame:
    """x and y of all pairs of the items in ``all`` of ``count`` blocks, in one order; ``same`` where both are of one block and so come in both.

    Each pair of blocks is one row of a task until it is exploded.
    """
    tasks = min(count * (count + 1) // 2, 8 * packed.sparkSession.sparkContext.defaultParallelism)
    one = packed.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(count - 1))).alias("j"), F.col("all").alias("a")).repartition(tasks, "i", "j")
    two = packed.select(F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("all").alias("b")).repartition(tasks, "i", "j")
    both = one.join(two.hint("shuffle_hash"), ["i", "j"]).select((F.col("i") == F.col("j")).alias("same"), F.explode("a").alias("x"), "b")
    return both.select("same", "x", F.explode("b").alias("y"))


def all_pairs(held: DataFrame, distance: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, twins, between) of sequence_id, path and f, by the distance of two f; f is a function of path, and equal paths are at distance 0.

    Pairs are made where the distances are, from blocks of ids by path, so no table of pairs is exchanged. Distances of
    distinct paths with their numbers of sequences say all but the ids, and whoever sums up reads those.
    """
    n, k = held.agg(F.count(F.lit(1)), F.count_distinct("path")).first()
    paths = held.groupBy("path").agg(F.min("sequence_id").alias("like"), F.count(F.lit(1)).alias("size"), F.first("f").alias("f"))
    x, y = F.col("x"), F.col("y")
    blocks, count = dealt(paths, "like", k)
    met = grid(blocks.agg(F.collect_list(F.struct("like", "size", "f")).alias("all")), count).where(~F.col("same") | (x["like"] <= y["like"]))
    first = x["like"] <= y["like"]
    between = met.select(
        F.least(x["like"], y["like"]).alias("like_1"), F.greatest(x["like"], y["like"]).alias("like_2"), F.when(first, x["size"]).otherwise(y["size"]).alias("size_1"),
        F.when(first, y["size"]).otherwise(x["size"]).alias("size_2"), distance(x["f"], y["f"]).alias("distance"),
    )
    twins = held.select("sequence_id", "path").join(paths.select("path", "like"), "path").select("sequence_id", "like")
    # the ids of a block and path are one item: dealt by id, so that a common path is in all blocks
    blocks, count = dealt(held, "sequence_id", n, "path")
    own = blocks.agg(F.first("f").alias("f"), F.collect_list("sequence_id").alias("ids")).groupBy("block").agg(F.collect_list(F.struct("f", "ids")).alias("all"))
    met = grid(own, count).select("same", x["ids"].alias("ids_1"), y["ids"].alias("ids_2"), distance(x["f"], y["f"]).alias("distance"))
    one, two = F.col("id_1"), F.col("id_2")
    met = met.select("same", F.explode("ids_1").alias("id_1"), "ids_2", "distance").select("same", "id_1", F.explode("ids_2").alias("id_2"), "distance").where(~F.col("same") | (one < two))
    return met.select(F.least(one, two).alias("sequence_id_1"), F.greatest(one, two).alias("sequence_id_2"), "distance"), twins, between


def transition_profiles(df: DataFrame, names: list[str], smoothing: float = 0.0) -> DataFrame:
    """sequence_id, from_state, to_state, p: row-normalised transitions; smoothing covers all cells."""
    pairs = df.select("sequence_id", F.col("state").alias("from_state"), F.lead("state").over(by_sequence()).alias("to_state")).where("to_state is not null")
    counts = pairs.groupBy("sequence_id", "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    if smoothing > 0:
        level = df.sparkSession.createDataFrame([(s,) for s in names], "s string")
        cells = level.select(F.col("s").alias("from_state")).crossJoin(level.select(F.col("s").alias("to_state")))
        full = df.select("sequence_id").distinct().crossJoin(F.broadcast(cells))
        counts = full.join(counts, ["sequence_id", "from_state", "to_state"], "left").select("sequence_id", "from_state", "to_state", (F.coalesce("n", F.lit(0)) + float(smoothing)).alias("n"))
    total = counts.groupBy("sequence_id", "from_state").agg(F.sum("n").alias("t"))
    return counts.join(total, ["sequence_id", "from_state"]).select("sequence_id", "from_state", "to_state", ratio(F.col("n"), F.col("t")).alias("p"))


def compute_sequence_distance(
    data, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", method="levenshtein", indel_cost=1, substitution_cost=1, substitution_matrix=None,
    transition_smoothing=0, normalise="none", row_col=None,
) -> DistanceResult:
    """All pairs of sequences. Equal paths are measured once in a pair of blocks, then spread over the ids.

    The number of pairs is quadratic by definition of the operator; blocks of sequences are paired over all
    tasks, and edit kernels run in the JVM or on Arrow batches.
    """
    if method not in METHODS or normalise not in ("none", "max_length", "path_length"):
        raise ValidationError(f"method must be one of {METHODS}; normalise none, max_length or path_length")
    df = canonical(data, sequence_id_col, order_col, state_col, None, None, row_col)
    names = levels(df)
    held = arrays(df).select("sequence_id", path_text(F.col("states"), names).alias("path"))
    if method == "transition":
        first = held.groupBy("path").agg(F.min("sequence_id").alias("sequence_id"))
        p = transition_profiles(df.join(first, "sequence_id", "left_semi"), names, transition_smoothing)
        cells = p.groupBy("sequence_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", "from_state", "to_state").alias("k"), "p"))).alias("profile"))
        profiles = first.join(cells, "sequence_id", "left").select("path", F.coalesce("profile", F.create_map().cast("map<string,double>")).alias("profile"))
        held = held.join(profiles, "path").select("sequence_id", "path", F.struct(F.length("path").alias("n"), F.col("profile").alias("v")).alias("f"))
    else:
        held = held.select("sequence_id", "path", F.struct(F.length("path").alias("n"), F.col("path").alias("v")).alias("f"))

    def measure(x: Column, y: Column) -> Column:
        if method == "transition":
            keys = F.array_distinct(F.concat(F.map_keys(x["v"]), F.map_keys(y["v"])))
            at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
            d = F.sqrt(F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.pow(at(x["v"], k) - at(y["v"], k), F.lit(2.0))))
        else:
            d = text_distance(x["v"], y["v"], names, method, indel_cost, substitution_cost, substitution_matrix)
        return ratio(d, {"none": F.lit(1), "max_length": F.greatest(x["n"], y["n"]), "path_length": x["n"] + y["n"]}[normalise])

    pairs, twins, between = all_pairs(held, measure)
    return DistanceResult(pairs, held.select("sequence_id"), method, twins, between)


def symmetric(pairs: DataFrame) -> DataFrame:
    """sequence_id, other, distance in both directions."""
    a = pairs.select(F.col("sequence_id_1").alias("sequence_id"), F.col("sequence_id_2").alias("other"), "distance")
    return a.union(pairs.select(F.col("sequence_id_2"), F.col("sequence_id_1"), "distance"))


def both_ways(between: DataFrame) -> DataFrame:
    """like, other, distance and ``w``, the sequences of ``other`` that each of ``like`` has a distance to."""
    a = between.select(F.col("like_1").alias("like"), F.col("like_2").alias("other"), "distance", F.when(F.col("like_1") == F.col("like_2"), F.col("size_2") - 1).otherwise(F.col("size_2")).alias("w"))
    return a.union(between.where("like_1 != like_2").select("like_2", "like_1", "distance", "size_1")).where("w > 0")


def weighted_mean(value: str, *weights: str) -> Column:
    w = F.when(F.col(value).isNotNull(), F.col(weights[0]) if len(weights) == 1 else F.col(weights[0]) * F.col(weights[1]))
    return ratio(F.sum(F.col(value) * w), F.sum(w))


def summarise_sequence_distance(x: DistanceResult) -> tuple[DataFrame, DataFrame]:
    """(overall, per sequence): mean, median, least and greatest distance."""
    measures = [weighted_mean("distance", "w").alias("mean_distance"), F.percentile("distance", F.lit(0.5), F.col("w")).alias("median_distance"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance")]
    twins, between = x.grouped()
    size = x.sequences.agg(F.count(F.lit(1)).alias("n_sequences"))
    overall = between.agg(F.coalesce(F.sum("w"), F.lit(0).cast("long")).alias("n_pairs"), *measures).crossJoin(size).select("n_sequences", "n_pairs", "mean_distance", "median_distance", "min_distance", "max_distance")
    per = both_ways(between).groupBy("like").agg(*measures)
    return overall, twins.join(per, "like").select("sequence_id", *per.columns[1:])


def plot_sequence_distance_heatmap(x: DistanceResult, order_by: DataFrame | None = None) -> DataFrame:
    """All cells of the matrix with row and column ranks, by cluster (if given) and id."""
    from pyspark.sql import Window

    ids = x.sequences if order_by is None else x.sequences.join(order_by.select("sequence_id", "cluster"), "sequence_id")
    order = ["sequence_id"] if order_by is None else ["cluster", "sequence_id"]
    ranked = ids.select("sequence_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))
    # the ranks are as many as the square root of the cells, so each task has them all
    one, two = (F.broadcast(ranked.select(F.col("sequence_id").alias(f"sequence_id_{k}"), F.col("rank").alias(f"r{k}"))) for k in (1, 2))
    pairs = x.pairs.join(one, "sequence_id_1").join(two, "sequence_id_2")
    cell = lambda a, b: F.struct(F.col(f"sequence_id_{a}").alias("sequence_id"), F.col(f"sequence_id_{b}").alias("other"), F.col(f"r{a}").alias("rank"), F.col(f"r{b}").alias("other_rank"), "distance")
    return pairs.select(F.inline(F.array(cell(1, 2), cell(2, 1)))).union(ranked.select("sequence_id", F.col("sequence_id"), "rank", F.col("rank"), F.lit(0.0)))
