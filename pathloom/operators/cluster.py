"""Clustering of sequences by their distances, validation, stability and ensembles.

Clustering works on one dense matrix of distinct paths, each weighted by its sequences, so the operator
is for as many paths as the driver can hold pairs of; DENSE bounds them. Sequences have no such bound:
the driver holds an id and a number of each. Assessment is relational, by distinct paths too.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import ratio
from .distance import DistanceResult, all_pairs, both_ways, weighted_mean

#: The most distinct paths that are clustered as one matrix on the driver.
DENSE = 10_000
LINKAGES = ("ward.D", "ward.D2", "single", "complete", "average", "mcquitty", "median", "centroid")


@dataclass(frozen=True)
class Clustering:
    """assignments: sequence_id, cluster."""

    assignments: DataFrame
    medoids: tuple[str, ...]
    merges: tuple[tuple[int, int, float], ...]
    distance: DistanceResult
    method: str


@dataclass(frozen=True)
class Matrix:
    """Distances of distinct paths, and the ids and paths of the sequences by id."""

    likes: list[str]
    d: np.ndarray
    ids: pa.ChunkedArray
    own: np.ndarray


def dense(x: DistanceResult) -> Matrix:
    twins, between = x.grouped()
    likes = sorted(r[0] for r in twins.select("like").distinct().limit(DENSE + 1).collect())
    if len(likes) > DENSE:
        raise ValidationError(f"more than {DENSE} different sequences; cluster a sample and assign the rest by its medoids")
    codes = x.sequences.sparkSession.createDataFrame(list(enumerate(likes)), "k int, like string")
    one, two = (codes.select(F.col("k").alias(f"k{i}"), F.col("like").alias(f"like_{i}")) for i in (1, 2))
    pairs = between.where("like_1 != like_2").join(F.broadcast(one), "like_1").join(F.broadcast(two), "like_2").select("k1", "k2", "distance").toArrow()
    d = np.zeros((len(likes), len(likes)))
    i, j = pairs["k1"].to_numpy(), pairs["k2"].to_numpy()
    d[i, j] = d[j, i] = pairs["distance"].to_numpy()
    rows = twins.join(F.broadcast(codes), "like").select("sequence_id", "k").orderBy("sequence_id").toArrow()
    return Matrix(likes, d, rows["sequence_id"], rows["k"].to_numpy())


def lance_williams(d: np.ndarray, linkage: str, members: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (i, j, height) by the least (distance, i, j); a merged cluster keeps index i < j.

    ward.D, median and centroid take the distances as they are, ward.D2 squares them.
    """
    d = d.astype(float) ** 2 if linkage == "ward.D2" else d.astype(float).copy()
    n = len(d)
    size = np.ones(n) if members is None else np.asarray(members, float).copy()
    alive, before = np.ones(n, bool), np.triu(np.ones((n, n), bool), 1)
    np.fill_diagonal(d, np.inf)
    out = []
    for _ in range(n - 1):
        upper = np.where(alive[:, None] & alive[None, :] & before, d, np.inf)
        i, j = divmod(int(upper.argmin()), n)
        h = d[i, j]
        out.append((i, j, float(np.sqrt(h) if linkage == "ward.D2" else h)))
        a, b = size[i], size[j]
        x, y = d[i], d[j]
        if linkage in ("ward.D", "ward.D2"):
            new = ((a + size) * x + (b + size) * y - size * h) / (a + b + size)
        elif linkage == "single":
            new = np.minimum(x, y)
        elif linkage == "complete":
            new = np.maximum(x, y)
        elif linkage == "average":
            new = (a * x + b * y) / (a + b)
        elif linkage == "mcquitty":
            new = (x + y) / 2
        elif linkage == "median":
            new = (x + y) / 2 - h / 4
        else:  # centroid
            new = (a * x + b * y) / (a + b) - a * b * h / (a + b) ** 2
        alive[j] = False
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        size[i] = a + b
    return out


def cut_merges(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels 1..k after n - k merges, numbered by each cluster's first member."""
    label = np.arange(n)
    for i, j, _ in merges[: n - k]:
        label[label == label[j]] = label[i]
    first = {c: m for m, c in enumerate(dict.fromkeys(label.tolist()), 1)}
    return np.array([first[c] for c in label.tolist()])


def pam(d: np.ndarray, k: int, members: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Build and swap; labels are numbered by medoid index. Returns labels and medoids."""
    size = np.ones(len(d)) if members is None else np.asarray(members, float)
    medoids = [int((d * size).sum(axis=1).argmin())]
    while len(medoids) < k:
        near = d[:, medoids].min(axis=1)
        gain = (np.maximum(near[None, :] - d, 0) * size).sum(axis=1)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
    cost = (d[:, medoids].min(axis=1) * size).sum()
    while True:
        best = (cost - 1e-12, None)
        for p in range(k):
            rest = d[:, [m for q, m in enumerate(medoids) if q != p]].min(axis=1) if k > 1 else np.full(len(d), np.inf)
            total = (np.minimum(rest[None, :], d) * size).sum(axis=1)
            total[medoids] = np.inf
            h = int(total.argmin())
            if total[h] < best[0]:
                best = (total[h], (p, h))
        if best[1] is None:
            break
        medoids[best[1][0]], cost = best[1][1], best[0]
    medoids = np.array(sorted(medoids))
    return d[:, medoids].argmin(axis=1) + 1, medoids


def _medoids(d: np.ndarray, label: np.ndarray, size: np.ndarray) -> list[int]:
    """Of each cluster the member of least total distance, in exact arithmetic; ties to the first."""
    out = []
    for c in range(1, label.max() + 1):
        own = np.flatnonzero(label == c)
        totals = d[np.ix_(own, own)] @ size[own]
        close = [i for i, t in zip(own, totals, strict=True) if t <= totals.min() * (1 + 1e-12) + 1e-12]
        out.append(min(close, key=lambda i: (sum(Fraction(float(v)) * int(w) for v, w in zip(d[i, own], size[own], strict=True)), i)) if len(close) > 1 else int(close[0]))
    return [int(i) for i in out]


def _pam(d: np.ndarray, own: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """PAM of weighted paths: labels and medoids of the sequences. A second medoid of a path has no gain until all paths are medoids."""
    if k <= len(d):
        label, m = pam(d, k, np.bincount(own))
        return label[own], first[m].tolist()
    more = np.setdiff1d(np.arange(k), first)[: k - len(first)]
    m = np.sort(np.concatenate([first, more]))
    return np.searchsorted(m, first)[own] + 1, m.tolist()


def solve(d: np.ndarray, k: int, method: str = "hierarchical", linkage: str = "average", seed: int = 1, own: np.ndarray | None = None, samples: int = 5, sampsize: int | None = None) -> tuple[np.ndarray, list[int], list]:
    """Labels, medoids and merges of sequences whose paths are ``own``, rows of d (by default each row is a sequence).

    The same as for a matrix of all sequences: those of a path are at distance 0, so they merge before any others, in order.
    """
    own = np.arange(len(d)) if own is None else np.asarray(own)
    n = len(own)
    if not 2 <= k < n:
        raise ValidationError("k must be at least 2 and less than the number of sequences")
    paths, first, own = np.unique(own, return_index=True, return_inverse=True)
    order = np.argsort(first)  # paths by their first sequences, which break ties
    first, own, d = first[order], np.argsort(order)[own], d[np.ix_(paths[order], paths[order])]
    if method == "pam":
        return *_pam(d, own, first, k), []
    if method == "clara":
        rng, best = np.random.default_rng(seed), (np.inf, None)
        weight = np.bincount(own)
        for _ in range(samples):
            drawn = np.sort(rng.choice(n, sampsize or min(n, max(40 + 2 * k, k + 1)), replace=False))
            _, m, _ = solve(d, k, "pam", own=own[drawn]) if k < len(drawn) else (None, list(range(k)), None)
            cost = (d[:, own[drawn[m]]].min(axis=1) * weight).sum()
            if cost < best[0]:
                best = (cost, np.sort(drawn[m]))
        return (d[:, own[best[1]]].argmin(axis=1) + 1)[own], best[1].tolist(), []
    if method != "hierarchical" or linkage not in LINKAGES:
        raise ValidationError(f"method is hierarchical, pam or clara; linkage one of {LINKAGES}")
    size = np.bincount(own)
    alike = np.setdiff1d(np.arange(n), first)
    alike = alike[np.lexsort((alike, own[alike]))]
    zero = list(zip(first[own[alike]].tolist(), alike.tolist(), [0.0] * len(alike), strict=True))
    grown = d
    if linkage in ("ward.D", "ward.D2"):  # what the merges within paths make of them
        a = 2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :])
        grown = d * (a if linkage == "ward.D" else np.sqrt(a))
    merges = lance_williams(grown, linkage, size)
    if k >= len(d):
        root = np.arange(n)
        for i, j, _ in zero[: n - k]:
            root[j] = i
        medoids, label = np.unique(root, return_inverse=True)
        label, medoids = label + 1, medoids.tolist()
    else:
        by_path = cut_merges(merges, len(d), k)
        label, medoids = by_path[own], first[_medoids(d, by_path, size)].tolist()
    return label, medoids, zero + [(int(first[i]), int(first[j]), h) for i, j, h in merges]


def _assigned(x: DistanceResult, m: Matrix, label: np.ndarray) -> DataFrame:
    """sequence_id and cluster; by path, unless a path is split."""
    spark, at = x.sequences.sparkSession, np.unique(m.own, return_index=True)[1]
    if (label[at][m.own] == label).all():
        rows = [(s, int(c)) for s, c in zip(m.likes, label[at], strict=True)]
        return x.grouped()[0].join(F.broadcast(spark.createDataFrame(rows, "like string, cluster long")), "like").select("sequence_id", "cluster")
    return spark.createDataFrame(pa.table({"sequence_id": m.ids, "cluster": label.astype(np.int64)}))


def cluster_sequences(distance: DistanceResult, k: int, method="hierarchical", linkage="average", seed=1, **more) -> Clustering:
    m = dense(distance)
    label, medoids, merges = solve(m.d, k, method, linkage, seed, m.own, **more)
    return Clustering(_assigned(distance, m, label), tuple(m.ids[i].as_py() for i in medoids), tuple(merges), distance, method)


@dataclass(frozen=True)
class ClusterValidation:
    overall: DataFrame
    cluster_sizes: DataFrame
    per_sequence: DataFrame


def _cells(x: DistanceResult, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequences with their path, and both directions of pairs of (path, cluster): distance, ``size`` of one side, ``w`` of the other for each of it."""
    twins, between = x.grouped()
    own = a.join(twins, "sequence_id").select("sequence_id", "like", "cluster")
    cells = own.groupBy("like", "cluster").agg(F.count(F.lit(1)).alias("size"))
    split = both_ways(between).select("like", "other", "distance")
    both = split.join(cells, "like").join(cells.select(F.col("like").alias("other"), F.col("cluster").alias("other_cluster"), F.col("size").alias("s")), "other")
    same = (F.col("like") == F.col("other")) & (F.col("cluster") == F.col("other_cluster"))
    return own, both.withColumn("w", F.when(same, F.col("s") - 1).otherwise(F.col("s"))).where("w > 0")


def validate_sequence_clusters(clustering: Clustering, distance: DistanceResult | None = None) -> ClusterValidation:
    """Silhouettes, Dunn index, within to between ratio and sizes; a sequence alone has silhouette 0."""
    x, a = distance or clustering.distance, clustering.assignments
    member, both = _cells(x, a)
    means = both.groupBy("like", "cluster", "other_cluster").agg(weighted_mean("distance", "w").alias("m"))
    nearest = F.min(F.when(F.col("cluster") != F.col("other_cluster"), F.col("m"))).alias("b")
    near = means.groupBy("like", "cluster").agg(F.max(F.when(F.col("cluster") == F.col("other_cluster"), F.col("m"))).alias("a"), nearest)
    score = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.when(F.greatest("a", "b") > 0, F.greatest("a", "b")), F.lit(0.0)))
    per = member.join(near, ["like", "cluster"], "left").select("sequence_id", "cluster", score.alias("silhouette"))
    sizes = a.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    within, between = F.col("cluster") == F.col("other_cluster"), F.col("cluster") != F.col("other_cluster")
    spread = both.withColumns({"near": F.when(within, F.col("distance")), "far": F.when(between, F.col("distance"))}).agg(
        ratio(F.min("far"), F.max("near")).alias("dunn_index"),
        ratio(weighted_mean("near", "w", "size"), weighted_mean("far", "w", "size")).alias("within_between_ratio"),
    )
    whole = per.agg(F.count(F.lit(1)).alias("n_sequences"), F.countDistinct("cluster").alias("n_clusters"), F.avg("silhouette").alias("average_silhouette"), F.min("silhouette").alias("minimum_silhouette"))
    overall = whole.crossJoin(spread).crossJoin(sizes.agg(F.count_if(F.col("size") == 1).alias("singleton_clusters")))
    return ClusterValidation(overall, sizes, per)


def extract_representative_sequences(clustering: Clustering, distance: DistanceResult | None = None, n_per_cluster=1) -> DataFrame:
    """The sequences of each cluster nearest to the others in it, ties by id."""
    member, both = _cells(distance or clustering.distance, clustering.assignments)
    within = both.where("cluster = other_cluster").groupBy("like", "cluster").agg(weighted_mean("distance", "w").alias("m"))
    means = member.join(within, ["like", "cluster"], "left").select("sequence_id", "cluster", F.coalesce("m", F.lit(0.0)).alias("mean_within_distance"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("mean_within_distance", "sequence_id")).cast("long")
    return means.withColumn("rank", rank).where(F.col("rank") <= n_per_cluster).select("cluster", "rank", "sequence_id", "mean_within_distance")


def plot_sequence_cluster_silhouette(clustering: Clustering, distance: DistanceResult | None = None) -> DataFrame:
    per = validate_sequence_clusters(clustering, distance).per_sequence
    return per.withColumn("plot_rank", F.row_number().over(Window.orderBy("cluster", F.col("silhouette").desc(), "sequence_id")).cast("long"))


@dataclass(frozen=True)
class ClusterBootstrap:
    """pairs: sequence_id_1, sequence_id_2, evaluated, stability. within: of the pairs of each cluster."""

    iterations: DataFrame
    overall: DataFrame
    pairs: DataFrame
    clustering: Clustering
    within: DataFrame


def _stability(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of two blocks of (label, labels found or 0 in each replicate): how often both were drawn, and agreed with the whole."""
    (la, fa), (lb, fb) = a, b
    ev = (fa > 0).astype(np.float32) @ (fb > 0).astype(np.float32).T
    together = sum((fa == c).astype(np.float32) @ (fb == c).astype(np.float32).T for c in range(1, k + 1))
    return ev, np.where(la[:, None] == lb[None, :], together, ev - together)


def bootstrap_sequence_clusters(distance: DistanceResult, k: int, method="hierarchical", n_boot=100, sample_fraction=0.8, seed=1, linkage="average", **more) -> ClusterBootstrap:
    """How often pairs agree with the whole solution when subsamples are clustered. Replicates run as tasks on a broadcast matrix.

    Sequences with the same labels in all replicates are alike, so sums over pairs are taken over pairs of the different ones, in blocks.
    """
    spark = distance.sequences.sparkSession
    x = dense(distance)
    label, medoids, merges = solve(x.d, k, method, linkage, seed, x.own, **more)
    n = len(x.own)
    size, rng = max(k + 1, int(n * sample_fraction)), np.random.default_rng(seed)
    drawn = np.zeros((n_boot, -(-n // 8)), np.uint8)
    for b in range(n_boot):
        some = np.zeros(n, bool)
        some[rng.choice(n, size, replace=False)] = True
        drawn[b] = np.packbits(some)
    held, kind = spark.sparkContext.broadcast((x.d, x.own, drawn)), np.min_scalar_type(k)

    def solved(batches):
        d, own, drawn = held.value
        for pdf in batches:
            for b in pdf["id"]:
                at = np.flatnonzero(np.unpackbits(drawn[b], count=n))
                found = np.zeros(n, kind)
                found[at] = solve(d, k, method, linkage, seed, own[at], **more)[0]
                yield pd.DataFrame({"b": [b], "found": [found.tobytes()]})

    rows = spark.range(0, n_boot, 1, min(n_boot, 64)).mapInPandas(solved, "b long, found binary").collect()
    found = np.stack([np.frombuffer(r["found"], kind) for r in sorted(rows)], axis=1)
    label = label.astype(kind)
    alike, count = np.unique(np.column_stack([label, found]), axis=0, return_counts=True)
    cells, members = spark.sparkContext.broadcast((alike, count)), spark.sparkContext.broadcast((label, found, x.ids.combine_chunks()))

    def summed(batches):
        alike, count = cells.value
        for pdf in batches:
            for i, j in zip(pdf["i"], pdf["j"], strict=True):
                a, b = slice(i * 1024, (i + 1) * 1024), slice(j * 1024, (j + 1) * 1024)
                ev, agree = _stability((alike[a, 0], alike[a, 1:]), (alike[b, 0], alike[b, 1:]), k)
                w = count[a][:, None] * count[b][None, :]
                if i == j:
                    w = np.triu(w, 1) + np.diag(count[a] * (count[a] - 1) // 2)
                cluster = np.where(alike[a, 0][:, None] == alike[b, 0][None, :], alike[a, 0][:, None], 0)
                use = (ev > 0) & (w > 0)
                cluster, w, s = cluster[use], w[use], agree[use].astype(float) / ev[use]
                yield pd.DataFrame([(int(c), float((s * w)[own].sum()), float(s[own].min()), int(w[own].sum())) for c in np.unique(cluster) for own in [cluster == c]], columns=["cluster", "total", "least", "n"])

    def listed(batches):
        label, found, ids = members.value
        for pdf in batches:
            for i, j in zip(pdf["i"], pdf["j"], strict=True):
                a, b = slice(i * 512, (i + 1) * 512), slice(j * 512, (j + 1) * 512)
                ev, agree = _stability((label[a], found[a]), (label[b], found[b]), k)
                p, q = np.nonzero(np.triu(ev, 1) if i == j else ev)
                one, two = ids[i * 512 : (i + 1) * 512].to_numpy(zero_copy_only=False), ids[j * 512 : (j + 1) * 512].to_numpy(zero_copy_only=False)
                yield pd.DataFrame({"sequence_id_1": one[p], "sequence_id_2": two[q], "evaluated": ev[p, q].astype(int), "stability": agree[p, q].astype(float) / ev[p, q]})

    def each(m: int, size: int) -> DataFrame:
        blocks = spark.range(-(-m // size))
        both = blocks.withColumnRenamed("id", "i").crossJoin(blocks.withColumnRenamed("id", "j")).where("i <= j")
        return both.repartition(8 * spark.sparkContext.defaultParallelism) if m > size else both

    sums = each(len(alike), 1024).mapInPandas(summed, "cluster long, total double, least double, n long")
    measures = lambda a, b: (ratio(F.sum("total"), F.sum("n")).alias(a), F.min("least").alias(b))
    overall = sums.agg(F.lit(n_boot).cast("long").alias("n_boot"), F.lit(float(sample_fraction)).alias("sample_fraction"), *measures("mean_pairwise_stability", "min_pairwise_stability"))
    within = sums.where("cluster > 0").groupBy("cluster").agg(*measures("mean_within_stability", "min_within_stability"), F.sum("n").alias("n_evaluated_pairs"))
    pairs = each(n, 512).mapInPandas(listed, "sequence_id_1 string, sequence_id_2 string, evaluated long, stability double")
    iterations = spark.createDataFrame([(b + 1, size) for b in range(n_boot)], "iteration long, n_sampled long")
    whole = Clustering(_assigned(distance, x, label), tuple(x.ids[i].as_py() for i in medoids), tuple(merges), distance, method)
    return ClusterBootstrap(iterations, overall, pairs, whole, within)


def summarise_sequence_cluster_stability(x: ClusterBootstrap, threshold=0.8) -> tuple[DataFrame, DataFrame]:
    """(clusters, pairs below the threshold)."""
    a = x.clustering.assignments
    sizes = a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_sequences"))
    return sizes.join(x.within, "cluster", "left"), x.pairs.where(F.col("stability") < threshold).select("sequence_id_1", "sequence_id_2", "stability")


def create_sequence_cluster_ensemble(*solutions: Clustering, k: int, linkage="average") -> tuple[Clustering, DataFrame]:
    """A hierarchical clustering of one less the share of solutions in which pairs are together, and those shares."""
    if len(solutions) < 2:
        raise ValidationError("an ensemble needs two solutions")
    rows = solutions[0].assignments.select("sequence_id", F.col("cluster").alias("c0"))
    for i, s in enumerate(solutions[1:], 1):
        rows = rows.join(s.assignments.select("sequence_id", F.col("cluster").alias(f"c{i}")), "sequence_id", "left")
    labels = F.array(*[f"c{i}" for i in range(len(solutions))])
    # those with the same labels are alike; without a label in some solution, a sequence is not even like itself
    path = F.when(~F.exists(labels, F.isnull), F.array_join(labels, "|")).otherwise(F.concat(F.lit("!"), F.col("sequence_id")))
    share = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda s, v: s + v) / float(len(solutions))
    pairs, twins, between = all_pairs(rows.select("sequence_id", path.alias("path"), labels.alias("f")), lambda x, y: 1 - share(x, y))
    x = DistanceResult(pairs, rows.select("sequence_id"), "co_association", twins, between)
    shares = pairs.select("sequence_id_1", "sequence_id_2", (1 - F.col("distance")).alias("co_association"))
    return cluster_sequences(x, k, linkage=linkage), shares
