"""Clustering: linkages against brute force, medoids, and assessment."""

import itertools

import numpy as np
import pytest

from pathloom.operators import cluster
from pathloom.operators.distance import DistanceResult


def matrix(points):
    x = np.array(points, float)
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


POINTS = [(0, 0), (1, 0), (0, 1.2), (8, 8), (8, 9.1), (9.3, 8), (20, 0), (20.5, 1)]


@pytest.mark.parametrize("linkage", cluster.LINKAGES)
def test_separated_groups(linkage):
    d = matrix(POINTS)
    label = cluster.cut_merges(cluster.lance_williams(d, linkage), len(d), 3)
    assert label.tolist() == [1, 1, 1, 2, 2, 2, 3, 3]


@pytest.mark.parametrize("linkage,rule", [("single", np.min), ("complete", np.max), ("average", np.mean)])
def test_against_definition(linkage, rule):
    rng = np.random.default_rng(3)
    d = matrix(rng.normal(size=(9, 2)))
    groups = [{i} for i in range(9)]
    while len(groups) > 3:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: rule([d[i, j] for i in groups[p[0]] for j in groups[p[1]]]))
        groups[a] |= groups.pop(b)
    label = cluster.cut_merges(cluster.lance_williams(d, linkage), 9, 3)
    assert {frozenset(np.flatnonzero(label == c).tolist()) for c in (1, 2, 3)} == {frozenset(g) for g in groups}


def test_pam_finds_the_best_medoids():
    d = matrix(POINTS)
    _, found = cluster.pam(d, 3)
    best = min(itertools.combinations(range(8), 3), key=lambda m: d[:, m].min(axis=1).sum())
    assert d[:, found].min(axis=1).sum() == pytest.approx(d[:, list(best)].min(axis=1).sum())


def test_assessment(spark):
    d = matrix(POINTS)
    names = [f"s{i}" for i in range(8)]
    pairs = spark.createDataFrame([(names[i], names[j], float(d[i, j])) for i in range(8) for j in range(i + 1, 8)], "sequence_id_1 string, sequence_id_2 string, distance double")
    x = DistanceResult(pairs, spark.createDataFrame([(n,) for n in names], "sequence_id string"), "euclidean")
    c = cluster.cluster_sequences(x, 3, "pam")
    v = cluster.validate_sequence_clusters(c)
    label = np.array([1, 1, 1, 2, 2, 2, 3, 3])
    want = []
    for i in range(8):
        own = (label == label[i]) & (np.arange(8) != i)
        a, b = d[i, own].mean(), min(d[i, label == k].mean() for k in {1, 2, 3} - {label[i]})
        want.append((b - a) / max(a, b))
    got = {r["sequence_id"]: r["silhouette"] for r in v.per_sequence.collect()}
    assert [got[n] for n in names] == pytest.approx(want)
    assert v.overall.first()["singleton_clusters"] == 0
    boot = cluster.bootstrap_sequence_clusters(x, 3, n_boot=8)
    assert boot.overall.first()["mean_pairwise_stability"] > 0.9
    clusters, low = cluster.summarise_sequence_cluster_stability(boot)
    assert clusters.count() == 3 and low.count() >= 0
    merged, shares = cluster.create_sequence_cluster_ensemble(c, cluster.cluster_sequences(x, 3), k=3)
    assert {r["cluster"] for r in merged.assignments.collect()} == {1, 2, 3} and shares.count() == 28
    assert {r["sequence_id"] for r in cluster.extract_representative_sequences(c).collect()} <= set(names)


def test_cluster_queries_see_every_conversation(spark):
    from pathloom.plans import models
    from pathloom.sources import tables

    folder = "/root/testdata/sf0.01"
    ids = {str(r[0]) for r in tables.conversations(spark, folder).select("conv_id").distinct().collect()}
    assert {r["sequence_id"] for r in models._distances(spark, folder).sequences.collect()} == ids
    for name in ("cluster_hier", "cluster_clara", "silhouette_data"):
        assert {r["sequence_id"] for r in models.QUERIES[name](spark, folder).collect()} == ids


@pytest.mark.parametrize("method,linkage", [("pam", "average"), ("clara", "average"), *[("hierarchical", m) for m in cluster.LINKAGES]])
@pytest.mark.parametrize("k", [2, 3, 9])
def test_weighted_paths_are_solved_as_their_sequences(method, linkage, k):
    own = np.array([2, 0, 0, 4, 1, 2, 3, 3, 3, 0, 5, 2, 1])
    d = matrix(POINTS[:6])
    label, medoids, merges = cluster.solve(d, k, method, linkage, own=own, **({"sampsize": 11} if method == "clara" else {}))
    want, m, steps = cluster.solve(d[np.ix_(own, own)], k, method, linkage, own=np.arange(13), **({"sampsize": 11} if method == "clara" else {}))
    if method == "hierarchical":  # each sequence as a path of its own
        assert [x[:2] for x in merges] == [x[:2] for x in steps] and [x[2] for x in merges] == pytest.approx([x[2] for x in steps])
    assert label.tolist() == want.tolist()
    assert medoids == m or all(d[own[a], own[b]] == 0 for a, b in zip(medoids, m, strict=True))


def test_clusters_have_no_bound_on_sequences(spark, monkeypatch):
    from pathloom.operators.distance import compute_sequence_distance

    monkeypatch.setattr(cluster, "DENSE", 3)
    words = {f"s{i:02}": ("AB", "ABA", "CCCC")[i % 3] for i in range(30)}
    df = spark.createDataFrame([(s, i, c) for s, w in words.items() for i, c in enumerate(w)], "sequence_id string, sequence_order int, state string")
    x = compute_sequence_distance(df)
    got = {r[0]: r[1] for r in cluster.cluster_sequences(x, 2).assignments.collect()}
    assert got == {s: 2 if w == "CCCC" else 1 for s, w in words.items()}
    boot = cluster.bootstrap_sequence_clusters(x, 2, n_boot=3)
    pairs = boot.pairs.toPandas()
    assert boot.overall.first()["mean_pairwise_stability"] == pytest.approx(pairs["stability"].mean()) and not pairs.duplicated(["sequence_id_1", "sequence_id_2"]).any()
