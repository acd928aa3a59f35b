"""Worked values on tiny tables."""

import numpy as np
import pytest

from pathloom.errors import ValidationError
from pathloom.functions import stats
from pathloom.operators import audit, consensus, describe, distance, motifs, network, research, subsequences, timemodel


def table(spark, words, **more):
    rows = [(s, i, x) for s, w in words.items() for i, x in enumerate(w, 1)]
    return spark.createDataFrame(rows, "sequence_id string, sequence_order int, state string")


COLS = ("sequence_id", "sequence_order", "state")


def test_state_and_transition_shares(spark):
    df = spark.createDataFrame([("s1", i, s, d) for i, (s, d) in enumerate(zip("ABAC", (1, 2, 3, 4)))] + [("s2", i, s, d) for i, (s, d) in enumerate(zip("BCA", (2, 2, 6)))], "sequence_id string, sequence_order int, state string, duration int")
    got = describe.summarise_sequence_states(df, *COLS, duration_col="duration")
    a = {(r["sequence_id"], r["state"]): r for r in got.by_sequence.collect()}["s1", "A"]
    assert (a["n_observations"], a["observation_proportion"], a["duration_sum"], a["duration_proportion"], a["mean_duration"]) == (2, 0.5, 4, 0.4, 2)
    o = {r["state"]: r for r in got.overall.collect()}["A"]
    assert (o["n_observations"], o["duration_sum"]) == (3, 10) and o["observation_proportion"] == pytest.approx(3 / 7) and o["mean_duration"] == pytest.approx(10 / 3)
    t = {(r["from_state"], r["to_state"]): r for r in describe.summarise_sequence_transitions(df, *COLS).overall.collect()}["B", "A"]
    assert (t["n_transitions"], t["transition_proportion"], t["origin_transition_proportion"], t["sequence_proportion"]) == (1, 0.2, 0.5, 0.5)


def test_motifs(spark):
    x = motifs.extract_sequence_ngrams(table(spark, {"s1": "ABABA", "s2": "ABAC"}), *COLS)
    rows = x.occurrences.collect()
    assert len(rows) == 12 and sorted(r["n_candidate_occurrences"] for r in x.sequences.collect()) == [5, 7]
    aba = {r["motif"]: r for r in motifs.summarise_sequence_motifs(x).overall.collect()}["A > B > A"]
    assert (aba["n_occurrences"], aba["n_sequences"], aba["occurrence_share"], aba["mean_occurrences_when_present"]) == (3, 2, 0.25, 1.5)
    y = motifs.extract_sequence_ngrams(table(spark, {"s1": "ABABA", "s2": "ABAC", "s3": "AAAA"}), *COLS, min_length=2, max_length=3, overlap="disallow")
    starts = {}
    for r in y.occurrences.collect():
        starts.setdefault((r["sequence_id"], r["motif"]), []).append(r["start_index"])
    assert starts["s1", "A > B > A"] == [1] and sorted(starts["s3", "A > A"]) == [1, 3]
    assert motifs.filter_sequence_motifs(x, top_n=1, rank_by="n_occurrences").overall.count() == 3
    assert motifs.filter_sequence_motifs(x, top_n=1, rank_by="n_occurrences", ties="first").overall.first()["motif"] == "A > B"


def test_preparation(spark):
    df = spark.createDataFrame([("s1", o, s, i, i) for i, (o, s) in enumerate([(1, "A"), (2, "B"), (2, "C"), (3, "C"), (4, "D")], 1)], "sequence_id string, sequence_order int, state string, duration int, r int")
    got = audit.prepare_sequence_data(df, *COLS, duration_col="duration", duplicate_position_policy="last", repeated_state_policy="collapse", row_col="r")
    rows = sorted((r["sequence_order"], r["state"], r["duration"], r["original_row"]) for r in got.data.collect())
    assert rows == [(1, "A", 1, 1), (2, "C", 7, 3), (4, "D", 5, 5)] and got.status == "review"
    assert audit.prepare_sequence_data(df, *COLS, row_col="r").data is None
    with pytest.raises(ValidationError):
        describe.format_sequence_paths(df, *COLS)


def test_audit_codes(spark):
    rows = [("s1", 1.0, "A", -1.0, "p"), ("s1", 3.0, None, 0.0, "q"), (None, 2.0, "B", 1.0, "p"), ("s2", float("inf"), "C", None, "p"), ("s3", None, "Z", float("inf"), "p")]
    df = spark.createDataFrame(rows, "sequence_id string, sequence_order double, state string, duration double, who string")
    codes = {r["issue_code"] for r in audit.audit_sequence_data(df, *COLS, duration_col="duration", metadata_cols=["who"], expected_states=["A", "B", "C", "D"]).collect()}
    assert {"missing_sequence_id", "missing_state", "missing_sequence_order", "non_finite_order", "missing_positions", "single_state_sequence", "missing_duration", "non_finite_duration", "negative_duration", "zero_duration", "inconsistent_metadata", "unknown_state", "unused_state_levels"} <= codes
    assert audit.audit_sequence_data(df.limit(0), *COLS).first()["issue_code"] == "empty_data"
    assert audit.audit_sequence_data(df, "no", "sequence_order", "state").first()["issue_code"] == "missing_required_column"


def test_consensus_ties(spark):
    df = table(spark, {"s1": "B", "s2": "A"})
    one = lambda m: consensus.create_consensus_sequence(df, tie_method=m).first()["consensus_state"]
    assert [one(m) for m in ("first", "last", "missing", "all")] == ["A", "B", None, "A | B"]


def test_distances_and_network(spark):
    words = {"s1": "ABCD", "s2": "ABCC", "s3": "DCBA", "s4": "DCAA"}
    df = table(spark, words)
    pairs = lambda m: sorted(r["distance"] for r in distance.compute_sequence_distance(df, method=m).pairs.collect())
    assert pairs("levenshtein") == [1, 1, 4, 4, 4, 4] and pairs("lcs") == [2, 2, 6, 6, 6, 6] and pairs("optimal_matching") == pairs("levenshtein")
    net = network.create_transition_network(df, normalise="from")
    assert net.groupBy("context").sum("weight").collect() and all(r[1] == pytest.approx(1) for r in net.groupBy("context").sum("weight").collect())
    m = network.fit_higher_order_transition_model(df, order=2)
    assert network.predict_next_state(m, ["Q"]).first()["used_order"] == 0
    assert network.predict_next_state(m, ["Q", "A", "B"], top_n=1).first()["used_order"] == 2


def test_subsequence_guard_and_tests(spark):
    df = table(spark, {f"s{i}": "AB" if i % 2 else "AC" for i in range(8)}).withColumnRenamed("x", "x")
    with pytest.raises(ValidationError):
        subsequences.extract_sequence_subsequences(table(spark, {"s": "AB" * 30}), max_combinations_per_sequence=1000)
    assert subsequences.extract_sequence_subsequences(df, max_length=2).occurrences.count() == 8
    x, dof, p, _ = stats.chi_square(np.array([[10, 20], [20, 10]], float))
    assert x == pytest.approx(6.6667, abs=1e-3) and dof == 1 and p == pytest.approx(0.00982, abs=1e-4)
    assert stats.chi2_sf(11.07, 5) == pytest.approx(0.05, abs=1e-3)
    assert stats.fisher(3, 1, 1, 3)[1] == pytest.approx(0.4857, abs=1e-3)
    assert stats.quantile_weibull([1, 2, 3, 4], 0.5) == 2.5


def test_smoothing_preservation(spark):
    rows = [("p", "t", i, r, r, "A") for i, r in enumerate("AAABAAA")]
    df = spark.createDataFrame(rows, "p string, t string, i int, ref string, raw string, smooth string")
    events, trials = research.audit_smoothing_event_preservation(df, participant_col="p", trial_col="t", order_col="i", true_col="ref", raw_col="raw", smoothed_col="smooth")
    brief = events.where("brief_reference_event").collect()
    assert len(brief) == 1 and brief[0]["raw_whole_event_preserved"] and not brief[0]["smoothed_whole_event_preserved"]
    assert trials.first()["smoothed_error"] == pytest.approx(1 / 7)


def test_time_model_recovers_curves(spark):
    rng = np.random.default_rng(5)
    rows = []
    for person in range(60):
        g = person % 2
        shift = rng.normal(scale=0.3)
        for t in range(1, 16):
            p = 1 / (1 + np.exp(-((-1 + 0.2 * t) if g else (1 - 0.15 * t)) - shift))
            rows.append((f"p{person}", t, "hit" if rng.random() < p else "miss", f"g{g}"))
    df = spark.createDataFrame(rows, "sequence_id string, sequence_order int, state string, grp string")
    m = timemodel.fit_time_varying_sequence_model(df, "grp", "sequence_id", target_state="hit")
    got = {(r["time"], r["group"]): r for r in timemodel.predict_time_varying_sequence_model(m, time=[1, 8, 15]).collect()}
    for t in (1, 8, 15):
        assert got[t, "g1"]["estimate"] == pytest.approx(1 / (1 + np.exp(1 - 0.2 * t)), abs=0.12)
        assert got[t, "g0"]["estimate"] == pytest.approx(1 / (1 + np.exp(-1 + 0.15 * t)), abs=0.12)
        assert got[t, "g0"]["lower"] <= got[t, "g0"]["estimate"] <= got[t, "g0"]["upper"]


def test_spline_basis_sums_to_one():
    b = timemodel.spline_basis(np.linspace(0, 10, 21), 0, 10, 5, 3)
    assert b.sum(axis=1) == pytest.approx(np.ones(21)) and (b >= -1e-12).all()


def test_time_model_sums_are_the_same_on_executors(spark, monkeypatch):
    monkeypatch.setattr(timemodel, "BLOCK", 16)
    rows = [(f"p{i}", t, "hit" if (3 * t + i * i) % 5 < 2 else "miss", f"g{i % 2}") for i in range(40) for t in range(5 + i % 3)]
    df = spark.createDataFrame(rows, "sequence_id string, sequence_order int, state string, grp string")
    packed = timemodel.blocks(timemodel.model_frame(df, "grp", "sequence_id", target_state="hit"))
    held = [timemodel._block(*r) for r in packed.collect()]
    f = lambda b: np.array([b.n @ b.size, b.y.sum(), b.size[b.parts[b.people]].sum(), np.exp(b.times[b.at] / 9) @ b.y])
    got = timemodel.summed(packed, f)
    assert got == pytest.approx(timemodel.summed(held, f)) and got[:3].tolist() == [len(rows), sum(r[2] == "hit" for r in rows), 40]


def test_alike_participants_are_one_row_of_the_time_model(spark):
    rows = [(f"p{i}", t, "hit" if (t + i) % 3 == 0 else "miss", f"g{i % 2}") for i in range(60) for t in range(6)]
    df = spark.createDataFrame(rows, "sequence_id string, sequence_order int, state string, grp string")
    frame = timemodel.model_frame(df, "grp", "sequence_id", target_state="hit")
    held = [timemodel._block(*r) for r in timemodel.blocks(frame).collect()]
    assert sum(len(b.n) for b in held) == 12 and sum(b.n @ b.size for b in held) == 360 and sum(b.y.sum() for b in held) == 120


def test_distances_of_paths_stand_for_all_pairs(spark):
    from pathloom.operators import meta

    words = {f"s{i:03}": ("ABC", "ABD", "CC")[i % 3] for i in range(200)}  # of several blocks
    x = distance.compute_sequence_distance(table(spark, words))
    assert x.between.count() == 6
    pairs = {(r[0], r[1]): r[2] for r in x.pairs.collect()}
    d = {"ABCABD": 1.0, "ABCCC": 2.0, "ABDCC": 3.0}
    want = {(a, b): 0.0 if words[a] == words[b] else d["".join(sorted((words[a], words[b])))] for a in words for b in words if a < b}
    assert pairs == want and x.pairs.count() == len(want)
    overall, per = distance.summarise_sequence_distance(x)
    assert overall.first()["n_pairs"] == len(want) and overall.first()["mean_distance"] == pytest.approx(np.mean(list(want.values()))) and overall.first()["median_distance"] == np.median(list(want.values()))
    own = [v for k, v in want.items() if "s007" in k]
    assert per.where("sequence_id = 's007'").first()["mean_distance"] == pytest.approx(np.mean(own)) and per.count() == 200
    assert meta.audit_sequence_analysis(x, spark)[0].first()["status"] == "pass"
    y = distance.compute_sequence_distance(table(spark, {**words, "s000": "CC", "t": "CC"}))
    far = {r["field"]: r for r in meta.compare_sequence_analysis_results(x, y, spark, compare_values=True).collect()}["values"]
    words2 = {**words, "s000": "CC"}
    moved = sum(words[a] != words["s000"] or words2[a] != "CC" for a in words if a != "s000")
    assert int(far["y"]) == moved + 200


def test_validation_counts_what_the_audit_lists(spark):
    rows = [("s1", 1.0, "A", -1.0), ("s1", 3.0, None, 0.0), ("s1", 3.0, "A", 1.0), (None, 2.0, "B", 1.0), ("s2", float("inf"), "C", None), ("s3", None, "Z", float("inf")), ("s4", 2.0, "B", 1.0), ("s4", 1.0, "B", 1.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "sequence_id string, sequence_order double, state string, duration double, r int")
    got = audit.validate_sequence_data(df, *COLS, duration_col="duration", expected_states=["A", "B", "Q"], row_col="r")
    listed = {r["severity"]: r["count"] for r in got.audit.groupBy("severity").count().collect()}
    one = got.summary.first()
    assert (one["n_errors"], one["n_reviews"], one["n_info"]) == tuple(listed.get(k, 0) for k in ("error", "review", "info"))
    empty = audit.validate_sequence_data(df.limit(0), *COLS).summary.first()
    assert (empty["status"], empty["n_errors"]) == ("fail", 1)
    assert audit.prepare_sequence_data(df.limit(0), *COLS, duplicate_position_policy="first").status == "fail"


def test_line_items_are_dealt_by_their_number(spark, monkeypatch):
    from pathloom.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    rows = tables.lineitems(spark, "/root/testdata/sf0.001")
    assert rows.count() == 6000 and rows.rdd.getNumPartitions() == 30
