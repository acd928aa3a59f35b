"""Hidden Markov kernels against enumeration, and fits that improve."""

import itertools

import numpy as np
import pytest

from pathloom.operators import hmm


def test_kernels_against_enumeration():
    rng = np.random.default_rng(0)
    start, step, like = hmm.normalised(rng.random(2)), hmm.normalised(rng.random((2, 2))), rng.random((5, 2))
    total, best, occupied = 0.0, (-1, None), np.zeros((5, 2))
    for path in itertools.product(range(2), repeat=5):
        p = start[path[0]] * like[0, path[0]]
        for t in range(1, 5):
            p *= step[path[t - 1], path[t]] * like[t, path[t]]
        total += p
        best = max(best, (p, path))
        for t in range(5):
            occupied[t, path[t]] += p
    loglik, gamma, xi = hmm.forward_backward(start, step, like)
    assert loglik == pytest.approx(np.log(total)) and gamma == pytest.approx(occupied / total)
    assert xi.sum(axis=(1, 2)) == pytest.approx(np.ones(4)) and tuple(hmm.viterbi(start, step, like)) == best[1]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(f"s{i}", t, s, "xy"[(i + t) % 2], i % 2) for i, word in enumerate(["ABAB", "AABB", "BABA", "BBAA", "AAAB", "ABBB"] * 3) for t, s in enumerate(word)]
    return spark.createDataFrame(rows, "sequence_id string, sequence_order int, state string, channel string, condition int")


def test_single_and_decode(data):
    m = hmm.fit_sequence_hmm(data, 2, max_iter=6)
    assert all(b >= a - 1e-6 for a, b in zip(m.history, m.history[1:]))
    assert np.allclose(m.start.sum(), 1) and np.allclose(m.step.sum(axis=-1), 1)
    rows = hmm.decode_sequence_states(m).collect()
    assert len(rows) == data.count() and all(0 <= r["posterior_probability"] <= 1 for r in rows)
    assert hmm.compare_sequence_hmms(a=m, b=hmm.fit_sequence_hmm(data, 1, max_iter=2)).count() == 2
    assert hmm.summarise_sequence_hmm(m)["transition"].count() == 4


def test_mixture_and_channels(data):
    m = hmm.fit_sequence_hmm_mixture(data, 2, 2, max_iter=3)
    assert m.weights.sum() == pytest.approx(1) and {r["component"] for r in hmm.decode_sequence_states(m).collect()} <= {1, 2}
    c = hmm.fit_multichannel_sequence_hmm(data, 2, ["state", "channel"], max_iter=3)
    assert {"state", "channel"} <= set(hmm.decode_multichannel_sequence_states(c, method="posterior").columns)
    assert hmm.plot_multichannel_sequence_hmm(c, "channel").count() == 4


def test_covariates(data, spark):
    m = hmm.fit_covariate_sequence_hmm(data, 2, ["condition"], ["condition"], max_iter=3)
    new = spark.createDataFrame([(0,), (1,)], "condition int")
    rows = hmm.predict_covariate_transition_probabilities(m, new).groupBy("row", "from_state").sum("probability").collect()
    assert len(rows) == 4 and all(r[2] == pytest.approx(1) for r in rows)
    assert hmm.decode_covariate_sequence_states(m).count() == data.count()
    assert hmm.summarise_covariate_sequence_hmm(m)["initial"].count() == 4


def test_softmax_fit_recovers_frequencies():
    x = np.array([[1.0, 0.0], [1.0, 1.0]])
    counts = np.array([[30.0, 50.0, 20.0], [10.0, 10.0, 80.0]])
    beta = hmm.fit_softmax(x, counts, 1e-9, np.zeros((2, 2)))
    assert hmm.softmax(x, beta) == pytest.approx(counts / 100, abs=1e-5)
