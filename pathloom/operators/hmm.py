"""Hidden Markov models: single, mixture, multichannel and with covariates.

Equal sequences are one weighted row. Each iteration broadcasts the parameters, tasks sum the
sufficient statistics of their rows, and the driver, which only sees those sums, solves the
maximisation. Decoding is a scan with the parameters broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelFitError, ValidationError
from ..frame import canonical, without_metadata_variation

TINY = np.finfo(float).tiny


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows that sum to 1; a row without a positive finite total becomes uniform."""
    total = x.sum(axis=-1, keepdims=True)
    good = np.isfinite(total) & (total > 0)
    return np.where(good, x / np.where(good, total, 1), 1 / x.shape[-1])


def forward_backward(start: np.ndarray, step: np.ndarray, like: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, state posteriors [T, K] and expected transitions [T-1, K, K]. ``step``: [K, K] or [T-1, K, K]."""
    n, k = like.shape
    step = np.broadcast_to(step, (max(n - 1, 0), k, k))
    alpha, scale = np.empty((n, k)), np.empty(n)
    for t in range(n):
        a = (start if t == 0 else alpha[t - 1] @ step[t - 1]) * like[t]
        scale[t] = max(a.sum(), TINY)
        alpha[t] = a / scale[t]
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = step[t] @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = normalised(alpha * beta)
    xi = alpha[:-1, :, None] * step * (like[1:] * beta[1:])[:, None, :] / scale[1:, None, None]
    return float(np.log(scale).sum()), gamma, xi


def viterbi(start: np.ndarray, step: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The likeliest path; ties go to the first state."""
    n, k = like.shape
    step = np.log(np.maximum(np.broadcast_to(step, (max(n - 1, 0), k, k)), TINY))
    score, back = np.log(np.maximum(start, TINY)) + np.log(np.maximum(like[0], TINY)), np.zeros((n, k), int)
    for t in range(1, n):
        all_ = score[:, None] + step[t - 1]
        back[t] = all_.argmax(axis=0)
        score = all_.max(axis=0) + np.log(np.maximum(like[t], TINY))
    path = np.empty(n, int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


@dataclass(frozen=True)
class HMM:
    """One or several channels (``emission`` has a table each) and components (``weights``, and a leading axis of all tables)."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray
    emission: tuple[np.ndarray, ...]
    symbols: tuple[tuple[str, ...], ...]
    channels: tuple[str, ...]
    state_names: tuple[str, ...]
    log_likelihood: float
    n_parameters: int
    n_observations: int
    iterations: int
    converged: bool
    history: tuple[float, ...]
    data: DataFrame
    columns: tuple[str, str]

    @property
    def aic(self) -> float:
        return 2 * self.n_parameters - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.n_parameters * math.log(max(1, self.n_observations)) - 2 * self.log_likelihood


def _observed(data: DataFrame, ids: str, order: str, channels: Sequence[str], declared=None, row_col=None) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """sequence_id, orders and obs (per position one index per channel), and the symbols of each channel."""
    df = canonical(data, ids, order, channels[0], None, list(channels[1:]), row_col)
    df = df.select("sequence_id", "sequence_order", "original_row", *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(["state", *channels[1:]])])
    symbols = []
    for i in range(len(channels)):
        seen = sorted(r[0] for r in df.select(f"_c{i}").distinct().collect() if r[0] is not None)
        named = list((declared or {}).get(channels[i], seen))
        if set(seen) - set(named):
            raise ValidationError(f"symbols that are not declared: {sorted(set(seen) - set(named))}")
        symbols.append(tuple(named))
    index = [F.create_map(*[F.lit(x) for kv in ((s, k) for k, s in enumerate(names)) for x in kv])[F.col(f"_c{i}")] for i, names in enumerate(symbols)]
    packed = F.array_sort(F.collect_list(F.struct("sequence_order", "original_row", F.array(*index).alias("o"))))
    seqs = df.groupBy("sequence_id").agg(packed.alias("_s")).select("sequence_id", F.transform("_s", lambda x: x["sequence_order"].cast("double")).alias("orders"), F.transform("_s", lambda x: x["o"]).alias("obs"))
    return seqs, symbols


def _likelihood(emission: Sequence[np.ndarray], obs: np.ndarray) -> np.ndarray:
    out = np.ones((len(obs), emission[0].shape[0]))
    for c, table in enumerate(emission):
        out *= table[:, obs[:, c]].T
    return out


def _sizes(c: int, k: int, symbols: Sequence[tuple[str, ...]]) -> list[tuple[int, ...]]:
    return [(c,), (c, k), (c, k, k), *[(c, k, len(s)) for s in symbols]]


def _statistics(rows: DataFrame, model: tuple, sizes: list[tuple[int, ...]]) -> tuple[float, list[np.ndarray]]:
    """Weighted log-likelihood and expected counts under ``model`` (weights, start, step, emission)."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, start, step, emission = held.value
        total, sums = 0.0, [np.zeros(s) for s in sizes]
        for pdf in batches:
            for obs, w in zip(pdf["obs"], pdf["w"], strict=True):
                obs = np.stack([np.asarray(o) for o in obs])
                parts = [forward_backward(start[m], step[m], _likelihood([e[m] for e in emission], obs)) for m in range(len(weights))]
                logs = np.array([p[0] for p in parts]) + np.log(np.maximum(weights, TINY))
                top = logs.max()
                whole = top + math.log(np.exp(logs - top).sum())
                total += w * whole
                for m, (_, gamma, xi) in enumerate(parts):
                    r = w * math.exp(logs[m] - whole)
                    sums[0][m] += r
                    sums[1][m] += r * gamma[0]
                    sums[2][m] += r * xi.sum(axis=0)
                    for c in range(obs.shape[1]):
                        np.add.at(sums[3 + c][m].T, obs[:, c], r * gamma)
        yield pd.DataFrame({"v": [np.concatenate([[total], *[s.ravel() for s in sums]])]})

    found = np.sum([np.asarray(r["v"]) for r in rows.mapInPandas(run, "v array<double>").collect()], axis=0)  # one row per task
    edges = np.cumsum([1, *[int(np.prod(s)) for s in sizes]])
    return float(found[0]), [found[a:b].reshape(s) for a, b, s in zip(edges[:-1], edges[1:], sizes, strict=True)]


def _fit(data, components, n_states, ids, order, channels, declared, state_names, given, max_iter, tolerance, pseudocount, seed, row_col) -> HMM:
    if n_states < 1 or components < 1 or max_iter < 1:
        raise ValidationError("states, components and max_iter must be positive")
    seqs, symbols = _observed(data, ids, order, channels, declared, row_col)
    rows = seqs.groupBy("obs").agg(F.count(F.lit(1)).cast("double").alias("w")).persist()
    try:
        n = int(rows.agg(F.sum(F.col("w") * F.size("obs"))).first()[0])
        rng = np.random.default_rng(seed)
        draw = lambda *s: normalised(rng.exponential(size=s) + 0.1)
        start, step = draw(components, n_states), draw(components, n_states, n_states)
        emission = tuple(draw(components, n_states, len(s)) for s in symbols)
        weights = np.full(components, 1 / components)
        for name, value in given.items():
            if value is not None:
                if name == "start":
                    start = normalised(np.asarray(value, float))[None]
                elif name == "step":
                    step = normalised(np.asarray(value, float))[None]
                else:
                    emission = tuple(normalised(np.asarray(v, float))[None] for v in (value if isinstance(value, (list, tuple)) and np.ndim(value[0]) == 2 else [value]))
        sizes, history, converged = _sizes(components, n_states, symbols), [], False
        for _ in range(max_iter):
            loglik, sums = _statistics(rows, (weights, start, step, emission), sizes)
            if not np.isfinite(loglik):
                raise ModelFitError("the likelihood is not finite")
            weights, start, step = normalised(sums[0] + pseudocount), normalised(sums[1] + pseudocount), normalised(sums[2] + pseudocount)
            emission = tuple(normalised(s + pseudocount) for s in sums[3:])
            history.append(loglik)
            if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance * (abs(history[-2]) + tolerance):
                converged = True
                break
        history.append(_statistics(rows, (weights, start, step, emission), sizes)[0])
    finally:
        rows.unpersist()
    k = n_states
    parameters = components * ((k - 1) + k * (k - 1) + sum(k * (len(s) - 1) for s in symbols)) + components - 1
    names = tuple(state_names or [f"state_{i}" for i in range(1, k + 1)])
    return HMM(weights, start, step, emission, tuple(symbols), tuple(channels), names, history[-1], parameters, n, len(history) - 1, converged, tuple(history), seqs, (ids, order))


def fit_sequence_hmm(
    data, n_states, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", symbol_levels=None, state_names=None, initial_probs=None, transition_probs=None,
    emission_probs=None, max_iter=200, tolerance=1e-6, pseudocount=1e-6, seed=1, row_col=None,
) -> HMM:
    """Baum-Welch over all sequences."""
    given = {"start": initial_probs, "step": transition_probs, "emission": emission_probs}
    return _fit(data, 1, n_states, sequence_id_col, order_col, [state_col], {state_col: symbol_levels} if symbol_levels else None, state_names, given, max_iter, tolerance, pseudocount, seed, row_col)


def fit_sequence_hmm_mixture(data, n_components, n_states, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", max_iter=200, tolerance=1e-6, pseudocount=1e-6, seed=1, row_col=None) -> HMM:
    """A mixture of models, each sequence belonging to one."""
    return _fit(data, n_components, n_states, sequence_id_col, order_col, [state_col], None, None, {}, max_iter, tolerance, pseudocount, seed, row_col)


def fit_multichannel_sequence_hmm(data, n_states, channel_cols, sequence_id_col="sequence_id", order_col="sequence_order", symbol_levels=None, state_names=None, initial_probs=None, transition_probs=None, emission_probs=None, max_iter=200, tolerance=1e-6, pseudocount=1e-6, seed=1, row_col=None) -> HMM:
    """One latent path; channels are independent given it."""
    if len(channel_cols) < 2:
        raise ValidationError("two channels are needed")
    given = {"start": initial_probs, "step": transition_probs, "emission": emission_probs}
    return _fit(data, 1, n_states, sequence_id_col, order_col, list(channel_cols), symbol_levels, state_names, given, max_iter, tolerance, pseudocount, seed, row_col)


def decode_sequence_states(model: HMM, data: DataFrame | None = None, method="viterbi", component: int | None = None, row_col=None) -> DataFrame:
    """The latent state of each position with its posterior; sequences of a mixture use their likeliest component."""
    if method not in ("viterbi", "posterior"):
        raise ValidationError("method must be viterbi or posterior")
    seqs = model.data if data is None else _observed(data, *model.columns, model.channels, dict(zip(model.channels, model.symbols, strict=True)), row_col)[0]
    held = seqs.sparkSession.sparkContext.broadcast((model.weights, model.start, model.step, model.emission, model.symbols, model.state_names))
    many = len(model.channels) > 1
    names = list(model.channels) if many else ["observed_state"]

    def run(batches):
        weights, start, step, emission, symbols, states = held.value
        for pdf in batches:
            out = []
            for sid, orders, obs in zip(pdf["sequence_id"], pdf["orders"], pdf["obs"], strict=True):
                obs = np.stack([np.asarray(o) for o in obs])
                likes = [_likelihood([e[m] for e in emission], obs) for m in range(len(weights))]
                fits = [forward_backward(start[m], step[m], likes[m]) for m in range(len(weights))]
                m = component - 1 if component else int(np.argmax([f[0] + math.log(max(w, TINY)) for f, w in zip(fits, weights, strict=True)]))
                gamma = fits[m][1]
                path = viterbi(start[m], step[m], likes[m]) if method == "viterbi" else gamma.argmax(axis=1)
                for t in range(len(obs)):
                    out.append((sid, float(orders[t]), *[symbols[c][obs[t, c]] for c in range(obs.shape[1])], m + 1, states[path[t]], float(gamma[t, path[t]]), method))
            yield pd.DataFrame(out, columns=["sequence_id", "sequence_order", *names, "component", "latent_state", "posterior_probability", "decoding_method"])

    kinds = ", ".join(f"`{n}` string" for n in names)
    return seqs.mapInPandas(run, f"sequence_id string, sequence_order double, {kinds}, component long, latent_state string, posterior_probability double, decoding_method string")


def decode_multichannel_sequence_states(model: HMM, data: DataFrame | None = None, method="viterbi", row_col=None) -> DataFrame:
    return decode_sequence_states(model, data, method, row_col=row_col).drop("component")


def summarise_sequence_hmm(model: HMM) -> dict[str, DataFrame]:
    """fit, initial, transition, emission and mixture in long form."""
    spark = model.data.sparkSession
    s, c = model.state_names, range(len(model.weights))
    fit = [(model.log_likelihood, model.aic, model.bic, model.n_parameters, model.n_observations, model.iterations, model.converged)]
    return {
        "fit": spark.createDataFrame(fit, "log_likelihood double, aic double, bic double, n_parameters long, n_observations long, iterations long, converged boolean"),
        "initial": spark.createDataFrame([(m + 1, s[i], float(model.start[m, i])) for m in c for i in range(len(s))], "component long, latent_state string, probability double"),
        "transition": spark.createDataFrame([(m + 1, s[i], s[j], float(model.step[m, i, j])) for m in c for i in range(len(s)) for j in range(len(s))], "component long, from_state string, to_state string, probability double"),
        "emission": spark.createDataFrame(
            [(m + 1, ch, s[i], y, float(e[m, i, k])) for m in c for ch, e, names in zip(model.channels, model.emission, model.symbols, strict=True) for i in range(len(s)) for k, y in enumerate(names)],
            "component long, channel string, latent_state string, symbol string, probability double",
        ),
        "mixture": spark.createDataFrame([(m + 1, float(model.weights[m]), len(s)) for m in c], "component long, weight double, n_states long"),
    }


summarise_multichannel_sequence_hmm = summarise_sequence_hmm


def plot_multichannel_sequence_hmm(model: HMM, channel: str | None = None) -> DataFrame:
    return summarise_sequence_hmm(model)["emission"].where(F.col("channel") == (channel or model.channels[0]))


def compare_sequence_hmms(**models) -> DataFrame:
    """Models by bic, with differences from the best. All must have seen as many observations."""
    if len({m.n_observations for m in models.values()}) != 1:
        raise ValidationError("models of different data can't be compared")
    a, b = min(m.aic for m in models.values()), min(m.bic for m in models.values())
    rows = [(k, type(m).__name__, m.log_likelihood, m.aic, m.bic, m.n_parameters, m.n_observations, m.converged, m.aic - a, m.bic - b) for k, m in models.items()]
    spark = next(iter(models.values())).data.sparkSession
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[4], r[3], r[0])), "model string, class string, log_likelihood double, aic double, bic double, n_parameters long, n_observations long, converged boolean, delta_aic double, delta_bic double")


@dataclass(frozen=True)
class CovariateHMM:
    """Multinomial logits of the first state and of each origin's next state; the last state is the reference."""

    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    initial_cols: tuple[str, ...]
    transition_cols: tuple[str, ...]
    centre: dict
    symbols: tuple[str, ...]
    state_names: tuple[str, ...]
    log_likelihood: float
    n_parameters: int
    n_observations: int
    iterations: int
    converged: bool
    data: DataFrame

    aic = HMM.aic
    bic = HMM.bic


def softmax(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Probabilities of K states from [n, p] rows and [p, K - 1] coefficients, the last state's being 0."""
    eta = np.hstack([x @ coefficients, np.zeros((len(x), 1))])
    e = np.exp(eta - eta.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, counts: np.ndarray, ridge: float, start: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised multinomial logit of expected counts [n, K] by Newton steps (halved where they overshoot)."""
    beta, (n, p), k = start.copy(), x.shape, counts.shape[1] - 1
    total = counts.sum(axis=1)
    value = lambda b: float((counts * np.log(np.maximum(softmax(x, b), TINY))).sum() - ridge / 2 * (b**2).sum())
    best = value(beta)
    for _ in range(rounds):
        q = softmax(x, beta)[:, :k]
        gradient = (x.T @ (counts[:, :k] - total[:, None] * q) - ridge * beta).T.ravel()
        hessian = np.zeros((k * p, k * p))
        for a in range(k):
            for b in range(k):
                w = total * q[:, a] * ((a == b) - q[:, b])
                hessian[a * p : (a + 1) * p, b * p : (b + 1) * p] = x.T @ (w[:, None] * x)
        step = np.linalg.solve(hessian + (ridge + 1e-9) * np.eye(k * p), gradient).reshape(k, p).T
        size = 1.0
        while size > 1e-6 and value(beta + size * step) < best:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-8:
            break
        beta = beta + size * step
        best = value(beta)
    return beta


def fit_covariate_sequence_hmm(
    data, n_states, initial_covariate_cols=(), transition_covariate_cols=(), sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", emission_probs=None,
    max_iter=100, tolerance=1e-6, pseudocount=1e-6, ridge=1e-6, seed=1, row_col=None,
) -> CovariateHMM:
    """EM with logits of standardised covariates; a transition's covariates are its origin's.

    Rows with the same covariates are one row of the solve, so the driver sees as many as there are
    distinct covariate values.
    """
    if n_states < 2:
        raise ValidationError("two states are needed")
    first, moving = list(initial_covariate_cols), list(transition_covariate_cols)
    meta = list(dict.fromkeys([*first, *moving]))
    df = canonical(data, sequence_id_col, order_col, state_col, None, meta, row_col)
    without_metadata_variation(df, first)
    moments = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}:{n}") for c in meta for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first().asDict()
    centre = {c: (float(moments[f"{c}:m"]), float(moments[f"{c}:s"] or 0) or 1.0) for c in meta}
    symbols = tuple(sorted(r[0] for r in df.select("state").distinct().collect()))
    index = F.create_map(*[F.lit(x) for kv in ((s, k) for k, s in enumerate(symbols)) for x in kv])[F.col("state")]
    z = lambda cols: F.array(F.lit(1.0), *[(F.col(c).cast("double") - centre[c][0]) / centre[c][1] for c in cols])
    packed = F.array_sort(F.collect_list(F.struct("sequence_order", "original_row", index.alias("o"), z(first).alias("x"), z(moving).alias("y"))))
    seqs = df.groupBy("sequence_id").agg(packed.alias("_s")).select(
        "sequence_id", F.transform("_s", lambda s: s["sequence_order"].cast("double")).alias("orders"), F.transform("_s", lambda s: s["o"]).alias("obs"),
        F.element_at("_s", 1)["x"].alias("x"), F.transform("_s", lambda s: s["y"]).alias("y"),
    )
    if seqs.where(F.size("obs") > 1).isEmpty():
        raise ValidationError("at least one transition is needed")
    rows = seqs.groupBy("obs", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")).persist()
    k, rng = n_states, np.random.default_rng(seed)
    initial, transition = np.zeros((1 + len(first), k - 1)), np.zeros((k, 1 + len(moving), k - 1))
    transition[:, 0, :] = rng.normal(scale=0.3, size=(k, k - 1))
    emission = normalised(np.asarray(emission_probs, float)) if emission_probs is not None else normalised(rng.exponential(size=(k, len(symbols))) + 0.1)

    def expected(model) -> tuple[float, dict]:
        held = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            initial, transition, emission = held.value
            total, sums = 0.0, {}
            for pdf in batches:
                for obs, x, y, w in zip(pdf["obs"], pdf["x"], pdf["y"], pdf["w"], strict=True):
                    obs, x, y = np.asarray(obs), np.asarray(x), np.stack([np.asarray(v) for v in y])
                    step = np.stack([softmax(y[:-1], transition[i]) for i in range(len(transition))], axis=1)
                    loglik, gamma, xi = forward_backward(softmax(x[None], initial)[0], step, emission[:, obs].T)
                    total += w * loglik
                    for key, value in (("i", tuple(x)), gamma[0]), *((("t", i, tuple(y[t])), xi[t, i]) for t in range(len(obs) - 1) for i in range(len(transition))), *((("e", int(o)), g) for o, g in zip(obs, gamma, strict=True)):
                        sums[key] = sums.get(key, 0) + w * value
            yield pd.DataFrame({"k": [repr(q) for q in sums] + ["total"], "v": [np.asarray(v, float) for v in sums.values()] + [np.array([total])]})

        found = rows.mapInPandas(run, "k string, v array<double>").groupBy("k").agg(F.array(*[F.sum(F.try_element_at("v", F.lit(i + 1))) for i in range(k)]).alias("v")).collect()
        table = {r["k"]: np.array([v or 0.0 for v in r["v"]]) for r in found}
        return table.pop("total")[0], table

    import ast

    loglik, converged, turns = -np.inf, False, 0
    try:
        for turns in range(1, max_iter + 1):
            now, table = expected((initial, transition, emission))
            keys = {q: ast.literal_eval(q.replace("np.float64", "")) for q in table}
            pick = lambda kind, at=None: [(c, table[q]) for q, c in keys.items() if c[0] == kind and (at is None or c[1] == at)]
            rows_i = pick("i")
            initial = fit_softmax(np.array([c[1] for c, _ in rows_i]), np.array([v for _, v in rows_i]), ridge, initial)
            for i in range(k):
                rows_t = pick("t", i)
                transition[i] = fit_softmax(np.array([c[2] for c, _ in rows_t]), np.array([v for _, v in rows_t]), ridge, transition[i])
            counts = np.zeros((k, len(symbols)))
            for c, v in pick("e"):
                counts[:, c[1]] = v
            emission = normalised(counts + pseudocount)
            if abs(now - loglik) <= tolerance * (abs(loglik) + tolerance):
                converged = True
                break
            loglik = now
        loglik = expected((initial, transition, emission))[0]
    finally:
        rows.unpersist()
    n_parameters = initial.size + transition.size + k * (len(symbols) - 1)
    names = tuple(f"state_{i}" for i in range(1, k + 1))
    return CovariateHMM(initial, transition, emission, tuple(first), tuple(moving), centre, symbols, names, float(loglik), n_parameters, int(moments["n"]), turns, converged, seqs)


def predict_covariate_transition_probabilities(model: CovariateHMM, newdata: DataFrame, row_col: str | None = None) -> DataFrame:
    """row, from_state, to_state, probability for each row of covariates, as column expressions."""
    x = [F.lit(1.0), *[(F.col(c).cast("double") - model.centre[c][0]) / model.centre[c][1] for c in model.transition_cols]]
    cells = []
    for i, origin in enumerate(model.state_names):
        eta = [sum((float(b) * v for b, v in zip(model.transition[i][:, j], x, strict=True)), F.lit(0.0)) for j in range(len(model.state_names) - 1)] + [F.lit(0.0)]
        top = F.greatest(*eta)
        total = sum((F.exp(e - top) for e in eta), F.lit(0.0))
        cells += [F.struct(F.lit(origin).alias("from_state"), F.lit(s).alias("to_state"), (F.exp(e - top) / total).alias("probability")) for s, e in zip(model.state_names, eta, strict=True)]
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id() + 1
    return newdata.withColumn("row", row).select("row", F.inline(F.array(*cells)))


def decode_covariate_sequence_states(model: CovariateHMM, method="viterbi") -> DataFrame:
    held = model.data.sparkSession.sparkContext.broadcast((model.initial, model.transition, model.emission, model.symbols, model.state_names))

    def run(batches):
        initial, transition, emission, symbols, states = held.value
        for pdf in batches:
            out = []
            for sid, orders, obs, x, y in zip(*[pdf[c] for c in ("sequence_id", "orders", "obs", "x", "y")], strict=True):
                obs, x, y = np.asarray(obs), np.asarray(x), np.stack([np.asarray(v) for v in y])
                step = np.stack([softmax(y[:-1], t) for t in transition], axis=1)
                start, like = softmax(x[None], initial)[0], emission[:, obs].T
                gamma = forward_backward(start, step, like)[1]
                path = viterbi(start, step, like) if method == "viterbi" else gamma.argmax(axis=1)
                out += [(sid, float(orders[t]), symbols[obs[t]], states[path[t]], float(gamma[t, path[t]]), method) for t in range(len(obs))]
            yield pd.DataFrame(out, columns=["sequence_id", "sequence_order", "observed_state", "latent_state", "posterior_probability", "decoding_method"])

    return model.data.mapInPandas(run, "sequence_id string, sequence_order double, observed_state string, latent_state string, posterior_probability double, decoding_method string")


def summarise_covariate_sequence_hmm(model: CovariateHMM) -> dict[str, DataFrame]:
    spark, s = model.data.sparkSession, model.state_names
    at, to = ["(intercept)", *model.initial_cols], ["(intercept)", *model.transition_cols]
    full = lambda b: np.hstack([b, np.zeros((len(b), 1))])
    return {
        "initial": spark.createDataFrame([(c, s[j], float(full(model.initial)[i, j])) for i, c in enumerate(at) for j in range(len(s))], "covariate string, latent_state string, coefficient double"),
        "transition": spark.createDataFrame([(o, c, s[j], float(full(model.transition[q])[i, j])) for q, o in enumerate(s) for i, c in enumerate(to) for j in range(len(s))], "from_state string, covariate string, to_state string, coefficient double"),
        "emission": spark.createDataFrame([(s[i], y, float(model.emission[i, j])) for i in range(len(s)) for j, y in enumerate(model.symbols)], "latent_state string, symbol string, probability double"),
        "fit": spark.createDataFrame([(model.log_likelihood, model.aic, model.bic, model.n_parameters, model.n_observations, model.iterations, model.converged)], "log_likelihood double, aic double, bic double, n_parameters long, n_observations long, iterations long, converged boolean"),
    }
