"""Time-varying probabilities: a penalised logistic model with a smooth of time per group and participant intercepts.

Spark reduces the data to counts of each (time, group, participant), which is what the likelihood
needs. Participants with the same times, groups and number of outcomes have the same intercept, so they
are one weighted participant. Blocks of whole participants are kept; each step of the fit sends the
coefficients to them, where the intercepts are solved, and gets sums of the size of the basis back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelFitError, ValidationError
from ..frame import by_sequence, canonical

#: Counts of a block, unless one participant has more.
BLOCK = 200_000
#: Blocks of so many counts in all (24 bytes each) are summed by the driver, which saves a job for each step.
LOCAL = 1_000_000


def model_frame(data, group_col, participant_id_col, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", time_col=None, outcome="state", target_state=None, from_state=None, to_state=None, row_col=None) -> DataFrame:
    """outcome (0 or 1), time, group, participant. A transition's outcome marks from -> to over all adjacent pairs, at the origin's time."""
    meta = list(dict.fromkeys(c for c in (group_col, participant_id_col, time_col) if c and c not in (sequence_id_col, order_col)))
    df = canonical(data, sequence_id_col, order_col, state_col, None, meta, row_col)
    name = lambda c: "sequence_id" if c == sequence_id_col else "sequence_order" if c == order_col else c
    time = F.col(name(time_col or order_col)).cast("double").alias("time")
    keys = [time, F.col(name(group_col)).cast("string").alias("group"), F.col(name(participant_id_col)).cast("string").alias("participant")]
    if outcome == "state":
        if target_state is None:
            raise ValidationError("a target state is needed")
        return df.select((F.col("state") == target_state).cast("int").alias("outcome"), *keys)
    if outcome != "transition" or from_state is None or to_state is None:
        raise ValidationError("outcome is state, or transition with both states")
    rows = df.withColumn("_next", F.lead("state").over(by_sequence())).where("_next is not null")
    return rows.select(((F.col("state") == from_state) & (F.col("_next") == to_state)).cast("int").alias("outcome"), *keys)


def spline_basis(x: np.ndarray, low: float, high: float, size: int, degree: int) -> np.ndarray:
    """B-splines on equal knots; outside [low, high] the end polynomials go on."""
    inner = size - degree
    step = (high - low) / inner
    knots = low + step * np.arange(-degree, inner + degree + 1)
    # the interval decides which polynomials hold; beyond the ends it is the last one
    cell = np.clip(np.floor((x - low) / step).astype(int), 0, inner - 1) + degree
    out = np.zeros((len(x), len(knots) - 1))
    out[np.arange(len(x)), cell] = 1
    for d in range(1, degree + 1):
        left = (x[:, None] - knots[None, : -d - 1]) / (d * step)
        right = (knots[None, d + 1 :] - x[:, None]) / (d * step)
        out = left[:, : out.shape[1] - 1] * out[:, :-1] + right[:, : out.shape[1] - 1] * out[:, 1:]
    return out[:, :size]


@dataclass(frozen=True)
class Block:
    """Counts of whole participants. ``parts`` are the first rows of each (participant, group), ``people`` the first parts of each participant."""

    groups: list[str]  # of each part
    times: np.ndarray  # distinct
    at: np.ndarray  # of each row, into times
    n: np.ndarray  # of one participant
    y: np.ndarray  # of all alike
    size: np.ndarray  # participants alike
    parts: np.ndarray
    people: np.ndarray


_BLOCK = "groups array<string>, times binary, at binary, n binary, y binary, size binary, parts binary, people binary"


def _pack(rows: pa.Table) -> list:
    who, group = (rows[c].combine_chunks() for c in ("participant", "group"))
    new = lambda c: np.append(True, np.diff(c.dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0)
    first = new(who)
    parts = np.flatnonzero(first | new(group))
    times, at = np.unique(rows["time"].to_numpy(), return_inverse=True)
    held = [times, at.astype(np.int32), rows["n"].to_numpy().astype(np.int32), *[rows[c].to_numpy().astype(np.int64) for c in ("y", "size")], parts, np.flatnonzero(first[parts])]
    return [group.take(pa.array(parts)).to_pylist(), *[x.tobytes() for x in held]]


def blocks(frame: DataFrame) -> DataFrame:
    """The counts of ``frame`` in blocks of whole participants."""
    n = 2 * frame.sparkSession.sparkContext.defaultParallelism
    cells = frame.withColumn("group", F.coalesce("group", F.lit("None"))).repartition(n, "participant")
    cells = cells.groupBy("participant", "group", "time").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("y"))
    people = cells.groupBy("participant").agg(F.array_sort(F.collect_list(F.struct("group", "time", "n", "y"))).alias("all"), F.sum("y").alias("hits"))
    design = F.transform("all", lambda c: F.struct(c["group"], c["time"], c["n"]))
    rows = people.select(F.sha2(F.to_json(F.struct(design, "hits")), 256).alias("participant"), F.inline("all"))
    cells = rows.groupBy("participant", "group", "time", "n").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("size")).repartition(n, "participant").sortWithinPartitions("participant", "group")

    def run(batches):
        schema = pa.schema([("groups", pa.list_(pa.string())), *[(c.split()[0], pa.binary()) for c in _BLOCK.split(", ")[1:]]])
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(_pack(rows), schema, strict=True)], schema=schema)
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                rows = pa.Table.from_batches(held)
                codes = rows["participant"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                cut = int(np.searchsorted(codes, codes[-1]))  # codes rise with the rows, which are sorted
                if cut:
                    yield out(rows.slice(0, cut))
                    held, size = rows.slice(cut).to_batches(), len(rows) - cut
        if size:
            yield out(pa.Table.from_batches(held))

    return cells.mapInArrow(run, _BLOCK)


def _block(groups: list[str], *held) -> Block:
    return Block(groups, *[np.frombuffer(v, t) for v, t in zip(held, (np.float64, np.int32, np.int32, np.int64, np.int64, np.int64, np.int64), strict=True)])


def summed(packed: DataFrame | list[Block], f: Callable[[Block], np.ndarray], merge: Callable = np.add):
    """``f`` of each block, added up; the driver gets one vector of each task."""
    if isinstance(packed, list):
        return reduce(merge, map(f, packed))

    def run(batches):
        found = (f(_block(groups.as_py(), *[v.as_buffer() for v in held])) for batch in batches for groups, *held in zip(*batch.columns, strict=True))
        if (total := reduce(lambda a, b: b if a is None else merge(a, b), found, None)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    return reduce(merge, [np.asarray(r[0]) for r in packed.mapInArrow(run, "sums array<double>").collect()])


@dataclass(frozen=True)
class TimeModel:
    beta: np.ndarray
    covariance: np.ndarray
    groups: tuple[str, ...]
    low: float
    high: float
    size: int
    degree: int
    centre: np.ndarray
    lambdas: np.ndarray
    edf: float
    deviance_explained: float
    reml: float
    n_observations: int
    outcome: str
    frame: DataFrame

    def columns(self, time: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Intercept, group contrasts, and each group's centred smooth."""
        b = spline_basis(time, self.low, self.high, self.size, self.degree) @ self.centre
        parts = [np.ones((len(time), 1)), *[(group == g)[:, None].astype(float) for g in self.groups[1:]], *[b * (group == g)[:, None] for g in self.groups]]
        return np.hstack(parts)


def fit_time_varying_sequence_model(
    data, group_col, participant_id_col, sequence_id_col="sequence_id", order_col="sequence_order", state_col="state", time_col=None, outcome="state", target_state=None,
    from_state=None, to_state=None, k=5, method="REML", include_random_effect=True, row_col=None,
) -> TimeModel:
    """Penalised iteratively reweighted least squares; smoothing by the generalised Fellner-Schall update of Laplace REML."""
    if method != "REML":
        raise ValidationError("only REML is offered")
    frame = model_frame(data, group_col, participant_id_col, sequence_id_col, order_col, state_col, time_col, outcome, target_state, from_state, to_state, row_col)
    packed = blocks(frame).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts, groups = packed.agg(F.sum(F.octet_length("at") / 4), F.array_distinct(F.flatten(F.collect_set(F.array_distinct("groups"))))).first()
        held = [_block(*r) for r in packed.collect()] if (counts or 0) <= LOCAL else packed
        return _fit(held, frame, tuple(sorted(groups)), outcome, k, include_random_effect)
    finally:
        packed.unpersist()


def _fit(packed: DataFrame | list[Block], frame: DataFrame, groups: tuple[str, ...], outcome: str, k: int, include_random_effect: bool) -> TimeModel:
    some = max(k + 1, 4)  # as many of the least distinct times say how large the basis can be

    def least(a, b):
        both = np.unique(np.concatenate([a[4:], b[4:]]))
        return np.concatenate([a[:3] + b[:3], [max(a[3], b[3])], both[:some]])

    found = summed(packed, lambda b: np.concatenate([[b.n @ b.size, b.y.sum(), b.size[b.parts[b.people]].sum(), b.times[-1]], b.times[:some]]), least) if groups else np.zeros(5)
    total, hits, m, high = found[0], found[1], int(found[2]), found[3]
    low, n_times = found[4], len(found) - 4
    if len(groups) < 2 or n_times < 4 or not 0 < hits < total:
        raise ValidationError("two groups, four times and both outcomes are needed")
    used = min(k, n_times - 1)
    size, degree = used, min(3, used - 1)
    # columns that sum to zero over the data: the null space of their weighted mean
    mean = summed(packed, lambda b: np.bincount(b.at, b.n * b.size, len(b.times)) @ spline_basis(b.times, low, high, size, degree)) / total
    q, _ = np.linalg.qr(np.column_stack([mean, np.eye(size)]))
    centre = q[:, 1:size]
    m = m if include_random_effect else 0
    fixed, r = len(groups), size - 1
    p = fixed * (1 + r)
    difference = np.diff(np.eye(size), 2, axis=0) if size > 2 else np.diff(np.eye(size), 1, axis=0)
    one = centre.T @ difference.T @ difference @ centre
    penalties = []
    for g in range(len(groups)):
        s = np.zeros((p, p))
        at = slice(fixed + g * r, fixed + (g + 1) * r)
        s[at, at] = one
        penalties.append(s)
    lam, lam_z, beta = np.ones(len(groups)), 1.0, np.zeros(p)
    beta[0] = np.log(hits / (total - hits))
    code = {g: i for i, g in enumerate(groups)}

    def statistics(beta: np.ndarray, lam_z: float):
        """At beta and the participants' best intercepts: X'WX, X'(y - n mu), the sums of c c' / d, of c c' / d^2 (c and d: a participant's
        columns of the cross block and the diagonal), and of 1 / d, log d, u^2 and the log-likelihood."""

        def run(b: Block) -> np.ndarray:
            part_group = np.array([code[g] for g in b.groups])
            basis = spline_basis(b.times, low, high, size, degree) @ centre
            level = beta[0] + np.append(0.0, beta[1:fixed])
            cell = np.repeat(part_group, np.diff(np.append(b.parts, len(b.n)))) * len(b.times) + b.at
            base = (level[:, None] + beta[fixed:].reshape(fixed, r) @ basis.T).ravel()[cell]
            first = b.parts[b.people]
            lengths, n, y, alike = np.diff(np.append(first, len(b.n))), b.n.astype(float), b.y.astype(float), b.size[first].astype(float)
            u = np.zeros(len(b.people))
            for left in range(100 if m else 1, 0, -1):
                eta = base + np.repeat(u, lengths) if m else base
                mu = np.clip(1 / (1 + np.exp(-np.clip(eta, -30, 30))), 1e-10, 1 - 1e-10)
                fit = n * mu
                w, rest = fit * (1 - mu), y / b.size - fit
                if m:  # each intercept's own Newton steps, which are held small
                    d = np.add.reduceat(w, first) + lam_z
                    step = np.clip((np.add.reduceat(rest, first) - lam_z * u) / d, -2, 2)
                    if left == 1 or np.abs(step).max() < 1e-11:
                        break
                    u += step
            by_cell = lambda v: np.bincount(cell, v, fixed * len(b.times)).reshape(fixed, len(b.times))
            weight, gradient, xtwx, score = by_cell(w * b.size), by_cell(y - b.size * fit), np.zeros((p, p)), np.zeros(p)
            for g in range(fixed):
                own = np.unique([0, g, *range(fixed + g * r, fixed + (g + 1) * r)])
                x = np.hstack([np.ones((len(b.times), len(own) - r)), basis])
                xtwx[np.ix_(own, own)] += x.T @ (weight[g][:, None] * x)
                score[own] += x.T @ gradient[g]
            half = np.zeros((p, p))
            extra = [half, half, [0.0, 0.0, 0.0]]
            if m:  # participant intercepts are a diagonal block, so they are eliminated exactly
                person = np.repeat(np.arange(len(b.people)), np.diff(np.append(b.people, len(b.parts))))
                c, held = np.zeros((len(b.people), p)), np.add.reduceat(w, b.parts)
                np.add.at(c[:, 0], person, held)
                np.add.at(c, (person[part_group > 0], part_group[part_group > 0]), held[part_group > 0])
                for j in range(r):
                    c[person, fixed + part_group * r + j] = np.add.reduceat(w * basis[b.at, j], b.parts)
                e, many = c / d[:, None], alike[:, None]
                extra = [c.T @ (e * many), e.T @ (e * many), [(alike / d).sum(), alike @ np.log(d), alike @ u**2]]
            likelihood = float((y * np.log(mu) + (b.size * n - y) * np.log(1 - mu)).sum())
            return np.concatenate([np.ravel(v) for v in (xtwx, score, *extra, [likelihood])])

        got = np.split(summed(packed, run), np.cumsum([p * p, p, p * p, p * p]))
        return got[0].reshape(p, p), got[1], got[2].reshape(p, p), got[3].reshape(p, p), got[4]

    for _ in range(200):
        s = sum(v * q_ for v, q_ in zip(lam, penalties, strict=True))
        for _ in range(30):
            xtwx, score, cross, squares, (inverse, logs, uu, loglik) = statistics(beta, lam_z)
            xtwx = xtwx + s + 1e-9 * np.eye(p)
            schur = xtwx - cross
            step = np.linalg.solve(schur, score - (s + 1e-9 * np.eye(p)) @ beta)
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                break
        cov = np.linalg.inv(schur)
        before = np.append(lam, lam_z)
        for g, q_ in enumerate(penalties):
            rank = np.linalg.matrix_rank(one)
            quad = beta @ q_ @ beta
            lam[g] = np.clip(lam[g] * max(rank / lam[g] - np.trace(cov @ q_), 1e-8) / max(quad, 1e-10), 1e-6, 1e8)
        if m:
            trace = inverse + (cov * squares).sum()
            lam_z = float(np.clip(lam_z * max(m / lam_z - trace, 1e-8) / max(uu, 1e-10), 1e-6, 1e8))
        if np.abs(np.log(np.append(lam, lam_z) / before)).max() < 1e-4:
            break
    if not np.isfinite(beta).all():
        raise ModelFitError("the fit diverged")
    s = sum(v * q_ for v, q_ in zip(lam, penalties, strict=True))
    base = hits / total
    null = float(hits * np.log(base) + (total - hits) * np.log(1 - base))
    edf = float(np.trace(cov @ (xtwx - s))) if not m else float(p - np.trace(cov @ s))
    reml = -loglik + 0.5 * float(beta @ s @ beta) + 0.5 * float(np.linalg.slogdet(schur)[1]) + (0.5 * lam_z * float(uu) + 0.5 * float(logs - m * np.log(lam_z)) if m else 0.0)
    return TimeModel(beta, cov, groups, low, high, size, degree, centre, lam, edf, float(1 - loglik / null), float(reml), int(total), outcome, frame)


def predict_time_varying_sequence_model(model: TimeModel, time=None, groups=None, level=0.95) -> DataFrame:
    """Population probabilities with intervals from the logit scale, on 100 times unless given."""
    from statistics import NormalDist

    grid = np.linspace(model.low, model.high, 100) if time is None else np.asarray(time, float)
    names = list(groups or model.groups)
    if set(names) - set(model.groups):
        raise ValidationError("unknown groups")
    t, g = np.tile(grid, len(names)), np.repeat(names, len(grid))
    x = model.columns(t, g)
    eta, se = x @ model.beta, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, model.covariance, x), 0))
    half = NormalDist().inv_cdf(0.5 + level / 2) * se
    p = [1 / (1 + np.exp(-v)) for v in (eta, eta - half, eta + half)]
    rows = [(float(a), str(b), *[float(v[i]) for v in p], model.outcome) for i, (a, b) in enumerate(zip(t, g, strict=True))]
    return model.frame.sparkSession.createDataFrame(rows, "time double, group string, estimate double, lower double, upper double, outcome string")


def summarise_time_varying_sequence_model(model: TimeModel) -> DataFrame:
    row = (model.outcome, len(model.groups), model.n_observations, model.size, model.degree, model.edf, model.deviance_explained, model.reml)
    return model.frame.sparkSession.createDataFrame([row], "outcome string, n_groups long, n_observations long, basis_size long, degree long, edf double, deviance_explained double, reml double")


def plot_time_varying_sequence_model(model: TimeModel, time=None, level=0.95, show_interval=True) -> DataFrame:
    rows = predict_time_varying_sequence_model(model, time, level=level)
    return rows if show_interval else rows.drop("lower", "upper")
