"""Queries of clustering, latent-state models, inference and time models; SQL can express some of their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, distance, hmm, inference, meta, timemodel
from ..sources import tables as t
from .basic import _r

_E = t.EVT_SQL


def _users(s, d):
    """The event paths: as many sequences as there are users of the folder's size."""
    return t.events(s, d)


def _paths(s, d):
    """The conversations: short sequences of roles."""
    return t.conversations(s, d)


def _distances(s, d):
    """Distances between the role paths of all conversations."""
    return distance.compute_sequence_distance(t.conversations(s, d), **t.CONV)


def _clusters(s, d, **more):
    return cluster.cluster_sequences(_distances(s, d), 3, **more)


def _hmm(s, d):
    return hmm.fit_sequence_hmm(_paths(s, d), 2, "conv_id", "turn", "role", max_iter=8)


def _cov(s, d):
    df = _paths(s, d).withColumn("condition", (F.col("conv_id") % 2).cast("int"))
    return hmm.fit_covariate_sequence_hmm(df, 2, ["condition"], ["condition"], "conv_id", "turn", "role", max_iter=4)


def _multi(s, d):
    df = _paths(s, d).withColumn("half", F.when(F.col("turn") < 3, "early").otherwise("late"))
    return hmm.fit_multichannel_sequence_hmm(df, 2, ["role", "half"], "conv_id", "turn", max_iter=5)


_DESIGN = inference.declare_sequence_comparison_design("grp", "user_id")


def _test(s, d):
    return inference.test_sequence_group_difference(_users(s, d), _DESIGN, "sequence_length", n_permutations=199, sequence_id_col="user_id", order_col="ord", state_col="event_type", row_col="event_id")


def _frame(s, d, **more):
    return timemodel.model_frame(_users(s, d), "grp", "user_id", "user_id", "ord", "event_type", row_col="event_id", **more)


def _gamm(s, d):
    return timemodel.fit_time_varying_sequence_model(_users(s, d), "grp", "user_id", "user_id", "ord", "event_type", target_state="click", row_col="event_id")


QUERIES = {
    "cluster_hier": lambda s, d: _clusters(s, d).assignments,
    "cluster_pam": lambda s, d: _clusters(s, d, method="pam").assignments,
    "cluster_clara": lambda s, d: _clusters(s, d, method="clara").assignments,
    "cluster_validate": lambda s, d: cluster.validate_sequence_clusters(_clusters(s, d)).overall,
    "cluster_representatives": lambda s, d: cluster.extract_representative_sequences(_clusters(s, d)),
    "silhouette_data": lambda s, d: cluster.plot_sequence_cluster_silhouette(_clusters(s, d)),
    "cluster_bootstrap": lambda s, d: cluster.bootstrap_sequence_clusters(_distances(s, d), 3, n_boot=12).overall,
    "cluster_stability": lambda s, d: cluster.summarise_sequence_cluster_stability(cluster.bootstrap_sequence_clusters(_distances(s, d), 3, n_boot=12))[0],
    "cluster_ensemble": lambda s, d: cluster.create_sequence_cluster_ensemble(_clusters(s, d), _clusters(s, d, method="pam"), k=3)[0].assignments,
    "hmm_fit": lambda s, d: hmm.summarise_sequence_hmm(_hmm(s, d))["emission"],
    "hmm_mixture": lambda s, d: hmm.summarise_sequence_hmm(hmm.fit_sequence_hmm_mixture(_paths(s, d), 2, 2, "conv_id", "turn", "role", max_iter=5))["mixture"],
    "hmm_decode": lambda s, d: hmm.decode_sequence_states(_hmm(s, d)),
    "hmm_compare": lambda s, d: hmm.compare_sequence_hmms(two=_hmm(s, d), one=hmm.fit_sequence_hmm(_paths(s, d), 1, "conv_id", "turn", "role", max_iter=2)),
    "hmm_multichannel": lambda s, d: hmm.summarise_multichannel_sequence_hmm(_multi(s, d))["emission"],
    "hmm_multichannel_decode": lambda s, d: hmm.decode_multichannel_sequence_states(_multi(s, d)),
    "hmm_multichannel_plot": lambda s, d: hmm.plot_multichannel_sequence_hmm(_multi(s, d), "half"),
    "hmm_covariate": lambda s, d: hmm.summarise_covariate_sequence_hmm(_cov(s, d))["transition"],
    "hmm_covariate_decode": lambda s, d: hmm.decode_covariate_sequence_states(_cov(s, d)),
    "hmm_cov_predict": lambda s, d: hmm.predict_covariate_transition_probabilities(_cov(s, d), s.createDataFrame([(0,), (1,)], "condition int")),
    "infer_unit_table": lambda s, d: _r(inference.unit_table(_users(s, d), _DESIGN, "state_prevalence", "click", sequence_id_col="user_id", order_col="ord", state_col="event_type", row_col="event_id")),
    "infer_presence": lambda s, d: _r(inference.unit_table(_users(s, d), _DESIGN, "subsequence_presence", target_subsequence="click > view", sequence_id_col="user_id", order_col="ord", state_col="event_type", row_col="event_id")),
    "infer_observed_diff": lambda s, d: _r(inference.observed_difference(inference.unit_table(_users(s, d), _DESIGN, "sequence_length", sequence_id_col="user_id", order_col="ord", state_col="event_type", row_col="event_id"))),
    "infer_permutation": lambda s, d: _test(s, d).estimate,
    "infer_bootstrap": lambda s, d: inference.bootstrap_sequence_group_difference(_test(s, d), n_boot=199).interval,
    "infer_summary": lambda s, d: inference.summarise_sequence_group_inference(_test(s, d))["groups"],
    "infer_histogram": lambda s, d: inference.plot_sequence_group_inference(_test(s, d)),
    "gamm_model_frame_state": lambda s, d: _frame(s, d, target_state="click").groupBy("group", "participant").agg(F.sum("outcome").alias("y"), F.count(F.lit(1)).alias("n")),
    "gamm_model_frame_transition": lambda s, d: _frame(s, d, outcome="transition", from_state="click", to_state="view").groupBy("group", "time").agg(F.sum("outcome").alias("y"), F.count(F.lit(1)).alias("n")),
    "gamm_predict": lambda s, d: timemodel.predict_time_varying_sequence_model(_gamm(s, d)),
    "gamm_summary": lambda s, d: timemodel.summarise_time_varying_sequence_model(_gamm(s, d)),
    "gamm_plot": lambda s, d: timemodel.plot_time_varying_sequence_model(_gamm(s, d), show_interval=False),
    "capabilities": lambda s, d: meta.sequence_capabilities(s),
    "result_audit": lambda s, d: meta.audit_sequence_analysis(_distances(s, d), s)[0],
    "result_compare": lambda s, d: meta.compare_sequence_analysis_results(_distances(s, d), _distances(s, d), s, compare_values=True).where("field = 'values'"),
}

ORACLES = {
    "infer_unit_table": f'WITH {_E} SELECT sequence_id AS unit, grp AS "group", round(count(*) FILTER (state = \'click\') / CAST(count(*) AS DOUBLE), 6) AS metric, CAST(1 AS BIGINT) AS n_sequences FROM evt GROUP BY ALL',
    "infer_presence": f"WITH {_E}, q AS (SELECT sequence_id, grp, state, lead(state) OVER (PARTITION BY sequence_id ORDER BY ord) AS nxt FROM evt) SELECT sequence_id AS unit, grp AS \"group\", CAST(max(CASE WHEN state = 'click' AND nxt = 'view' THEN 1 ELSE 0 END) AS DOUBLE) AS metric, CAST(1 AS BIGINT) AS n_sequences FROM q GROUP BY ALL",
    "infer_observed_diff": f"WITH {_E}, u AS (SELECT grp, sequence_id, count(*) AS n FROM evt GROUP BY ALL), m AS (SELECT grp, avg(n) AS m FROM u GROUP BY grp) SELECT a.grp AS group_1, b.grp AS group_2, round(a.m, 6) AS mean_group_1, round(b.m, 6) AS mean_group_2, round(b.m - a.m, 6) AS difference_group_2_minus_group_1 FROM m a JOIN m b ON a.grp < b.grp",
    "gamm_model_frame_state": f"WITH {_E} SELECT grp AS \"group\", sequence_id AS participant, CAST(count(*) FILTER (state = 'click') AS BIGINT) AS y, count(*) AS n FROM evt GROUP BY ALL",
    "gamm_model_frame_transition": f"WITH {_E}, q AS (SELECT grp, ord, state, lead(state) OVER (PARTITION BY sequence_id ORDER BY ord) AS nxt FROM evt) SELECT grp AS \"group\", CAST(ord AS DOUBLE) AS time, CAST(count(*) FILTER (state = 'click' AND nxt = 'view') AS BIGINT) AS y, count(*) AS n FROM q WHERE nxt IS NOT NULL GROUP BY ALL",
    "result_compare": "SELECT 'values' AS field, '0' AS x, '0' AS y, true AS equal",
}
