"""Queries of consensus, groups, distances, networks, panels, plot data, adapters and audits, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus, distance, interop, network, panel, plotdata, research
from ..sources import tables as t
from .basic import _r

_E, _C, _P = t.EVT_SQL, t.CONV_SQL, t.PAN_SQL


def _cons(s, d, **more):
    return consensus.create_consensus_sequence(t.conversations(s, d), **t.CONV, group_cols=["grp"], **more)


def _weighted(s, d):
    return consensus.create_consensus_sequence(t.events(s, d), **t.EVT, weight_col="value", row_col="event_id")


def _groups(s, d):
    return consensus.compare_sequence_groups(t.events(s, d), "grp", **t.EVT, row_col="event_id")


def _net(s, d, **more):
    return network.create_transition_network(t.events(s, d), **t.EVT, row_col="event_id", **more)


def _short(s, d):
    """The conversations again: short sequences of three roles."""
    return t.conversations(s, d)


def _dist(s, d, **more):
    return distance.compute_sequence_distance(_short(s, d), **t.CONV, **more)


def _pan(s, d):
    return panel.prepare_sequence_panel(t.panels(s, d), "panel_id", "occasion", **t.PAN)


def _transfer(s, d):
    df = t.events(s, d).withColumn("who", F.col("user_id"))
    return research.sequence_transfer_audit(df, dataset_col="grp", participant_col="who", sequence_col="user_id", order_col="ord", state_col="event_type")


def _smooth(s, d):
    """Reference, raw and smoothed labels: types, high values, and types with every seventh row changed."""
    df = t.events(s, d).withColumns({"raw": F.when(F.col("event_id") % 7 == 0, "noise").otherwise(F.col("event_type")), "smooth": F.when(F.col("event_id") % 11 == 0, "noise").otherwise(F.col("event_type")), "trial": F.lit(1)})
    return research.audit_smoothing_event_preservation(df, participant_col="user_id", trial_col="trial", order_col="ord", true_col="event_type", raw_col="raw", smoothed_col="smooth")


def _predict(s, d):
    m = network.fit_higher_order_transition_model(t.events(s, d), **t.EVT, order=2, row_col="event_id")
    return _r(network.predict_next_state(m, ["click", "purchase"]), "next_state", "used_order", "used_context", "probability")


def _inferred(s, d):
    df = t.conversations(s, d).toDF("trial_id", "position", "aoi", "grp")
    return interop.prepare_inferred_sequences(df).data.select("sequence_id", "sequence_order", "state")


QUERIES = {
    "consensus": lambda s, d: _r(_cons(s, d), "grp", "sequence_order", "consensus_state", "support_n", "agreement", "tie_n", "n_sequences"),
    "consensus_weighted": lambda s, d: _r(_weighted(s, d), "sequence_order", "consensus_state", "support_weight", "agreement", digits=4),
    "consensus_ties": lambda s, d: _cons(s, d, tie_method="all").select("grp", "sequence_order", "tied_states", "tie_n"),
    "consensus_agreement": lambda s, d: _r(consensus.summarise_consensus_agreement(_cons(s, d), by="group", threshold=0.6)),
    "consensus_path": lambda s, d: consensus.format_consensus_sequence(_cons(s, d)),
    "consensus_plot": lambda s, d: consensus.plot_consensus_sequence(_cons(s, d, tie_method="missing")).select("grp", "sequence_order", "plot_label"),
    "group_states": lambda s, d: _r(_groups(s, d).states),
    "group_transitions": lambda s, d: _r(_groups(s, d).transitions),
    "group_lengths": lambda s, d: _r(_groups(s, d).lengths),
    "group_state_contrasts": lambda s, d: _r(_groups(s, d).state_contrasts, "group_1", "group_2", "state", "event_share_difference", "event_share_ratio", "sequence_prevalence_difference", digits=5),
    "group_transition_contrasts": lambda s, d: _r(_groups(s, d).transition_contrasts, "group_1", "group_2", "transition", "occurrence_share_difference", digits=5),
    "group_length_contrasts": lambda s, d: _r(_groups(s, d).length_contrasts),
    "group_plot": lambda s, d: _r(consensus.plot_sequence_group_comparison(_groups(s, d), top_n=3)),
    "network_count": lambda s, d: _r(_net(s, d), "context", "to_state", "count", "weight", "sequence_count", "sequence_prevalence"),
    "network_from": lambda s, d: _r(_net(s, d, normalise="from", smoothing=0.5), "context", "to_state", "count", "weight"),
    "network_global": lambda s, d: _r(_net(s, d, normalise="global", include_self=False), "context", "to_state", "weight"),
    "network_grouped": lambda s, d: _r(_net(s, d, normalise="from", group_cols=["grp"]), "grp", "context", "to_state", "weight", "sequence_prevalence"),
    "network_order2": lambda s, d: _r(_net(s, d, normalise="from", order=2), "context", "to_state", "count", "weight"),
    "network_degree_strength": lambda s, d: _r(network.summarise_transition_centrality(_net(s, d)), "state", "out_degree", "in_degree", "total_degree", "out_strength", "in_strength", "total_strength"),
    "network_pagerank": lambda s, d: _r(network.summarise_transition_centrality(_net(s, d)), "state", "pagerank", digits=4),
    "network_closeness_betweenness": lambda s, d: network.summarise_transition_centrality(_net(s, d)).select("state", "closeness", "betweenness"),
    "network_components": lambda s, d: network.detect_transition_communities(_net(s, d), method="components"),
    "network_labelprop": lambda s, d: network.detect_transition_communities(_net(s, d)),
    "network_bootstrap": lambda s, d: network.bootstrap_transition_network(t.events(s, d), **t.EVT, n_boot=50, row_col="event_id"),
    "edge_threshold": lambda s, d: _r(network.plot_transition_network(_net(s, d, normalise="from"), minimum_weight=0.2), "from_state", "to_state", "weight"),
    "markov_table": lambda s, d: _r(network.fit_higher_order_transition_model(t.events(s, d), **t.EVT, order=2, row_col="event_id")),
    "markov_predict": _predict,
    "dist_levenshtein": lambda s, d: _dist(s, d).pairs,
    "dist_levenshtein_norm": lambda s, d: _r(_dist(s, d, normalise="max_length").pairs),
    "dist_transition": lambda s, d: _r(_dist(s, d, method="transition").pairs, digits=5),
    "dist_lcs": lambda s, d: _dist(s, d, method="lcs").pairs,
    "dist_om": lambda s, d: _dist(s, d, method="optimal_matching", indel_cost=1, substitution_cost=1).pairs,
    "dist_summary": lambda s, d: _r(distance.summarise_sequence_distance(_dist(s, d))[0]),
    "dist_per_sequence": lambda s, d: _r(distance.summarise_sequence_distance(_dist(s, d))[1]),
    "heatmap_order": lambda s, d: distance.plot_sequence_distance_heatmap(_dist(s, d)),
    "panel_index": lambda s, d: _pan(s, d).index,
    "panel_occasions": lambda s, d: _r(panel.summarise_sequence_panel(_pan(s, d))[0]),
    "panel_states": lambda s, d: _r(panel.summarise_sequence_panel(_pan(s, d))[1]),
    "panel_changes": lambda s, d: panel.compare_sequence_panel_changes(_pan(s, d)).select("panel_id", "from_rank", "to_rank", "distance", "length_change", "transition_change"),
    "panel_changes_transition": lambda s, d: panel.compare_sequence_panel_changes(_pan(s, d), method="transition"),
    "panel_change_summary": lambda s, d: _r(panel.plot_sequence_panel_changes(panel.compare_sequence_panel_changes(_pan(s, d)), metric="length_change", type="summary")),
    "index_matrix_long": lambda s, d: plotdata.plot_sequence_index(t.conversations(s, d), **t.CONV, sort_by="length"),
    "state_distribution": lambda s, d: _r(plotdata.plot_sequence_state_distribution(t.conversations(s, d), **t.CONV)),
    "entropy_by_position": lambda s, d: _r(plotdata.plot_sequence_entropy(t.conversations(s, d), **t.CONV)),
    "wide_sequences": lambda s, d: interop.as_traminer_sequences(t.conversations(s, d), **t.CONV, missing="-").select("sequence_id", "position_0", "position_1"),
    "wide_sequences_hidden": lambda s, d: interop.as_seqhmm_sequences(t.conversations(s, d), **t.CONV).select("sequence_id", "position_0"),
    "itemsets": lambda s, d: interop.as_arules_sequences(t.conversations(s, d), **t.CONV).select("sequence_id", F.element_at("items", 1).alias("item"), "sequenceID", "eventID"),
    "string_encoding": lambda s, d: interop.as_grpstring_data(t.conversations(s, d), **t.CONV)[0],
    "vertices_edges": lambda s, d: _r(interop.as_igraph_transition_network(_net(s, d), directed=False)[1], "source", "target", "count"),
    "inferred_mapping": _inferred,
    "transfer_js": lambda s, d: _r(_transfer(s, d).domain),
    "transfer_nll": lambda s, d: _r(_transfer(s, d).sources, digits=5),
    "transfer_entropy": lambda s, d: _r(_transfer(s, d).prediction, "target", "transition_conditional_entropy"),
    "smoothing_events": lambda s, d: _smooth(s, d)[0],
    "smoothing_trials": lambda s, d: _r(_smooth(s, d)[1]),
}

_NS = "CAST((SELECT count(DISTINCT sequence_id) FROM {src}) AS DOUBLE)"
_CONS = f"""WITH {_C}, p AS (SELECT grp, ord, state, count(*) AS n FROM conv GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY grp, ord) AS top, sum(n) OVER (PARTITION BY grp, ord) AS tot FROM p),
c AS (SELECT grp, ord AS sequence_order, min(state) AS consensus_state, max(tot) AS support_n, max(top) / max(tot) AS agreement, count(*) AS tie_n, string_agg(state, ' | ' ORDER BY state) AS tied_states FROM m WHERE n = top GROUP BY grp, ord),
k AS (SELECT grp, count(DISTINCT sequence_id) AS n_sequences FROM conv GROUP BY grp)"""
_GRP = f"""WITH {_E}, z AS (SELECT grp, count(DISTINCT sequence_id) AS ns FROM evt GROUP BY grp), g AS (SELECT grp, state, count(*) AS event_count, count(DISTINCT sequence_id) AS sequence_count FROM evt GROUP BY ALL),
st AS (SELECT grp, state, event_count, event_count / sum(event_count) OVER (PARTITION BY grp) AS event_share, sequence_count, sequence_count / CAST(ns AS DOUBLE) AS sequence_prevalence FROM g JOIN z USING (grp)),
q AS (SELECT grp, sequence_id, state || ' -> ' || lead(state) OVER (PARTITION BY sequence_id ORDER BY ord) AS transition FROM evt),
h AS (SELECT grp, transition, count(*) AS occurrence_count, count(DISTINCT sequence_id) AS sequence_count FROM q WHERE transition IS NOT NULL GROUP BY ALL),
tr AS (SELECT grp, transition, occurrence_count, occurrence_count / sum(occurrence_count) OVER (PARTITION BY grp) AS occurrence_share, sequence_count, sequence_count / CAST(ns AS DOUBLE) AS sequence_prevalence FROM h JOIN z USING (grp)),
ln AS (SELECT grp, count(*) AS n_sequences, avg(n) AS mean_length, median(n) AS median_length, min(n) AS min_length, max(n) AS max_length, stddev_samp(n) AS sd_length FROM (SELECT grp, sequence_id, count(*) AS n FROM evt GROUP BY ALL) GROUP BY grp)"""
_NET = f"WITH {_E}, p AS (SELECT sequence_id, grp, state AS context, lead(state) OVER w AS to_state, lead(state, 2) OVER w AS s2 FROM evt WINDOW w AS (PARTITION BY sequence_id ORDER BY ord)), e AS (SELECT context, to_state, CAST(count(*) AS DOUBLE) AS count, count(DISTINCT sequence_id) AS sequence_count FROM p WHERE to_state IS NOT NULL GROUP BY ALL)"
_PAIR = f"WITH {_C}, s AS (SELECT sequence_id, string_agg(state[1], '' ORDER BY ord) AS code, count(*) AS n FROM conv GROUP BY sequence_id), d AS (SELECT a.sequence_id AS sequence_id_1, b.sequence_id AS sequence_id_2, CAST(levenshtein(a.code, b.code) AS DOUBLE) AS distance, a.n AS n1, b.n AS n2, a.code AS c1, b.code AS c2 FROM s a JOIN s b ON a.sequence_id < b.sequence_id)"
_PANQ = f"WITH {_P}, x AS (SELECT sequence_id, panel_id, occasion, ord, state, lag(state) OVER (PARTITION BY sequence_id ORDER BY ord) AS last FROM pan), i AS (SELECT sequence_id, panel_id, occasion, count(*) AS sequence_length, count(*) FILTER (last IS NOT NULL AND last != state) AS transition_count, string_agg(state[1], '' ORDER BY ord) AS code FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY occasion, sequence_id) AS occasion_rank FROM i), c AS (SELECT panel_id, occasion, occasion_rank AS from_rank, lead(occasion) OVER w AS to_occasion, lead(occasion_rank) OVER w AS to_rank, CAST(levenshtein(code, lead(code) OVER w) AS DOUBLE) AS distance, lead(sequence_length) OVER w - sequence_length AS length_change, lead(transition_count) OVER w - transition_count AS transition_change FROM r WINDOW w AS (PARTITION BY panel_id ORDER BY occasion_rank))"
_TRANS = f"WITH {_E}, m AS (SELECT grp, sequence_id, state, lead(state) OVER (PARTITION BY sequence_id ORDER BY ord) AS nxt FROM evt), mv AS (SELECT * FROM m WHERE nxt IS NOT NULL), sp AS (SELECT grp, sequence_id, row_number() OVER (PARTITION BY grp ORDER BY CAST(sequence_id AS BIGINT)) % 2 = 1 AS train FROM (SELECT DISTINCT grp, sequence_id FROM evt)), tm AS (SELECT mv.*, train FROM mv JOIN sp USING (grp, sequence_id))"


def _js(src: str, key: str, name: str) -> str:
    return (
        f"(SELECT 'g0' AS source, 'g1' AS target, sum(CASE WHEN a > 0 THEN 0.5 * a * log2(a / ((a+b)/2)) ELSE 0 END + CASE WHEN b > 0 THEN 0.5 * b * log2(b / ((a+b)/2)) ELSE 0 END) AS {name} FROM "
        f"(SELECT {key} AS k, count(*) FILTER (grp='g0') / CAST((SELECT count(*) FROM {src} WHERE grp='g0') AS DOUBLE) AS a, count(*) FILTER (grp='g1') / CAST((SELECT count(*) FROM {src} WHERE grp='g1') AS DOUBLE) AS b FROM {src} GROUP BY 1))"
    )


_SM = f"WITH {_E}, l AS (SELECT CAST(sequence_id AS BIGINT) AS participant_id, 1 AS trial_id, ord, state AS ref, CASE WHEN event_id % 7 = 0 THEN 'noise' ELSE state END AS raw, CASE WHEN event_id % 11 = 0 THEN 'noise' ELSE state END AS sm FROM evt), f AS (SELECT *, CASE WHEN ref != lag(ref) OVER w THEN 1 ELSE 0 END AS cr, CASE WHEN raw != lag(raw) OVER w THEN 1 ELSE 0 END AS cw, CASE WHEN sm != lag(sm) OVER w THEN 1 ELSE 0 END AS cs FROM l WINDOW w AS (PARTITION BY participant_id ORDER BY ord)), u AS (SELECT *, sum(cr) OVER (PARTITION BY participant_id ORDER BY ord) AS run FROM f)"
ORACLES = {
    "consensus": _CONS + " SELECT c.grp, sequence_order, consensus_state, support_n, round(agreement, 6) AS agreement, tie_n, n_sequences FROM c JOIN k USING (grp)",
    "consensus_weighted": f"WITH {_E}, p AS (SELECT ord, state, sum(duration) AS w FROM evt GROUP BY ALL), m AS (SELECT *, max(w) OVER (PARTITION BY ord) AS top, sum(w) OVER (PARTITION BY ord) AS tot FROM p) SELECT ord AS sequence_order, min(state) AS consensus_state, round(max(tot), 4) AS support_weight, round(max(top) / max(tot), 4) AS agreement FROM m WHERE w >= top - 1.49e-8 GROUP BY ord",
    "consensus_ties": _CONS + " SELECT grp, sequence_order, tied_states, tie_n FROM c",
    "consensus_agreement": _CONS + " SELECT grp, count(*) AS n_positions, round(avg(agreement), 6) AS mean_agreement, round(median(agreement), 6) AS median_agreement, round(min(agreement), 6) AS min_agreement, round(max(agreement), 6) AS max_agreement, round(sum(agreement * support_n) / sum(support_n), 6) AS weighted_agreement, count(*) FILTER (tie_n > 1) AS n_ties, count(*) FILTER (agreement < 0.6) AS n_below_threshold, CAST(0.6 AS DOUBLE) AS threshold FROM c GROUP BY grp",
    "consensus_path": _CONS + " SELECT grp, string_agg(consensus_state, ' -> ' ORDER BY sequence_order) AS path, count(*) AS n_positions FROM c GROUP BY grp",
    "consensus_plot": _CONS + " SELECT grp, sequence_order, CASE WHEN tie_n > 1 THEN '<TIE>' ELSE consensus_state END AS plot_label FROM c",
    "group_states": _GRP + ' SELECT grp AS "group", state, event_count, round(event_share, 6) AS event_share, sequence_count, round(sequence_prevalence, 6) AS sequence_prevalence FROM st',
    "group_transitions": _GRP + ' SELECT grp AS "group", transition, occurrence_count, round(occurrence_share, 6) AS occurrence_share, sequence_count, round(sequence_prevalence, 6) AS sequence_prevalence FROM tr',
    "group_lengths": _GRP + ' SELECT grp AS "group", n_sequences, round(mean_length, 6) AS mean_length, median_length, min_length, max_length, round(sd_length, 6) AS sd_length FROM ln',
    "group_state_contrasts": _GRP + " SELECT 'g0' AS group_1, 'g1' AS group_2, state, round(coalesce(a.event_share,0) - coalesce(b.event_share,0), 5) AS event_share_difference, round(coalesce(a.event_share,0) / nullif(coalesce(b.event_share,0), 0), 5) AS event_share_ratio, round(coalesce(a.sequence_prevalence,0) - coalesce(b.sequence_prevalence,0), 5) AS sequence_prevalence_difference FROM (SELECT * FROM st WHERE grp='g0') a FULL JOIN (SELECT * FROM st WHERE grp='g1') b USING (state)",
    "group_transition_contrasts": _GRP + " SELECT 'g0' AS group_1, 'g1' AS group_2, transition, round(coalesce(a.occurrence_share,0) - coalesce(b.occurrence_share,0), 5) AS occurrence_share_difference FROM (SELECT * FROM tr WHERE grp='g0') a FULL JOIN (SELECT * FROM tr WHERE grp='g1') b USING (transition)",
    "group_length_contrasts": _GRP + " SELECT a.grp AS group_1, b.grp AS group_2, round(a.mean_length, 6) AS mean_length_group_1, round(b.mean_length, 6) AS mean_length_group_2, round(a.mean_length - b.mean_length, 6) AS mean_length_difference, a.median_length AS median_length_group_1, b.median_length AS median_length_group_2, a.median_length - b.median_length AS median_length_difference FROM ln a JOIN ln b ON a.grp < b.grp",
    "group_plot": _GRP + ', top AS (SELECT state FROM st GROUP BY state ORDER BY max(event_share) DESC, state LIMIT 3) SELECT state AS key, grp AS "group", round(event_share, 6) AS value FROM st JOIN top USING (state)',
    "network_count": _NET + " SELECT context, to_state, count, count AS weight, sequence_count, round(sequence_count / " + _NS.format(src="evt") + ", 6) AS sequence_prevalence FROM e",
    "network_from": _NET + " SELECT context, to_state, count + 0.5 AS count, round((count + 0.5) / sum(count + 0.5) OVER (PARTITION BY context), 6) AS weight FROM e",
    "network_global": _NET + " SELECT context, to_state, round(count / sum(count) OVER (), 6) AS weight FROM e WHERE context != to_state",
    "network_grouped": _NET + ", z AS (SELECT grp, count(DISTINCT sequence_id) AS ns FROM evt GROUP BY grp), h AS (SELECT grp, context, to_state, count(*) AS c, count(DISTINCT sequence_id) AS sc FROM p WHERE to_state IS NOT NULL GROUP BY ALL) SELECT grp, context, to_state, round(c / sum(c) OVER (PARTITION BY grp, context), 6) AS weight, round(sc / CAST(ns AS DOUBLE), 6) AS sequence_prevalence FROM h JOIN z USING (grp)",
    "network_order2": _NET + ", h AS (SELECT context || ' > ' || to_state AS context, s2 AS to_state, CAST(count(*) AS DOUBLE) AS count FROM p WHERE s2 IS NOT NULL GROUP BY ALL) SELECT context, to_state, count, round(count / sum(count) OVER (PARTITION BY context), 6) AS weight FROM h",
    "network_degree_strength": _NET + ", o AS (SELECT context AS state, count(*) AS od, sum(count) AS os FROM e GROUP BY 1), i AS (SELECT to_state AS state, count(*) AS id, sum(count) AS ins FROM e GROUP BY 1) SELECT state, coalesce(od,0) AS out_degree, coalesce(id,0) AS in_degree, coalesce(od,0)+coalesce(id,0) AS total_degree, coalesce(os,0) AS out_strength, coalesce(ins,0) AS in_strength, coalesce(os,0)+coalesce(ins,0) AS total_strength FROM o FULL JOIN i USING (state)",
    "network_pagerank": ("WITH RECURSIVE " + _NET[5:] + ", st AS (SELECT DISTINCT state FROM evt), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM st), q AS (SELECT a.state AS f, b.state AS g, coalesce(e.count / sum(e.count) OVER (PARTITION BY a.state), 0) AS w FROM st a CROSS JOIN st b LEFT JOIN e ON e.context = a.state AND e.to_state = b.state), "
      "v AS (SELECT 0 AS k, state, 1 / (SELECT n FROM n) AS x FROM st UNION ALL SELECT DISTINCT v.k + 1, q.g, 0.15 / (SELECT n FROM n) + 0.85 * sum(v.x * q.w) OVER (PARTITION BY q.g) FROM v JOIN q ON q.f = v.state WHERE v.k < 40) SELECT state, round(max(x), 4) AS pagerank FROM v WHERE k = 40 GROUP BY state"),
    "network_components": _NET + " SELECT DISTINCT state, CAST(1 AS BIGINT) AS community FROM evt",
    "edge_threshold": _NET + " SELECT * FROM (SELECT context AS from_state, to_state, round(count / sum(count) OVER (PARTITION BY context), 6) AS weight, count / sum(count) OVER (PARTITION BY context) AS raw FROM e) WHERE raw >= 0.2".replace("SELECT * FROM (", "SELECT from_state, to_state, weight FROM ("),
    "markov_table": _NET + ", st AS (SELECT DISTINCT state FROM evt), c AS (SELECT 1 AS \"order\", context, to_state AS next_state, count(*) AS count FROM p WHERE to_state IS NOT NULL GROUP BY ALL UNION ALL SELECT 2, context || ' > ' || to_state, s2, count(*) FROM p WHERE s2 IS NOT NULL GROUP BY ALL), f AS (SELECT x.\"order\", x.context, st.state AS next_state, coalesce(c.count, 0) AS count FROM (SELECT DISTINCT \"order\", context FROM c) x CROSS JOIN st LEFT JOIN c ON c.\"order\" = x.\"order\" AND c.context = x.context AND c.next_state = st.state) SELECT \"order\", context, next_state, count, round((count + 0.5) / (sum(count) OVER (PARTITION BY \"order\", context) + 0.5 * (SELECT count(*) FROM st)), 6) AS probability FROM f",
    "dist_levenshtein": _PAIR + " SELECT sequence_id_1, sequence_id_2, distance FROM d",
    "dist_levenshtein_norm": _PAIR + " SELECT sequence_id_1, sequence_id_2, round(distance / greatest(n1, n2), 6) AS distance FROM d",
    "dist_om": _PAIR + " SELECT sequence_id_1, sequence_id_2, distance FROM d",
    "dist_transition": f"WITH {_C}, q AS (SELECT sequence_id, state AS f, lead(state) OVER (PARTITION BY sequence_id ORDER BY ord) AS g FROM conv), c AS (SELECT sequence_id, f, g, count(*) AS n FROM q WHERE g IS NOT NULL GROUP BY ALL), p AS (SELECT sequence_id, f, g, n / sum(n) OVER (PARTITION BY sequence_id, f) AS p FROM c), ids AS (SELECT DISTINCT sequence_id FROM conv), cells AS (SELECT DISTINCT f, g FROM p), fu AS (SELECT ids.sequence_id, cells.f, cells.g, coalesce(p.p, 0) AS p FROM ids CROSS JOIN cells LEFT JOIN p ON p.sequence_id = ids.sequence_id AND p.f = cells.f AND p.g = cells.g) SELECT a.sequence_id AS sequence_id_1, b.sequence_id AS sequence_id_2, round(sqrt(sum(pow(a.p - b.p, 2))), 5) AS distance FROM fu a JOIN fu b ON a.sequence_id < b.sequence_id AND a.f = b.f AND a.g = b.g GROUP BY ALL",
    "dist_summary": _PAIR + " SELECT (SELECT count(*) FROM s) AS n_sequences, count(*) AS n_pairs, round(avg(distance), 6) AS mean_distance, round(median(distance), 6) AS median_distance, min(distance) AS min_distance, max(distance) AS max_distance FROM d",
    "dist_per_sequence": _PAIR + ", y AS (SELECT sequence_id_1 AS sequence_id, distance FROM d UNION ALL SELECT sequence_id_2, distance FROM d) SELECT sequence_id, round(avg(distance), 6) AS mean_distance, round(median(distance), 6) AS median_distance, min(distance) AS min_distance, max(distance) AS max_distance FROM y GROUP BY 1",
    "heatmap_order": _PAIR + ", y AS (SELECT sequence_id_1 AS sequence_id, sequence_id_2 AS other, distance FROM d UNION ALL SELECT sequence_id_2, sequence_id_1, distance FROM d UNION ALL SELECT sequence_id, sequence_id, 0.0 FROM s), k AS (SELECT sequence_id, row_number() OVER (ORDER BY sequence_id) AS rank FROM s) SELECT y.sequence_id, y.other, a.rank, b.rank AS other_rank, CAST(distance AS DOUBLE) AS distance FROM y JOIN k a ON a.sequence_id = y.sequence_id JOIN k b ON b.sequence_id = y.other",
    "panel_index": _PANQ + " SELECT sequence_id, panel_id, CAST(occasion AS VARCHAR) AS occasion, occasion_rank, sequence_length, transition_count FROM r",
    "panel_occasions": _PANQ + " SELECT CAST(occasion AS VARCHAR) AS occasion, count(DISTINCT panel_id) AS n_panels, count(*) AS n_sequences, round(avg(sequence_length), 6) AS mean_length, median(sequence_length) AS median_length, round(avg(transition_count), 6) AS mean_transitions FROM r GROUP BY 1",
    "panel_states": _PANQ + ", o AS (SELECT occasion, count(*) AS ns FROM r GROUP BY 1), g AS (SELECT occasion, state, count(*) AS oc, count(DISTINCT sequence_id) AS sc FROM pan GROUP BY ALL), f AS (SELECT o.occasion, o.ns, z.state, coalesce(oc, 0) AS oc, coalesce(sc, 0) AS sc FROM o CROSS JOIN (SELECT DISTINCT state FROM pan) z LEFT JOIN g ON g.occasion = o.occasion AND g.state = z.state) SELECT CAST(occasion AS VARCHAR) AS occasion, state, oc AS occurrence_count, round(oc / sum(oc) OVER (PARTITION BY occasion), 6) AS occurrence_share, sc AS sequence_count, round(sc / CAST(ns AS DOUBLE), 6) AS sequence_prevalence FROM f",
    "panel_changes": _PANQ + " SELECT panel_id, from_rank, to_rank, distance, length_change, transition_change FROM c WHERE to_rank IS NOT NULL",
    "panel_change_summary": _PANQ + " SELECT CAST(occasion AS VARCHAR) || ' -> ' || CAST(to_occasion AS VARCHAR) AS transition, count(*) AS n, round(avg(length_change), 6) AS mean, round(stddev_samp(length_change) / sqrt(count(*)), 6) AS standard_error FROM c WHERE to_rank IS NOT NULL GROUP BY 1",
    "index_matrix_long": f"WITH {_C}, n AS (SELECT sequence_id, count(*) AS n FROM conv GROUP BY 1), r AS (SELECT sequence_id, row_number() OVER (ORDER BY n DESC, sequence_id) AS plot_row FROM n) SELECT sequence_id, plot_row, row_number() OVER (PARTITION BY sequence_id ORDER BY ord) AS position, state, dense_rank() OVER (ORDER BY state) AS state_index FROM conv JOIN r USING (sequence_id)",
    "state_distribution": f"WITH {_C}, c AS (SELECT ord, state, count(*) AS n FROM conv GROUP BY ALL), f AS (SELECT o.ord, s.state, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT ord FROM conv) o CROSS JOIN (SELECT DISTINCT state FROM conv) s LEFT JOIN c ON c.ord = o.ord AND c.state = s.state) SELECT ord AS sequence_order, state, n, round(n / sum(n) OVER (PARTITION BY ord), 6) AS value FROM f",
    "entropy_by_position": f"WITH {_C}, c AS (SELECT ord, state, count(*) AS n FROM conv GROUP BY ALL), p AS (SELECT ord, n, n / sum(n) OVER (PARTITION BY ord) AS p FROM c) SELECT ord AS sequence_order, CAST(sum(n) AS BIGINT) AS n, round(-sum(p * ln(p)) / ln((SELECT count(DISTINCT state) FROM conv)), 6) + 0.0 AS entropy FROM p GROUP BY ord",
    "wide_sequences": f"WITH {_C} SELECT sequence_id, coalesce(max(state) FILTER (ord = 0), '-') AS position_0, coalesce(max(state) FILTER (ord = 1), '-') AS position_1 FROM conv GROUP BY 1",
    "wide_sequences_hidden": f"WITH {_C} SELECT sequence_id, max(state) FILTER (ord = 0) AS position_0 FROM conv GROUP BY 1",
    "itemsets": f'WITH {_C} SELECT sequence_id, state AS item, dense_rank() OVER (ORDER BY sequence_id) AS "sequenceID", row_number() OVER (PARTITION BY sequence_id ORDER BY ord) AS "eventID" FROM conv',
    "string_encoding": f"WITH {_C}, k AS (SELECT state, chr(CAST(64 + dense_rank() OVER (ORDER BY state) AS INTEGER)) AS ch FROM (SELECT DISTINCT state FROM conv)) SELECT sequence_id, string_agg(ch, '' ORDER BY ord) AS sequence_string FROM conv JOIN k USING (state) GROUP BY 1",
    "vertices_edges": _NET + " SELECT least(context, to_state) AS source, greatest(context, to_state) AS target, sum(count) AS count FROM e GROUP BY 1, 2",
    "inferred_mapping": "SELECT conv_id AS sequence_id, CAST(turn AS BIGINT) AS sequence_order, role AS state FROM conversations",
    "transfer_js": _TRANS + f" SELECT a.source, a.target, round(token_js_bits, 6) AS token_js_bits, round(transition_js_bits, 6) AS transition_js_bits FROM {_js('evt', 'state', 'token_js_bits')} a JOIN {_js('mv', 'state || chr(1) || nxt', 'transition_js_bits')} b ON a.source = b.source",
    "transfer_nll": _TRANS + ", c AS (SELECT grp AS source, state, nxt, count(*) AS c FROM tm WHERE train GROUP BY ALL), u AS (SELECT source, state, sum(c) AS t FROM c GROUP BY ALL), h AS (SELECT grp AS target, state, nxt, count(*) AS w FROM tm WHERE NOT train GROUP BY ALL), k AS (SELECT count(DISTINCT state) AS k FROM evt) SELECT s.source, h.target, round(sum(-ln((coalesce(c.c, 0) + 1.0) / (coalesce(u.t, 0) + k)) * w) / sum(w), 5) AS target_holdout_nll FROM (SELECT DISTINCT source FROM c) s CROSS JOIN h CROSS JOIN k LEFT JOIN c ON c.source = s.source AND c.state = h.state AND c.nxt = h.nxt LEFT JOIN u ON u.source = s.source AND u.state = h.state GROUP BY 1, 2",
    "transfer_entropy": _TRANS + ", c AS (SELECT grp, state, nxt, count(*) AS n FROM mv GROUP BY ALL), p AS (SELECT grp, n, n / sum(n) OVER (PARTITION BY grp, state) AS p FROM c) SELECT grp AS target, round(sum(-n * log2(p)) / sum(n), 6) AS transition_conditional_entropy FROM p GROUP BY 1",
    "smoothing_events": _SM + " SELECT participant_id, trial_id, min(ref) AS reference_label, min(ord) AS start_sample, count(*) AS duration_samples, bool_and(raw = ref) AS raw_whole_event_preserved, bool_and(sm = ref) AS smoothed_whole_event_preserved, count(*) <= 2 AS brief_reference_event FROM u GROUP BY participant_id, trial_id, run",
    "smoothing_trials": _SM + " SELECT participant_id, trial_id, round(avg(CASE WHEN raw != ref THEN 1.0 ELSE 0 END), 6) AS raw_error, round(avg(CASE WHEN sm != ref THEN 1.0 ELSE 0 END), 6) AS smoothed_error, CAST(sum(cr) AS BIGINT) AS reference_transitions, CAST(sum(cw) AS BIGINT) AS raw_transitions, CAST(sum(cs) AS BIGINT) AS smoothed_transitions FROM u GROUP BY 1, 2",
}
