"""Queries of validation, description, motifs and subsequences, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, describe, motifs, subsequences
from ..sources import tables as t

_E, _C, _L = t.EVT_SQL, t.CONV_SQL, t.LIN_SQL


def _evt(s, d):
    return t.events(s, d)


def _r(df, *keep, digits=6):
    """The named columns with doubles rounded, for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if dict(df.dtypes)[c] == "double" else c for c in (keep or df.columns)])


def _codes(code):
    def run(s, d):
        found = audit.audit_sequence_data(t.lineitems(s, d), **t.LIN, duration_col="l_quantity", row_col="rn", expected_states=["A", "N"])
        return found.where(F.col("issue_code") == code).select("sequence_id", "row", "issue_code")

    return run


def _prepared(**policy):
    def run(s, d):
        got = audit.prepare_sequence_data(t.lineitems(s, d), **t.LIN, duration_col="l_quantity", row_col="rn", **policy).data
        return got.select(F.col("sequence_id").cast("string").alias("sequence_id"), F.col("sequence_order").cast("long").alias("sequence_order"), "state", "original_row", F.round("duration", 4).alias("duration"))

    return run


def _decisions(s, d):
    return audit.prepare_sequence_data(t.lineitems(s, d), **t.LIN, row_col="rn", duplicate_position_policy="first", repeated_state_policy="collapse").decisions.where("affected_rows > 0").select("step", "policy", "affected_rows")


def _validate(s, d):
    return audit.validate_sequence_data(t.lineitems(s, d), **t.LIN, row_col="rn").summary.select("status", "n_errors", "n_rows", "n_sequences", "n_states")


def _ngrams(s, d, **more):
    return motifs.extract_sequence_ngrams(t.conversations(s, d), **t.CONV, **more)


def _evt_motifs(s, d):
    return motifs.extract_sequence_ngrams(_evt(s, d), **t.EVT, metadata_cols=["grp"], row_col="event_id")


def _subs(s, d, **more):
    return subsequences.extract_sequence_subsequences(t.conversations(s, d), "conv_id", "turn", "role", metadata_cols=["grp"], min_length=2, max_length=3, **more)


_NGRAM = """codes AS (SELECT state, 'S' || CAST(dense_rank() OVER (ORDER BY state) AS VARCHAR) AS code FROM (SELECT DISTINCT state FROM {src})),
w AS (SELECT sequence_id, ord, grp, state, code, row_number() OVER q AS i, count(*) OVER (PARTITION BY sequence_id) AS n_states,
 lead(state,1) OVER q AS s2, lead(code,1) OVER q AS c2, lead(state,2) OVER q AS s3, lead(code,2) OVER q AS c3 FROM {src} JOIN codes USING (state) WINDOW q AS (PARTITION BY sequence_id ORDER BY ord)),
g AS (SELECT sequence_id, grp, n_states, i AS start_index, i+1 AS end_index, 2 AS motif_length, code || '|' || c2 AS motif_key, state || ' > ' || s2 AS motif FROM w WHERE s2 IS NOT NULL
 UNION ALL SELECT sequence_id, grp, n_states, i, i+2, 3, code || '|' || c2 || '|' || c3, state || ' > ' || s2 || ' > ' || s3 FROM w WHERE s3 IS NOT NULL)"""
_NC = f"WITH {_C}, " + _NGRAM.format(src="conv")
_NE = f"WITH {_E}, " + _NGRAM.format(src="evt")
_OVERALL = """o AS (SELECT 'L' || CAST(motif_length AS VARCHAR) || ':' || motif_key AS motif_id, motif, motif_length, count(*) AS n_occurrences, count(DISTINCT sequence_id) AS n_sequences,
 count(DISTINCT sequence_id) / CAST((SELECT count(DISTINCT sequence_id) FROM {src}) AS DOUBLE) AS sequence_prevalence, count(*) / CAST((SELECT count(*) FROM g) AS DOUBLE) AS occurrence_share FROM g GROUP BY ALL)"""
_POS = """p AS (SELECT *, CASE WHEN n_states <= 1 THEN 0.0 ELSE (start_index - 1.0) / (n_states - 1) END AS rel FROM g)"""
_SUB = f"""WITH {_C}, i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY ord) AS p FROM conv),
s AS (SELECT a.sequence_id, a.grp, a.state || ' > ' || b.state AS subsequence, 2 AS subsequence_length, a.ord AS o1, b.ord AS o2, b.p - a.p - 1 AS gap FROM i a JOIN i b ON a.sequence_id = b.sequence_id AND b.p > a.p
 UNION ALL SELECT a.sequence_id, a.grp, a.state || ' > ' || b.state || ' > ' || c.state, 3, a.ord, c.ord, greatest(b.p - a.p - 1, c.p - b.p - 1) FROM i a JOIN i b ON a.sequence_id = b.sequence_id AND b.p > a.p JOIN i c ON b.sequence_id = c.sequence_id AND c.p > b.p),
u AS (SELECT subsequence, subsequence_length, count(*) AS occurrence_count, count(DISTINCT sequence_id) AS sequence_count, round(count(DISTINCT sequence_id) / CAST((SELECT count(DISTINCT sequence_id) FROM conv) AS DOUBLE), 6) AS sequence_prevalence,
 round(avg(o2 - o1), 6) AS mean_span, round(median(o2 - o1), 6) AS median_span, round(avg(gap), 6) AS mean_max_gap FROM s GROUP BY ALL)"""
_GC = """k AS (SELECT grp, count(DISTINCT sequence_id) AS n_group FROM conv GROUP BY grp), c AS (SELECT subsequence, subsequence_length, grp, count(DISTINCT sequence_id) AS n_present FROM s GROUP BY ALL),
f AS (SELECT x.subsequence, x.subsequence_length, k.grp, k.n_group, coalesce(c.n_present, 0) AS n_present FROM (SELECT DISTINCT subsequence, subsequence_length FROM s) x CROSS JOIN k LEFT JOIN c ON c.subsequence = x.subsequence AND c.subsequence_length = x.subsequence_length AND c.grp = k.grp)"""

QUERIES = {
    "audit_duplicates": _codes("duplicated_position"),
    "audit_gaps": lambda s, d: audit.audit_sequence_data(t.lineitems(s, d), **t.LIN, row_col="rn").where("issue_code = 'missing_positions'").select("sequence_id", "value"),
    "audit_repeats": _codes("consecutive_repeated_state"),
    "audit_single_state": _codes("single_state_sequence"),
    "audit_unordered": lambda s, d: audit.audit_sequence_data(t.events(s, d), **t.EVT, row_col="event_id").where("issue_code = 'unordered_rows'").select("sequence_id", "issue_code"),
    "audit_unknown_states": _codes("unknown_state"),
    "validate_counts": _validate,
    "prepare_first": _prepared(duplicate_position_policy="first"),
    "prepare_last": _prepared(duplicate_position_policy="last"),
    "prepare_collapse": _prepared(duplicate_position_policy="first", repeated_state_policy="collapse"),
    "prepare_drop_unknown": _prepared(duplicate_position_policy="first", unknown_state_policy="drop", expected_states=["A", "N"]),
    "prepare_decisions": _decisions,
    "encode_states": lambda s, d: describe.encode_sequence_data(_evt(s, d), **t.EVT, row_col="event_id").data.select("sequence_id", "sequence_order", "state", "state_index", "state_code", "original_row"),
    "state_dictionary": lambda s, d: describe.encode_sequence_data(_evt(s, d), **t.EVT, row_col="event_id").state_dictionary,
    "states_by_sequence": lambda s, d: _r(describe.summarise_sequence_states(_evt(s, d), **t.EVT, duration_col="value", metadata_cols=["grp"], row_col="event_id").by_sequence),
    "states_overall": lambda s, d: _r(describe.summarise_sequence_states(_evt(s, d), **t.EVT, duration_col="value", row_col="event_id").overall, digits=4),
    "transitions_by_sequence": lambda s, d: _r(describe.summarise_sequence_transitions(_evt(s, d), **t.EVT, metadata_cols=["grp"], row_col="event_id").by_sequence),
    "transitions_overall": lambda s, d: _r(describe.summarise_sequence_transitions(_evt(s, d), **t.EVT, row_col="event_id").overall),
    "transitions_noself": lambda s, d: _r(describe.summarise_sequence_transitions(_evt(s, d), **t.EVT, include_self=False, row_col="event_id").overall),
    "paths": lambda s, d: describe.format_sequence_paths(t.conversations(s, d), **t.CONV),
    "paths_collapsed": lambda s, d: describe.format_sequence_paths(t.conversations(s, d), **t.CONV, collapse_repeats=True),
    "ngrams": lambda s, d: _ngrams(s, d).occurrences.select("sequence_id", "motif_id", "motif", "motif_length", "start_index", "end_index", "occurrence_index"),
    "ngram_sequence_counts": lambda s, d: _ngrams(s, d).sequences.select("sequence_id", "n_states", "n_candidate_occurrences", "n_retained_occurrences", "n_distinct_motifs"),
    "ngrams_no_overlap": lambda s, d: _ngrams(s, d, overlap="disallow").occurrences.select("sequence_id", "motif_id", "start_index"),
    "motif_by_sequence": lambda s, d: motifs.summarise_sequence_motifs(_evt_motifs(s, d)).by_sequence.select("sequence_id", "grp", "motif_id", "motif", "n_occurrences", "first_start_index", "last_start_index"),
    "motif_overall": lambda s, d: _r(motifs.summarise_sequence_motifs(_evt_motifs(s, d)).overall, "motif_id", "motif", "motif_length", "n_occurrences", "n_sequences", "sequence_prevalence", "occurrence_share"),
    "motif_topk_ties": lambda s, d: _r(motifs.filter_sequence_motifs(_evt_motifs(s, d), top_n=5).overall, "motif_id", "n_occurrences", "n_sequences"),
    "motif_topk_first": lambda s, d: _r(motifs.filter_sequence_motifs(_evt_motifs(s, d), top_n=7, rank_by="n_occurrences", ties="first").overall, "motif_id", "n_occurrences", "n_sequences"),
    "motif_format_percent": lambda s, d: _r(motifs.format_sequence_motifs(_evt_motifs(s, d), digits=2, prevalence="percent"), "rank", "motif_id", "sequence_prevalence_percent", digits=2),
    "motif_positions_abs": lambda s, d: _r(motifs.summarise_sequence_motif_positions(_evt_motifs(s, d)).summary, "motif_id", "n_occurrences", "n_sequences", "min_position", "max_position", "mean_position", "median_position"),
    "motif_positions_rel": lambda s, d: _r(motifs.summarise_sequence_motif_positions(_evt_motifs(s, d), scale="relative").summary, "motif_id", "min_position", "max_position", "mean_position", "median_position"),
    "motif_positions_grouped": lambda s, d: _r(motifs.summarise_sequence_motif_positions(_evt_motifs(s, d), by=["grp"]).summary, "grp", "motif_id", "n_occurrences", "mean_position"),
    "motif_positions_ranked": lambda s, d: motifs.format_sequence_motif_positions(motifs.summarise_sequence_motif_positions(_evt_motifs(s, d))).select("rank", "motif_id"),
    "motif_bar_data": lambda s, d: _r(motifs.plot_sequence_motifs(_evt_motifs(s, d), top_n=10, ties="first"), "plot_rank", "plot_value", "plot_label"),
    "motif_strip_data": lambda s, d: _r(motifs.plot_sequence_motif_positions(_ngrams(s, d), top_n=3), "sequence_id", "motif_id", "start_index", "position_value"),
    "subseq_occurrences": lambda s, d: _subs(s, d).occurrences.select("sequence_id", "subsequence", "subsequence_length", F.col("start_order").cast("long").alias("start_order"), F.col("end_order").cast("long").alias("end_order"), F.col("max_observed_gap").cast("long").alias("max_observed_gap")),
    "subseq_gap_span": lambda s, d: _subs(s, d, max_gap=1, max_span=4).occurrences.select("sequence_id", "subsequence", F.col("span").cast("long").alias("span")),
    "subseq_summary": lambda s, d: _r(subsequences.summarise_sequence_subsequences(_subs(s, d))),
    "subseq_topk": lambda s, d: _r(subsequences.filter_sequence_subsequences(subsequences.summarise_sequence_subsequences(_subs(s, d)), top_n=4), "subsequence", "sequence_count"),
    "subseq_bar_data": lambda s, d: _r(subsequences.plot_sequence_subsequences(subsequences.summarise_sequence_subsequences(_subs(s, d)), metric="occurrence_count"), "occurrence_count"),
    "subseq_group_counts": lambda s, d: subsequences.subsequence_group_counts(_subs(s, d), "grp"),
    "subseq_chisq_stat": lambda s, d: _r(subsequences.compare_sequence_subsequences(_subs(s, d), "grp", test="chisq"), "subsequence", "statistic", "prevalence_difference"),
    "subseq_fisher": lambda s, d: subsequences.compare_sequence_subsequences(_subs(s, d), "grp"),
}

_AUDIT_LIN = f"WITH {_L}, x AS (SELECT *, count(*) OVER (PARTITION BY sequence_id, ord) AS same, lag(state) OVER (PARTITION BY sequence_id ORDER BY ord, rn) AS last, lag(ord) OVER (PARTITION BY sequence_id ORDER BY ord, rn) AS lo FROM lin)"
_PREP = f"WITH {_L}, k AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, ord ORDER BY rn {{dir}}) AS q FROM lin {{where}}), f AS (SELECT * FROM k WHERE q = 1)"
_RUNS = _PREP.format(dir="", where="") + (
    ", n AS (SELECT *, CASE WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY sequence_id ORDER BY ord, rn)), r AS (SELECT *, sum(new) OVER (PARTITION BY sequence_id ORDER BY ord, rn) AS run FROM n)"
)
_SHOW = "sequence_id, CAST(ord AS BIGINT) AS sequence_order, state, rn AS original_row, round(duration, 4) AS duration"
_TR = f"WITH {_E}, p AS (SELECT sequence_id, grp, state AS from_state, lead(state) OVER (PARTITION BY sequence_id ORDER BY ord) AS to_state FROM evt), q AS (SELECT * FROM p WHERE to_state IS NOT NULL {{self}})"
_TO = _TR + (
    ", n AS (SELECT from_state, to_state, count(DISTINCT sequence_id) AS n_sequences, count(*) AS n_transitions FROM q GROUP BY ALL) SELECT from_state, to_state, n_sequences, round(n_sequences / CAST((SELECT count(DISTINCT sequence_id) FROM evt) AS DOUBLE), 6) AS sequence_proportion, "
    "n_transitions, round(n_transitions / sum(n_transitions) OVER (), 6) AS transition_proportion, round(n_transitions / sum(n_transitions) OVER (PARTITION BY from_state), 6) AS origin_transition_proportion FROM n"
)
ORACLES = {
    "audit_duplicates": _AUDIT_LIN + " SELECT sequence_id, rn AS row, 'duplicated_position' AS issue_code FROM x WHERE same > 1",
    "audit_gaps": f"WITH {_L}, x AS (SELECT sequence_id, ord, lag(ord) OVER (PARTITION BY sequence_id ORDER BY ord, rn) AS lo FROM lin) SELECT sequence_id, string_agg(CAST(lo AS VARCHAR) || '->' || CAST(ord AS VARCHAR), ', ' ORDER BY ord) AS value FROM x WHERE ord - lo > 1 GROUP BY sequence_id",
    "audit_repeats": _AUDIT_LIN + " SELECT sequence_id, rn AS row, 'consecutive_repeated_state' AS issue_code FROM x WHERE state = last",
    "audit_single_state": f"WITH {_L} SELECT sequence_id, CAST(NULL AS BIGINT) AS row, 'single_state_sequence' AS issue_code FROM lin GROUP BY sequence_id HAVING count(state) = 1",
    "audit_unordered": f"WITH {_E}, x AS (SELECT sequence_id, ord < lag(ord) OVER (PARTITION BY sequence_id ORDER BY event_id) AS bad FROM evt) SELECT sequence_id, 'unordered_rows' AS issue_code FROM x GROUP BY sequence_id HAVING bool_or(bad)",
    "audit_unknown_states": _AUDIT_LIN + " SELECT sequence_id, rn AS row, 'unknown_state' AS issue_code FROM x WHERE state NOT IN ('A', 'N')",
    "validate_counts": _AUDIT_LIN + " SELECT CASE WHEN count(*) FILTER (same > 1) > 0 THEN 'fail' ELSE 'review' END AS status, count(*) FILTER (same > 1) AS n_errors, count(*) AS n_rows, count(DISTINCT sequence_id) AS n_sequences, count(DISTINCT state) AS n_states FROM x",
    "prepare_first": _PREP.format(dir="", where="") + f" SELECT {_SHOW} FROM f",
    "prepare_last": _PREP.format(dir="DESC", where="") + f" SELECT {_SHOW} FROM f",
    "prepare_collapse": _RUNS + " SELECT sequence_id, CAST(min(ord) AS BIGINT) AS sequence_order, min(state) AS state, arg_min(rn, ord) AS original_row, round(sum(duration), 4) AS duration FROM r GROUP BY sequence_id, run",
    "prepare_drop_unknown": _PREP.format(dir="", where="WHERE state IN ('A', 'N')") + f" SELECT {_SHOW} FROM f",
    "prepare_decisions": _RUNS + " SELECT 'duplicated_positions' AS step, 'first' AS policy, count(*) AS affected_rows FROM k WHERE q > 1 UNION ALL SELECT 'consecutive_repeats', 'collapse', count(*) FROM r WHERE new = 0",
    "encode_states": f"WITH {_E}, c AS (SELECT state, dense_rank() OVER (ORDER BY state) AS state_index FROM (SELECT DISTINCT state FROM evt)) SELECT sequence_id, ord AS sequence_order, state, state_index, 'S' || CAST(state_index AS VARCHAR) AS state_code, event_id AS original_row FROM evt JOIN c USING (state)",
    "state_dictionary": f"WITH {_E} SELECT state, dense_rank() OVER (ORDER BY state) AS state_index, 'S' || CAST(dense_rank() OVER (ORDER BY state) AS VARCHAR) AS state_code, true AS observed FROM (SELECT DISTINCT state FROM evt)",
    "states_by_sequence": f"WITH {_E} SELECT sequence_id, grp, state, count(*) AS n_observations, round(count(*) / sum(count(*)) OVER w, 6) AS observation_proportion, round(sum(duration), 6) AS duration_sum, round(sum(duration) / sum(sum(duration)) OVER w, 6) AS duration_proportion, round(avg(duration), 6) AS mean_duration FROM evt GROUP BY sequence_id, grp, state WINDOW w AS (PARTITION BY sequence_id)",
    "states_overall": f"WITH {_E} SELECT state, count(DISTINCT sequence_id) AS n_sequences, round(count(DISTINCT sequence_id) / CAST((SELECT count(DISTINCT sequence_id) FROM evt) AS DOUBLE), 4) AS sequence_proportion, count(*) AS n_observations, round(count(*) / sum(count(*)) OVER (), 4) AS observation_proportion, round(sum(duration), 4) AS duration_sum, round(sum(duration) / sum(sum(duration)) OVER (), 4) AS duration_proportion, round(avg(duration), 4) AS mean_duration FROM evt GROUP BY state",
    "transitions_by_sequence": _TR.format(self="") + ", n AS (SELECT sequence_id, grp, from_state, to_state, count(*) AS n_transitions FROM q GROUP BY ALL) SELECT *, round(n_transitions / sum(n_transitions) OVER (PARTITION BY sequence_id), 6) AS sequence_transition_proportion, round(n_transitions / sum(n_transitions) OVER (PARTITION BY sequence_id, from_state), 6) AS origin_transition_proportion FROM n",
    "transitions_overall": _TO.format(self=""),
    "transitions_noself": _TO.format(self="AND from_state != to_state"),
    "paths": f"WITH {_C} SELECT sequence_id, count(*) AS n_observations, count(*) AS n_states, count(DISTINCT state) AS n_unique_states, arg_min(state, ord) AS start_state, arg_max(state, ord) AS end_state, string_agg(state, ' > ' ORDER BY ord) AS path FROM conv GROUP BY sequence_id",
    "paths_collapsed": f"WITH {_C}, x AS (SELECT *, lag(state) OVER (PARTITION BY sequence_id ORDER BY ord) AS last FROM conv) SELECT sequence_id, count(*) AS n_observations, count(*) FILTER (last IS NULL OR last != state) AS n_states, count(DISTINCT state) AS n_unique_states, arg_min(state, ord) AS start_state, arg_max(state, ord) AS end_state, string_agg(state, ' > ' ORDER BY ord) FILTER (last IS NULL OR last != state) AS path FROM x GROUP BY sequence_id",
    "ngrams": _NC + " SELECT sequence_id, 'L' || CAST(motif_length AS VARCHAR) || ':' || motif_key AS motif_id, motif, motif_length, start_index, end_index, row_number() OVER (PARTITION BY sequence_id, motif_length, motif_key ORDER BY start_index) AS occurrence_index FROM g",
    "ngram_sequence_counts": _NC + " SELECT x.sequence_id, x.n AS n_states, count(g.motif) AS n_candidate_occurrences, count(g.motif) AS n_retained_occurrences, count(DISTINCT g.motif_key) AS n_distinct_motifs FROM (SELECT sequence_id, count(*) AS n FROM conv GROUP BY 1) x LEFT JOIN g USING (sequence_id) GROUP BY ALL",
    "ngrams_no_overlap": ("WITH RECURSIVE " + _NC[5:] + ", a AS (SELECT sequence_id, 'L' || CAST(motif_length AS VARCHAR) || ':' || motif_key AS motif_id, motif_length, start_index FROM g), "
     "r AS (SELECT sequence_id, motif_id, motif_length, min(start_index) AS start_index FROM a GROUP BY ALL UNION ALL SELECT r.sequence_id, r.motif_id, r.motif_length, (SELECT min(a.start_index) FROM a WHERE a.sequence_id = r.sequence_id AND a.motif_id = r.motif_id AND a.start_index >= r.start_index + r.motif_length) AS start_index FROM r WHERE r.start_index IS NOT NULL) SELECT sequence_id, motif_id, start_index FROM r WHERE start_index IS NOT NULL"),
    "motif_by_sequence": _NE + " SELECT sequence_id, grp, 'L' || CAST(motif_length AS VARCHAR) || ':' || motif_key AS motif_id, motif, count(*) AS n_occurrences, min(start_index) AS first_start_index, max(start_index) AS last_start_index FROM g GROUP BY ALL",
    "motif_overall": _NE + ", " + _OVERALL.format(src="evt") + " SELECT motif_id, motif, motif_length, n_occurrences, n_sequences, round(sequence_prevalence, 6) AS sequence_prevalence, round(occurrence_share, 6) AS occurrence_share FROM o",
    "motif_topk_ties": _NE + ", " + _OVERALL.format(src="evt") + " SELECT motif_id, n_occurrences, n_sequences FROM o QUALIFY rank() OVER (ORDER BY sequence_prevalence DESC) <= 5",
    "motif_topk_first": _NE + ", " + _OVERALL.format(src="evt") + " SELECT motif_id, n_occurrences, n_sequences FROM o ORDER BY n_occurrences DESC, sequence_prevalence DESC, n_sequences DESC, motif_length, motif_id LIMIT 7",
    "motif_format_percent": _NE + ", " + _OVERALL.format(src="evt") + " SELECT rank() OVER (ORDER BY sequence_prevalence DESC) AS rank, motif_id, round_even(100 * sequence_prevalence, 2) AS sequence_prevalence_percent FROM o",
    "motif_positions_abs": _NE + " SELECT 'L' || CAST(motif_length AS VARCHAR) || ':' || motif_key AS motif_id, count(*) AS n_occurrences, count(DISTINCT sequence_id) AS n_sequences, CAST(min(start_index) AS DOUBLE) AS min_position, CAST(max(start_index) AS DOUBLE) AS max_position, round(avg(start_index), 6) AS mean_position, round(median(start_index), 6) AS median_position FROM g GROUP BY 1",
    "motif_positions_rel": _NE + ", " + _POS + " SELECT 'L' || CAST(motif_length AS VARCHAR) || ':' || motif_key AS motif_id, round(min(rel), 6) AS min_position, round(max(rel), 6) AS max_position, round(avg(rel), 6) AS mean_position, round(median(rel), 6) AS median_position FROM p GROUP BY 1",
    "motif_positions_grouped": _NE + " SELECT grp, 'L' || CAST(motif_length AS VARCHAR) || ':' || motif_key AS motif_id, count(*) AS n_occurrences, round(avg(start_index), 6) AS mean_position FROM g GROUP BY 1, 2",
    "motif_positions_ranked": _NE + ", m AS (SELECT 'L' || CAST(motif_length AS VARCHAR) || ':' || motif_key AS motif_id, avg(start_index) AS mean_position FROM g GROUP BY 1) SELECT rank() OVER (ORDER BY mean_position) AS rank, motif_id FROM m",
    "motif_bar_data": _NE + ", " + _OVERALL.format(src="evt") + " SELECT row_number() OVER (ORDER BY sequence_prevalence DESC, n_occurrences DESC, n_sequences DESC, motif_length, motif_id) AS plot_rank, round(sequence_prevalence, 6) AS plot_value, motif AS plot_label FROM o QUALIFY plot_rank <= 10",
    "motif_strip_data": _NC + ", " + _OVERALL.format(src="conv") + ", top AS (SELECT motif_id FROM o ORDER BY sequence_prevalence DESC, n_occurrences DESC, n_sequences DESC, motif_length, motif_id LIMIT 3), h AS (SELECT *, 'L' || CAST(motif_length AS VARCHAR) || ':' || motif_key AS motif_id FROM g) SELECT sequence_id, motif_id, start_index, CAST(start_index AS DOUBLE) AS position_value FROM h JOIN top USING (motif_id)",
    "subseq_occurrences": _SUB + " SELECT sequence_id, subsequence, subsequence_length, o1 AS start_order, o2 AS end_order, gap AS max_observed_gap FROM s",
    "subseq_gap_span": _SUB + " SELECT sequence_id, subsequence, o2 - o1 AS span FROM s WHERE gap <= 1 AND o2 - o1 <= 4",
    "subseq_summary": _SUB + " SELECT * FROM u",
    "subseq_topk": _SUB + " SELECT subsequence, sequence_count FROM u QUALIFY rank() OVER (ORDER BY sequence_prevalence DESC) <= 4",
    "subseq_bar_data": _SUB + " SELECT occurrence_count FROM u ORDER BY occurrence_count DESC LIMIT 10",
    "subseq_group_counts": _SUB + ", " + _GC + " SELECT * FROM f",
    "subseq_chisq_stat": _SUB + ", " + _GC + ", z AS (SELECT subsequence, max(n_present) FILTER (grp='g0') AS a, max(n_group) FILTER (grp='g0') AS n0, max(n_present) FILTER (grp='g1') AS b, max(n_group) FILTER (grp='g1') AS n1 FROM f GROUP BY 1) SELECT subsequence, CASE WHEN a + b = n0 + n1 THEN NULL ELSE round((n0+n1) * pow(CAST(a AS DOUBLE)*(n1-b) - CAST(b AS DOUBLE)*(n0-a), 2) / (CAST(n0 AS DOUBLE)*n1*(a+b)*(n0+n1-a-b)), 6) END AS statistic, round(b/CAST(n1 AS DOUBLE) - a/CAST(n0 AS DOUBLE), 6) AS prevalence_difference FROM z",
}
