"""Queries over splits, samples and the static table's months."""

from __future__ import annotations


from ..operators import splits
from ..session import new_path
from ..sources.provided import MONTHS
from .artefacts import Artefacts
from .registry import ntz, query, rnd, rounded
from .sql_text import cte

cte("v_starts", """
    SELECT session_id, user_id || '_' || CAST(floor((day(session_start) - 1) / 5) AS BIGINT) AS user_id,
      session_start, label FROM j_starts""")
cte("v_users", """
    SELECT user_id, min(session_start) AS first_seen, max(session_start) AS last_seen
    FROM v_starts GROUP BY 1""")
cte("v_ranked", """
    SELECT *, row_number() OVER (ORDER BY first_seen, md5(user_id || '|first')) AS r, count(*) OVER () AS n
    FROM v_users""")
cte("v_placed", """
    SELECT *, CASE WHEN r <= round_even(n * 0.7e0, 0) THEN 'train'
      WHEN r <= round_even(n * 0.7e0, 0) + round_even(n * 0.15e0, 0) THEN 'val' ELSE 'test' END AS "partition"
    FROM v_ranked""")
cte("v_edges", """
    SELECT min(first_seen) FILTER ("partition" = 'val') AS to_val,
      min(first_seen) FILTER ("partition" = 'test') AS to_test FROM v_placed""")
cte("v_split", """
    SELECT t.session_id, t.user_id, t.label, t.session_start, p."partition"
    FROM v_starts t JOIN v_placed p ON t.user_id = p.user_id, v_edges
    WHERE NOT (p."partition" = 'train' AND last_seen >= to_val)
      AND NOT (p."partition" = 'val' AND last_seen >= to_test)""")
cte("m_sizes", f"""
    SELECT list_position({list(MONTHS)!r}, "Month") - 1 AS month_idx, count(*) AS n FROM j_static GROUP BY 1""")
cte("m_shares", """
    SELECT month_idx, CAST(coalesce(sum(n) OVER (ORDER BY month_idx ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS DOUBLE) / sum(n) OVER () AS share, row_number() OVER (ORDER BY month_idx) AS i
    FROM m_sizes""")
cte("m_best", """
    SELECT a.month_idx AS val_from, b.month_idx AS test_from,
      pow(a.share - 0.7e0, 2) + pow(b.share - 0.85e0, 2) AS cost
    FROM m_shares a JOIN m_shares b ON a.i > 1 AND a.i < b.i ORDER BY cost, 1, 2 LIMIT 1""")


@query("session_table", "SELECT session_id, user_id, session_start, label FROM j_starts")
def _(a: Artefacts):
    return ntz(splits.session_table(a.sessions, a.cutpoints))


@query("temporal_split", 'SELECT session_id, user_id, session_start, "partition", label FROM v_split')
def _(a: Artefacts):
    return ntz(splits.temporal_split(a.visitors))


@query("grouped_split", 'SELECT session_id, user_id, session_start, "partition", label FROM j_split')
def _(a: Artefacts):
    return ntz(splits.grouped_split(a.session_table))


@query("split_report", "SELECT count(*) AS n_sessions, " + ", ".join(
    f"""count(*) FILTER ("partition" = '{p}') AS n_{p}, """
    + rnd(f"""avg(CAST(label AS INT)) FILTER ("partition" = '{p}')""") + f" AS prevalence_{p}"
    for p in splits.PARTITIONS) + " FROM j_split")
def _(a: Artefacts):
    return rounded(splits.split_report(a.split))


@query("freeze_split", 'SELECT session_id, user_id, "partition", label FROM v_split')
def _(a: Artefacts):
    path = splits.freeze_split(splits.temporal_split(a.visitors), new_path(a.spark, "frozen"))
    return splits.load_split(a.spark, path)


@query("load_split", 'SELECT session_id, user_id, "partition", label FROM j_split')
def _(a: Artefacts):
    path = splits.freeze_split(a.split, new_path(a.spark, "frozen"))
    return splits.load_split(a.spark, path)


@query("split_join", """
    SELECT f.session_id, stage, f.label, "partition" FROM j_feats f JOIN j_split p ON f.session_id = p.session_id""")
def _(a: Artefacts):
    return splits.split_join(a.features.select("session_id", "stage", "label"), a.split)


@query("month_split", """
    SELECT session_id, "Month", CASE WHEN idx < val_from THEN 'train' WHEN idx < test_from THEN 'val'
      ELSE 'test' END AS "partition"
    FROM (SELECT *, list_position(%r, "Month") - 1 AS idx FROM j_static), m_best""" % (list(MONTHS),))
def _(a: Artefacts):
    return splits.month_split(a.static, months=MONTHS).select("session_id", "Month", "partition")


@query("month_boundaries", f"SELECT val_from, test_from, {rnd('cost')} AS cost FROM m_best")
def _(a: Artefacts):
    return rounded(splits.month_boundaries(a.static, months=MONTHS))


@query("subsample_users", """
    SELECT session_id, seq, user_id FROM j_sessions WHERE user_id IN (
      SELECT user_id FROM (SELECT DISTINCT user_id FROM j_sessions) ORDER BY md5(user_id || '|42') LIMIT 60)""")
def _(a: Artefacts):
    return splits.subsample_users(a.sessions, 60, min_sessions=0).select("session_id", "seq", "user_id")


@query("subsample_report", """
    SELECT count(DISTINCT user_id) AS n_users_before, count(DISTINCT session_id) AS n_sessions_before,
      count(*) AS n_events_before, count(DISTINCT user_id) FILTER (keep) AS n_users_after,
      count(DISTINCT session_id) FILTER (keep) AS n_sessions_after, count(*) FILTER (keep) AS n_events_after
    FROM (SELECT *, user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM j_sessions)
      ORDER BY md5(user_id || '|42') LIMIT 60) AS keep FROM j_sessions)""")
def _(a: Artefacts):
    return splits.subsample_report(a.sessions, splits.subsample_users(a.sessions, 60, min_sessions=0))


@query("stratified_slice", """
    SELECT session_id, stage, label, row_number() OVER (PARTITION BY stage, label
        ORDER BY md5(session_id || '|0')) <= greatest(1, round_even(0.2e0 * count(*) OVER (PARTITION BY stage, label), 0))
      AS in_slice FROM j_feats""")
def _(a: Artefacts):
    rows = a.features.select("session_id", "stage", "label")
    return splits.stratified_slice(rows, 0.2, groups=["stage"])


@query("common_cohort", "SELECT session_id FROM j_feats GROUP BY 1 HAVING count(DISTINCT stage) = 3")
def _(a: Artefacts):
    return splits.common_cohort(a.features)


@query("permute_labels", """
    SELECT a.session_id, a.stage, b.label
    FROM (SELECT session_id, stage, row_number() OVER (PARTITION BY stage ORDER BY md5(session_id || '|to')) AS r
      FROM j_feats) a
    JOIN (SELECT stage, label, row_number() OVER (PARTITION BY stage ORDER BY md5(session_id || '|7')) AS r
      FROM j_feats) b ON a.stage = b.stage AND a.r = b.r""")
def _(a: Artefacts):
    return splits.permute_labels(a.features.select("session_id", "stage", "label"), 7)


