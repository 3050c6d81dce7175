"""Building blocks of the comparison SQL: named common table expressions.

Each entry is one CTE; ``statement`` pulls in the entries a query refers to.
The SQL is written independently of the operators (ranked windows, prefix
joins, category counts) and runs on the provided tables alone.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = " ".join(sql.split())


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [n for n in CTES if n in words]


def statement(sql: str) -> str:
    order: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in _needs(text):
            if name != own and name not in order:
                visit(CTES[name], name)
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return " ".join(sql.split())
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    recursive = any(n in _needs(CTES[n]) for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {' '.join(sql.split())}"


# inputs -------------------------------------------------------------------
cte("j_events", """
    SELECT event_id AS seq, user_id, ts AS event_time,
      CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'view' WHEN 'signup' THEN 'cart'
        WHEN 'error' THEN 'remove_from_cart' WHEN 'purchase' THEN 'purchase' END AS event_type,
      k % 40 AS product_id, k % 8 AS category_id, value AS price,
      user_id || '-' || strftime(ts, '%Y-%m-%d') AS user_session
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
cte("j_lines", """
    SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS "Administrative",
      sum(l_quantity) AS "Administrative_Duration",
      CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS "Informational",
      max(l_quantity) AS "Informational_Duration",
      CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS "ProductRelated",
      max(l_extendedprice) AS "ProductRelated_Duration", min(l_discount) AS "BounceRates",
      max(l_tax) AS "ExitRates", max(l_discount) AS "SpecialDay"
    FROM lineitem GROUP BY 1""")
cte("j_static", """
    SELECT CAST(o_orderkey AS VARCHAR) AS session_id, "Administrative", "Administrative_Duration",
      "Informational", "Informational_Duration", "ProductRelated", "ProductRelated_Duration",
      "BounceRates", "ExitRates", o_totalprice AS "PageValues", "SpecialDay",
      strftime(o_orderdate, '%b') AS "Month", o_orderpriority AS "OperatingSystems",
      CAST(o_custkey % 4 AS VARCHAR) AS "Browser", CAST(o_custkey % 25 AS VARCHAR) AS "Region",
      CAST(o_orderkey % 20 AS VARCHAR) AS "TrafficType",
      CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE 'returning' END AS "VisitorType",
      CASE WHEN isodow(o_orderdate) >= 6 THEN 'TRUE' ELSE 'FALSE' END AS "Weekend",
      CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'FALSE' END AS "Revenue"
    FROM orders LEFT JOIN j_lines ON o_orderkey = l_orderkey""")
# journey ------------------------------------------------------------------
cte("j_valid", """
    SELECT * FROM j_events WHERE user_session IS NOT NULL AND event_time IS NOT NULL
      AND event_type IN ('view', 'cart', 'remove_from_cart', 'purchase')""")
cte("j_clean", """
    SELECT * FROM j_valid QUALIFY row_number() OVER (
      PARTITION BY user_id, event_time, event_type, product_id ORDER BY seq) = 1""")
cte("j_gaps", """
    SELECT *, epoch_us(event_time) - lag(epoch_us(event_time)) OVER (
      PARTITION BY user_id ORDER BY event_time, seq) AS gap_us FROM j_clean""")
cte("j_assigned", """
    SELECT seq, user_id, event_time, event_type, product_id, category_id, price, user_session,
      user_id || '_' || CAST(sum(CASE WHEN gap_us <= 86400000000 THEN 0 ELSE 1 END) OVER (
        PARTITION BY user_id ORDER BY event_time, seq) AS BIGINT) AS session_id
    FROM j_gaps""")
cte("j_stats", """
    SELECT session_id, count(*) AS n_events,
      CAST(floor((max(epoch_us(event_time)) - min(epoch_us(event_time))) / 1e6) AS BIGINT) AS duration_s
    FROM j_assigned GROUP BY 1""")
cte("j_ranked_stats", """
    SELECT n_events, duration_s, row_number() OVER (ORDER BY n_events) - 1 AS rn,
      row_number() OVER (ORDER BY duration_s) - 1 AS rd, count(*) OVER () AS total
    FROM j_stats WHERE n_events >= 2""")
cte("j_caps", """
    SELECT max(n_events) FILTER (rn = floor((total - 1) * 0.995 + 0.5)) AS cap_events,
      max(duration_s) FILTER (rd = floor((total - 1) * 0.995 + 0.5)) AS cap_duration_s
    FROM j_ranked_stats""")
cte("j_kept", """
    SELECT session_id FROM j_stats, j_caps
    WHERE n_events >= 2 AND n_events <= cap_events AND duration_s <= cap_duration_s""")
cte("j_sessions", "SELECT * FROM j_assigned WHERE session_id IN (SELECT session_id FROM j_kept)")
cte("j_ordered", """
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_time, seq) - 1 AS event_idx
    FROM j_sessions""")
cte("j_flags", """
    SELECT *, (event_type = 'view' AND row_number() OVER (
        PARTITION BY session_id, product_id ORDER BY event_idx) > 1) AS repeat_view,
      (event_type = 'view' AND coalesce(category_id <> lag(category_id) OVER (
        PARTITION BY session_id ORDER BY event_idx), false)) AS category_switch
    FROM j_ordered""")
cte("j_ordinals", """
    SELECT *, CAST(sum(CAST(product_id IS NOT NULL AS INT)) OVER w AS BIGINT) AS interaction_no,
      CAST(sum(CAST(repeat_view OR category_switch AS INT)) OVER w AS BIGINT) AS signal_no
    FROM j_flags WINDOW w AS (PARTITION BY session_id ORDER BY event_idx)""")
cte("j_firsts", """
    SELECT session_id, count(*) AS n_events,
      min(event_idx) FILTER (product_id IS NOT NULL AND interaction_no = 2) AS second_touch,
      min(event_idx) FILTER ((repeat_view OR category_switch) AND signal_no = 2) AS second_signal,
      min(event_idx) FILTER (event_type = 'cart') AS cart,
      min(event_idx) FILTER (event_type = 'purchase') AS bought
    FROM j_ordinals GROUP BY 1""")
cte("j_raw_cuts", """
    SELECT session_id, n_events, bought IS NOT NULL AS label,
      coalesce(bought, n_events) - 1 AS max_admissible_idx, second_touch AS s1,
      CASE WHEN second_signal > second_touch AND (cart IS NULL OR second_signal < cart)
        THEN second_signal END AS s2,
      CASE WHEN cart >= second_touch THEN cart END AS s3, coalesce(bought, n_events - 1) AS s4
    FROM j_firsts""")
cte("j_cuts", """
    SELECT session_id, label, n_events, max_admissible_idx,
      CASE WHEN s1 <= max_admissible_idx THEN s1 END AS "cut_S1",
      CASE WHEN s2 <= max_admissible_idx THEN s2 END AS "cut_S2",
      CASE WHEN s3 <= max_admissible_idx THEN s3 END AS "cut_S3", s4 AS "cut_S4"
    FROM j_raw_cuts""")
cte("j_stage_cuts", """
    SELECT session_id, label, 'S1' AS stage, "cut_S1" AS cut FROM j_cuts UNION ALL
    SELECT session_id, label, 'S2', "cut_S2" FROM j_cuts UNION ALL
    SELECT session_id, label, 'S3', "cut_S3" FROM j_cuts UNION ALL
    SELECT session_id, label, 'S4', "cut_S4" FROM j_cuts""")
cte("j_prefix", """
    SELECT o.*, c.stage, c.cut, c.label FROM j_ordered o JOIN j_stage_cuts c
      ON o.session_id = c.session_id AND c.stage <> 'S4' AND o.event_idx <= c.cut""")
# features, recomputed inside each prefix ------------------------------------
def _feature_ctes(p: str, source: str) -> None:
    cte(f"{p}_steps", f"""
        SELECT *, (epoch_us(event_time) - lag(epoch_us(event_time)) OVER w) / 1e6 AS gap_s,
          (lead(epoch_us(event_time)) OVER w - epoch_us(event_time)) / 1e6 AS dwell_s,
          lag(category_id) OVER w AS prev_cat,
          product_id IS NOT NULL AND row_number() OVER (
            PARTITION BY session_id, stage, product_id ORDER BY event_idx) > 1 AS prod_seen,
          category_id IS NOT NULL AND row_number() OVER (
            PARTITION BY session_id, stage, category_id ORDER BY event_idx) > 1 AS cat_seen
        FROM {source} WINDOW w AS (PARTITION BY session_id, stage ORDER BY event_idx)""")
    cte(f"{p}_shares", f"""
        SELECT session_id, stage, round(-sum(c / t * ln(c / t)), 12) AS h FROM (
          SELECT session_id, stage, category_id, CAST(count(*) AS DOUBLE) AS c,
            sum(count(*)) OVER (PARTITION BY session_id, stage) AS t
          FROM {source} WHERE category_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""")
    cte(f"{p}_sums", f"""
        SELECT session_id, stage, bool_or(label) AS label, CAST(count(*) AS DOUBLE) AS n_events,
          CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS n_views,
          CAST(count(DISTINCT product_id) + max(CAST(product_id IS NULL AS INT)) AS DOUBLE)
            AS n_unique_products,
          CAST(count(DISTINCT category_id) + max(CAST(category_id IS NULL AS INT)) AS DOUBLE)
            AS n_unique_categories,
          (max(epoch_us(event_time)) - min(epoch_us(event_time))) / 1e6 AS prefix_duration_s,
          coalesce(avg(gap_s), 0) AS inter_event_mean_s,
          coalesce(stddev_samp(gap_s), 0) AS inter_event_std_s,
          coalesce(arg_max(gap_s, event_idx), 0) AS last_gap_s,
          CAST(hour(min(event_time)) AS DOUBLE) AS hour_of_day,
          CAST(CAST(isodow(min(event_time)) >= 6 AS INT) AS DOUBLE) AS is_weekend,
          coalesce(sum(dwell_s), 0) AS dwell_total_s,
          coalesce(avg(dwell_s) FILTER (event_type = 'view'), 0) AS dwell_mean_product_s,
          CAST(count(*) FILTER (category_id <> prev_cat) AS DOUBLE) AS n_category_transitions,
          count(DISTINCT prev_cat || '->' || category_id) FILTER (category_id <> prev_cat) + 1 AS pairs,
          avg(CAST(cat_seen AS INT)) AS category_revisit_rate,
          avg(CAST(prod_seen AS INT)) AS product_revisit_rate,
          count(*) FILTER (event_type = 'view') * 1.0e0 + count(*) FILTER (event_type = 'cart') * 4.0e0
            - count(*) FILTER (event_type = 'remove_from_cart') * 2.0e0 AS purchase_intent_score,
          avg(price) AS price_mean, max(price) AS price_max
        FROM {p}_steps GROUP BY 1, 2""")
    cte(f"{p}_feats", f"""
        SELECT s.*, CASE WHEN abs(coalesce(h, 0)) < 1e-12 THEN 0 ELSE h END AS category_entropy,
          CASE WHEN n_unique_categories > 1 THEN coalesce(h, 0) / ln(n_unique_categories) ELSE 0 END
            AS category_entropy_normalised,
          n_events / (prefix_duration_s + 1e-9) AS click_velocity,
          n_events / (prefix_duration_s / 60 + 1e-9) AS events_per_active_minute,
          CASE WHEN n_category_transitions > 0 THEN pairs / n_category_transitions ELSE 0 END
            AS distinct_transition_rate
        FROM {p}_sums s LEFT JOIN {p}_shares e ON s.session_id = e.session_id AND s.stage = e.stage""")


_feature_ctes("j", "j_prefix")
# splits -------------------------------------------------------------------
cte("j_starts", """
    SELECT s.session_id, min(user_id) AS user_id, min(event_time) AS session_start,
      bool_or(c.label) AS label
    FROM j_sessions s JOIN j_cuts c ON s.session_id = c.session_id GROUP BY 1""")
cte("j_user_ranks", """
    SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '|42')) AS r, count(*) OVER () AS n
    FROM (SELECT DISTINCT user_id FROM j_starts)""")
cte("j_split", """
    SELECT t.session_id, t.user_id, t.label, t.session_start,
      CASE WHEN r <= round_even(n * 0.7e0, 0) THEN 'train'
        WHEN r <= round_even(n * 0.7e0, 0) + round_even(n * 0.15e0, 0) THEN 'val' ELSE 'test' END
        AS "partition"
    FROM j_starts t JOIN j_user_ranks u ON t.user_id = u.user_id""")
# rule scores ----------------------------------------------------------------
cte("j_runs", """
    SELECT * FROM (VALUES ('baseline', 0), ('+temporal', 1), ('+entropy_velocity', 2), ('full', 3),
      ('baseline+entropy_velocity', 4)) AS a(feature_set, i),
      (VALUES (42), (43), (44), (45), (46)) AS b(seed)""")
cte("j_scores", """
    SELECT stage, 'rule' AS model, feature_set, seed, "partition", f.session_id,
      CAST(f.label AS INT) AS y,
      round(1 / (1 + exp(-((0.1e0 + 0.01e0 * (seed - 42)) * n_events
        - (0.01e0 + 0.002e0 * i) * price_mean + 0.05e0 * i * category_entropy
        - 0.001e0 * i * hour_of_day))), 3) AS score
    FROM j_feats f JOIN j_split p ON f.session_id = p.session_id, j_runs""")
cte("j_test", """SELECT * FROM j_scores WHERE "partition" = 'test'""")
cte("j_levels", """
    SELECT stage, model, feature_set, seed, score, count(*) FILTER (y = 1) AS pos,
      count(*) FILTER (y = 0) AS neg FROM j_test GROUP BY ALL""")
cte("j_counts", """
    SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
      CAST(sum(pos) OVER g AS BIGINT) AS n_pos, CAST(sum(neg) OVER g AS BIGINT) AS n_neg
    FROM j_levels WINDOW g AS (PARTITION BY stage, model, feature_set, seed),
      w AS (PARTITION BY stage, model, feature_set, seed ORDER BY score DESC)""")
