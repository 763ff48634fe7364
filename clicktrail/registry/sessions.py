"""Queries over sessions: W5 + T4-T6 (the flagship)."""

from __future__ import annotations

from clicktrail.operators import requests as R
from clicktrail.operators import sessions as S
from clicktrail.registry import register
from clicktrail.registry.sqlbits import TRAFFIC
from clicktrail.sources import tables as T
from clicktrail.sources.adapters import duckdb_with

# The driver tables hold ~30 days with a median gap of hours between a
# user's events, so a one-day gap gives multi-request sessions.
GAP_MINUTES = 1440
GAP_US = GAP_MINUTES * 60_000_000

SESSIONIZED_SQL = f"""
lagged AS (
  SELECT *, epoch_us(ts) AS us,
         lag(epoch_us(ts)) OVER (PARTITION BY client_ip, user_agent ORDER BY ts, req_id) AS prev_us
  FROM traffic),
sessionized AS (
  SELECT *, sum(CASE WHEN prev_us IS NULL OR us - prev_us > {GAP_US} THEN 1 ELSE 0 END)
              OVER (PARTITION BY client_ip, user_agent ORDER BY ts, req_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS session_id
  FROM lagged)
"""


@register(
    "session_metrics",
    duckdb_with("request_log")
    + f", traffic AS ({TRAFFIC}), {SESSIONIZED_SQL}"
    + """
SELECT client_ip, user_agent, cast(session_id AS INTEGER) AS session_id,
       count(*) AS n_requests,
       count(*) FILTER (WHERE is_pageview) AS num_pageviews,
       CASE WHEN count(*) < 2 THEN 0.0
            ELSE (floor(max(us) / 1000000) - floor(min(us) / 1000000)) / 60.0 END AS session_length,
       count(*) FILTER (WHERE referer_class = 'external (search engine)') AS external_searches
FROM sessionized GROUP BY client_ip, user_agent, session_id
""",
)
def session_metrics(spark, sf_dir):
    log = R.filter_traffic(T.request_log(spark, sf_dir))
    return S.session_metrics(log, gap_minutes=GAP_MINUTES)


@register(
    "sessionize",
    duckdb_with("request_log")
    + f", traffic AS ({TRAFFIC}), {SESSIONIZED_SQL}"
    + """
SELECT req_id, client_ip, user_agent, cast(session_id AS INTEGER) AS session_id FROM sessionized
""",
)
def sessionize(spark, sf_dir):
    log = R.filter_traffic(T.request_log(spark, sf_dir))
    return S.sessionize(log, gap_minutes=GAP_MINUTES).select("req_id", "client_ip", "user_agent", "session_id")
