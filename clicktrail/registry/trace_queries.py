"""Queries over the trace, click and survey jobs (X1, X3, X4, X8 and their steps)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clicktrail.operators import clicks as C
from clicktrail.operators import requests as R
from clicktrail.operators import survey as SV
from clicktrail.plans import jobs as P
from clicktrail.registry import register
from clicktrail.registry.sqlbits import CLICKS, survey_ctes, trace_ctes
from clicktrail.sources import tables as T
from clicktrail.sources.adapters import duckdb_with

# At most ~6 events per (client, day, host) in the driver tables, so a cap of 4 both keeps and drops groups (A2).
CAP = 4
# Driver data is from January 2024; this cut-off drops the first two days of answers.
CUTOFF = "2024-01-03 00:00:00"
# For queries that are not about the cut-off: before the first answer.
NO_CUTOFF = "2000-01-01 00:00:00"
# Answers arrive hours after their click request in the driver data, so the latency cut is one day (P20).
MAX_SECONDS = 86_400


def day_traces(spark, sf_dir, cap=None):
    return P.build_trace_table(T.request_log(spark, sf_dir), T.redirects(spark, sf_dir), max_requests=cap)


def merged_traces(spark, sf_dir):
    return P.build_merged_traces(T.request_log(spark, sf_dir), T.redirects(spark, sf_dir))


def all_rows(spark, sf_dir):
    return P.numbered_trace_rows(T.request_log(spark, sf_dir), T.redirects(spark, sf_dir))


def click_stages(spark, sf_dir):
    return P.click_stages(
        T.request_log(spark, sf_dir), T.redirects(spark, sf_dir), T.responses_log(spark, sf_dir), T.page_table(spark, sf_dir)
    )


def survey_stages(spark, sf_dir, cutoff=NO_CUTOFF, max_seconds=None):
    return P.survey_stages(
        T.request_log(spark, sf_dir), T.redirects(spark, sf_dir), T.raw_survey(spark, sf_dir),
        T.responses_log(spark, sf_dir), T.page_table(spark, sf_dir), cutoff, max_seconds,
    )


TRACES = duckdb_with("request_log", "redirects") + trace_ctes()
ALL = duckdb_with("request_log", "redirects", "responses_log", "page", "raw_survey") + trace_ctes()


@register(
    "build_traces",
    TRACES
    + """
SELECT client_ip AS ip, user_agent AS ua, uri_host AS host, year, month, day, timezone,
       cast(row_number() OVER (PARTITION BY client_ip, user_agent, timezone, country, browser_family, uri_host, year, month, day
                               ORDER BY ts, referer, title) - 1 AS INTEGER) AS id,
       epoch_us(ts) AS ts_us, title, referer
FROM day_reqs
""",
)
def build_traces(spark, sf_dir):
    """The requests of every client's day on a host, numbered in time order."""
    rows = R.trace_rows(T.request_log(spark, sf_dir), T.redirects(spark, sf_dir))
    in_day = Window.partitionBy("trace", "host", "year", "month", "day").orderBy(*R.TRACE_ORDER)
    return rows.withColumn("id", F.row_number().over(in_day) - 1).select(
        "ip", "ua", "host", "year", "month", "day", F.col("geocoded_data")["timezone"].alias("timezone"), "id",
        F.unix_micros("ts").alias("ts_us"), "title", "referer",
    )


@register(
    "heavy_client_cut",
    duckdb_with("request_log", "redirects") + trace_ctes(CAP)
    + """
SELECT g.client_ip AS ip, g.user_agent AS ua, g.uri_host AS host, g.year, g.month, g.day, g.timezone,
       count(d.ts) AS n_requests, string_agg(d.title, ',' ORDER BY d.ts, d.referer, d.title) AS titles
FROM day_groups g LEFT JOIN day_reqs d
  USING (client_ip, user_agent, timezone, country, browser_family, uri_host, year, month, day)
GROUP BY g.client_ip, g.user_agent, g.timezone, g.country, g.browser_family, g.uri_host, g.year, g.month, g.day
""",
)
def heavy_client_cut(spark, sf_dir):
    """A2: the nested per-day traces of clients with fewer than CAP requests on that day and host."""
    t = P.flat_trace_summary(day_traces(spark, sf_dir, CAP))
    return t.select(
        "ip", "ua", "host", "year", "month", "day", F.col("geocoded_data")["timezone"].alias("timezone"),
        "n_requests", "titles",
    )


@register(
    "merge_traces",
    TRACES
    + """SELECT client_ip AS ip, user_agent AS ua, timezone, country, browser_family, cast(id AS INTEGER) AS id,
       epoch_us(ts) AS ts_us, title FROM reqs""",
)
def merge_traces(spark, sf_dir):
    """The requests of every client's whole trace, numbered over all days and hosts."""
    return all_rows(spark, sf_dir).select(
        "ip", "ua", F.col("geocoded_data")["timezone"].alias("timezone"),
        F.col("geocoded_data")["country"].alias("country"),
        F.col("user_agent_map")["browser_family"].alias("browser_family"), "id", F.unix_micros("ts").alias("ts_us"), "title",
    )


@register(
    "click_events",
    ALL + "," + CLICKS + "SELECT key, survey_token, title, epoch_us(ts) AS click_us FROM clicks",
)
def click_events(spark, sf_dir):
    c = C.prepared_clicks(T.responses_log(spark, sf_dir), T.page_table(spark, sf_dir))
    return c.select(
        "key", F.col("click_data.survey_token").alias("survey_token"), F.col("click_data.title").alias("title"),
        F.unix_micros("click_data.timestamp").alias("click_us"),
    )


@register(
    "click_traces",
    ALL + "," + CLICKS
    + "SELECT key, survey_token, click_title, epoch_us(click_ts) AS click_us, n_requests, timezone FROM pairs",
)
def click_traces_q(spark, sf_dir):
    """Every yes click with each trace of its client."""
    return click_stages(spark, sf_dir).click_hits.select(
        "key", "survey_token", "click_title", F.unix_micros("click_dt_utc").alias("click_us"), "n_requests",
        F.col("geo_data")["timezone"].alias("timezone"),
    )


@register(
    "asof_click_request",
    ALL + "," + CLICKS + "SELECT key, survey_token, click_request_id, time_to_click FROM click_asof",
)
def asof_click_request(spark, sf_dir):
    return click_stages(spark, sf_dir).click_hits.select(
        "key", "survey_token", F.col("click_request.id").cast("bigint").alias("click_request_id"), "time_to_click"
    )


SURVEY = duckdb_with("raw_survey", "responses_log")


@register(
    "clean_responses",
    SURVEY + survey_ctes(CUTOFF)
    + """
SELECT token, epoch_us(submit_timestamp) AS submit_us, information_depth, prior_knowledge, motivation,
       raw_motivation FROM clean
""",
)
def clean_responses(spark, sf_dir):
    c = SV.clean_responses(T.raw_survey(spark, sf_dir), CUTOFF)
    return c.select(
        "token", F.unix_micros("submit_timestamp").alias("submit_us"),
        F.col("information depth").alias("information_depth"), F.col("prior knowledge").alias("prior_knowledge"),
        F.array_join("motivation", "|").alias("motivation"), "raw_motivation",
    )


@register(
    "survey_in_el",
    SURVEY + survey_ctes(NO_CUTOFF)
    + "SELECT token, host, information_depth, prior_knowledge, motivation FROM survey_in_el",
)
def survey_in_el(spark, sf_dir):
    s = P.survey_in_el(T.raw_survey(spark, sf_dir), T.responses_log(spark, sf_dir), NO_CUTOFF)
    return s.select(
        "token", "host", F.col("information depth").alias("information_depth"),
        F.col("prior knowledge").alias("prior_knowledge"), F.array_join("motivation", "|").alias("motivation"),
    )


# CTE 'rwt': the responses with traces, keeping the trace identity for the request rows
RWT_CTES = (
    ALL + survey_ctes(NO_CUTOFF) + "," + CLICKS
    + """,
joined AS (
  SELECT s.*, a.key AS client_token, a.survey_token, a.click_request_id, a.time_to_click,
         a.client_ip, a.user_agent, a.timezone, a.country, a.browser_family, a.click_ts
  FROM survey_in_el s JOIN click_asof a ON a.survey_token = s.token
  WHERE a.click_request_id IS NOT NULL),
w2 AS (SELECT * FROM joined WHERE survey_token IN
        (SELECT survey_token FROM joined GROUP BY survey_token HAVING count(*) = 1)),
rwt AS (SELECT * FROM w2 WHERE client_token IN
        (SELECT client_token FROM w2 GROUP BY client_token HAVING count(*) = 1))
"""
)
_RWT_COLS = """SELECT survey_token, client_token, host, click_request_id, time_to_click, information_depth, prior_knowledge,
       motivation FROM rwt"""


def _flat_responses(r):
    return r.select(
        "survey_token", "client_token", "host", F.col("click_request.id").cast("bigint").alias("click_request_id"),
        "time_to_click", F.col("information depth").alias("information_depth"),
        F.col("prior knowledge").alias("prior_knowledge"), F.array_join("motivation", "|").alias("motivation"),
    )


@register("responses_with_traces", RWT_CTES + _RWT_COLS)
def responses_with_traces(spark, sf_dir):
    """Every answer that leads to one click, one client and the request it came from."""
    return _flat_responses(survey_stages(spark, sf_dir).responses)


@register("quick_responses", RWT_CTES + _RWT_COLS + f" WHERE time_to_click < {MAX_SECONDS}")
def quick_responses(spark, sf_dir):
    """P20: the answers whose click came within a day of its request."""
    return _flat_responses(survey_stages(spark, sf_dir, max_seconds=MAX_SECONDS).responses)
