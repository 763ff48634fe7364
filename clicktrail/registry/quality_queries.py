"""Queries of the tracking quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from clicktrail.operators import clicks as C
from clicktrail.operators import quality as Q
from clicktrail.operators import stats as ST
from clicktrail.registry import register
from clicktrail.sources import adapters as A
from clicktrail.sources import tables as T
from clicktrail.sources.adapters import duckdb_with

SLICE = ("2024-01-05 00:00:00", "2024-01-10 00:00:00")
QA = duckdb_with("initiation_log", "responses_log", "raw_survey", "request_log", "page")
YES = f"'{A.YES_BUTTON}'"
TOK = f'"{A.Q_TOKEN}"'
FTS = f"try_strptime(\"{A.Q_TIMESTAMP}\", '%m/%d/%Y %H:%M:%S')"


def _init(spark, sf):
    return T.initiation_log(spark, sf)


def _resp(spark, sf):
    return T.responses_log(spark, sf)


@register(
    "survey_funnel",
    QA
    + f"""SELECT 'eligible' AS metric, count(*) FILTER (WHERE event_eventName = 'eligible') AS n FROM initiation_log
UNION ALL SELECT 'impressions', count(*) FILTER (WHERE event_eventName = 'impression') FROM initiation_log
UNION ALL SELECT 'responses', count(*) FROM responses_log
UNION ALL SELECT 'yes', count(*) FILTER (WHERE event_surveyResponseValue = {YES}) FROM responses_log
UNION ALL SELECT 'no', count(*) FILTER (WHERE event_surveyResponseValue = '{A.NO_BUTTON}') FROM responses_log""",
)
def survey_funnel(spark, sf):
    return Q.survey_funnel(_init(spark, sf), _resp(spark, sf))


@register(
    "distinct_tokens",
    QA + "SELECT event_eventName, count(DISTINCT event_surveyInstanceToken) AS n FROM initiation_log GROUP BY ALL",
)
def distinct_tokens(spark, sf):
    return Q.distinct_tokens(_init(spark, sf))


@register(
    "distinct_clients",
    QA
    + """SELECT count(DISTINCT clientIP) AS n_ips, count(DISTINCT clientIP || userAgent) AS n_ip_agents,
       count(DISTINCT event_surveySessionToken) AS n_session_tokens FROM initiation_log""",
)
def distinct_clients(spark, sf):
    return Q.distinct_clients(_init(spark, sf))


@register(
    "matched_tokens",
    QA
    + """SELECT count(*) AS n FROM (
  SELECT event_surveyInstanceToken FROM initiation_log WHERE event_eventName = 'impression'
  INTERSECT
  SELECT event_surveyInstanceToken FROM initiation_log WHERE event_eventName = 'eligible')
WHERE event_surveyInstanceToken IS NOT NULL""",
)
def matched_tokens(spark, sf):
    return Q.matched_tokens(_init(spark, sf))


# how often each token was shown, seen as eligible, and clicked: joins become products of these counts
_TIMES = """
shown AS (SELECT event_surveyInstanceToken AS token, count(*) AS times FROM initiation_log
          WHERE event_eventName = 'impression' GROUP BY ALL),
offered AS (SELECT event_surveyInstanceToken AS token, count(*) AS times FROM initiation_log
            WHERE event_eventName = 'eligible' GROUP BY ALL),
tracked AS (SELECT r.event_surveyInstanceToken AS token, count(*) * any_value(shown.times) AS times
            FROM responses_log r JOIN shown ON shown.token = r.event_surveyInstanceToken GROUP BY ALL)"""


@register(
    "responses_with_impression",
    QA + "," + _TIMES + "\nSELECT cast(sum(times) AS BIGINT) AS n_rows, count(*) AS n_tokens FROM tracked",
)
def responses_with_impression(spark, sf):
    j = Q.responses_with_impression(_resp(spark, sf), _init(spark, sf))
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(Q.TOKEN).alias("n_tokens"))


_MATCH = (
    QA
    + ","
    + _TIMES
    + f""",
answers AS (SELECT {TOK} AS token, coalesce({FTS} > TIMESTAMP '{SLICE[0]}' AND {FTS} < TIMESTAMP '{SLICE[1]}', false) AS inside
            FROM raw_survey),
m AS (SELECT count(*) AS n_answers,
             count(*) FILTER (inside) AS n_in_slice,
             cast(coalesce(sum(tracked.times), 0) AS BIGINT) AS n_with_click,
             cast(coalesce(sum(tracked.times) FILTER (inside), 0) AS BIGINT) AS n_click_in_slice,
             cast(coalesce(sum(shown.times), 0) AS BIGINT) AS n_with_impression,
             cast(coalesce(sum(offered.times), 0) AS BIGINT) AS n_with_eligible
      FROM answers LEFT JOIN tracked USING (token) LEFT JOIN shown USING (token) LEFT JOIN offered USING (token))
"""
)


@register("answer_matches", _MATCH + "SELECT * FROM m")
def answer_matches(spark, sf):
    return Q.answer_matches(T.raw_survey(spark, sf), _resp(spark, sf), _init(spark, sf), *SLICE)


@register(
    "funnel_rates",
    _MATCH
    + f"""SELECT (SELECT count(*) FROM responses_log WHERE event_surveyResponseValue = {YES})
         / (SELECT sum(times) FROM offered) AS yes_per_eligible,
       n_with_click / (SELECT count(*) FROM responses_log WHERE event_surveyResponseValue = {YES}) AS answers_per_yes,
       n_with_click / n_answers AS tracked_share FROM m""",
)
def funnel_rates(spark, sf):
    init, resp = _init(spark, sf), _resp(spark, sf)
    return Q.funnel_rates(Q.answer_matches(T.raw_survey(spark, sf), resp, init, *SLICE), Q.survey_funnel(init, resp))


@register(
    "unmatched_answers",
    QA + "," + _TIMES
    + f""",
clicked AS (SELECT r.event_surveyInstanceToken AS click_token, r.timestamp AS click_time
            FROM responses_log r, shown, range(times) WHERE shown.token = r.event_surveyInstanceToken)
SELECT {TOK} AS answer_token, epoch_us({FTS}) AS answer_us, click_token, click_time
FROM raw_survey LEFT JOIN clicked ON click_token = {TOK}""",
)
def unmatched_answers(spark, sf):
    u = Q.unmatched_answers(T.raw_survey(spark, sf), _resp(spark, sf), _init(spark, sf))
    return u.select("answer_token", F.unix_micros("answer_time").alias("answer_us"), "click_token", "click_time")


@register(
    "token_lengths",
    QA + f"SELECT cast(length({TOK}) AS INTEGER) AS length, count(*) AS count FROM raw_survey GROUP BY ALL",
)
def token_lengths(spark, sf):
    return ST.length_distribution(T.raw_survey(spark, sf), A.Q_TOKEN)


_UA = """el AS (SELECT substr(userAgent, 2, greatest(length(userAgent) - 2, 0)) AS user_agent, count(*) AS n
        FROM initiation_log WHERE event_eventName = 'eligible' GROUP BY userAgent),
el_share AS (SELECT user_agent, n, n / sum(n) OVER () AS proportion FROM el)"""


@register("ua_shares", QA + ", " + _UA + "\nSELECT * FROM el_share")
def ua_shares(spark, sf):
    return Q.ua_shares(_init(spark, sf))


@register(
    "ua_share_delta",
    QA + ", " + _UA
    + """,
web AS (SELECT user_agent, count(*) AS n FROM request_log GROUP BY ALL),
total AS (SELECT sum(n) AS t FROM web),
top_web AS (SELECT user_agent, n, n / t AS proportion_web FROM web, total ORDER BY n DESC, user_agent LIMIT 1000),
merged AS (SELECT w.user_agent, w.n, w.proportion_web, coalesce(e.proportion, 0.0) AS proportion_el,
                  w.proportion_web - coalesce(e.proportion, 0.0) AS delta
           FROM top_web w LEFT JOIN el_share e USING (user_agent))
SELECT * FROM merged ORDER BY delta DESC, user_agent LIMIT 25""",
)
def ua_share_delta(spark, sf):
    return Q.ua_share_delta(Q.ua_counts(T.flat_request_log(spark, sf)), _init(spark, sf))


@register(
    "client_freq_of_freq",
    QA
    + f""", ev AS (SELECT s.clientIp, s.userAgent FROM responses_log s JOIN page p ON p.page_id = s.event_pageId
              WHERE s.event_surveyResponseValue = {YES}),
per AS (SELECT clientIp || userAgent AS k, count(*) AS occurrences FROM ev GROUP BY 1)
SELECT occurrences, count(*) AS count FROM per GROUP BY ALL""",
)
def client_freq_of_freq(spark, sf):
    clicks = C.click_events(_resp(spark, sf), T.page_table(spark, sf))
    return Q.client_freq_of_freq(clicks)
