"""Tracking quality report: funnel counts, uniqueness, cross-source matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.functions.keys import form_ts, strip_quotes
from clicktrail.operators import stats as ST
from clicktrail.sources.adapters import NO_BUTTON, Q_TIMESTAMP, Q_TOKEN, YES_BUTTON

TOKEN = "event_surveyInstanceToken"


def _q(name: str):
    return F.col(f"`{name}`")


def survey_funnel(initiation: DataFrame, responses: DataFrame) -> DataFrame:
    """A4: eligible page views, widget impressions, responses, yes and no clicks as (metric, n) rows."""
    i = initiation.agg(
        F.count_if(F.col("event_eventName") == "eligible").alias("eligible"),
        F.count_if(F.col("event_eventName") == "impression").alias("impressions"),
    )
    r = responses.agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(F.col("event_surveyResponseValue") == YES_BUTTON).alias("yes"),
        F.count_if(F.col("event_surveyResponseValue") == NO_BUTTON).alias("no"),
    )
    return i.unpivot([], ["eligible", "impressions"], "metric", "n").unionByName(
        r.unpivot([], ["responses", "yes", "no"], "metric", "n")
    )


def distinct_tokens(initiation: DataFrame) -> DataFrame:
    """A5: distinct survey tokens per initiation event type."""
    return initiation.groupBy("event_eventName").agg(F.count_distinct(TOKEN).alias("n"))


def distinct_clients(initiation: DataFrame) -> DataFrame:
    """Distinct IPs, distinct IP+agent pairs and distinct session tokens."""
    return initiation.agg(
        F.count_distinct("clientIP").alias("n_ips"),
        F.count_distinct(F.concat("clientIP", "userAgent")).alias("n_ip_agents"),
        F.count_distinct("event_surveySessionToken").alias("n_session_tokens"),
    )


def _tokens(initiation: DataFrame, event: str) -> DataFrame:
    return initiation.where(F.col("event_eventName") == event).select(TOKEN)


def matched_tokens(initiation: DataFrame) -> DataFrame:
    """Distinct impression tokens that also have an eligible page view (semi-join)."""
    imp = _tokens(initiation, "impression")
    el = _tokens(initiation, "eligible")
    return imp.join(el, TOKEN, "left_semi").agg(F.count_distinct(TOKEN).alias("n"))


def responses_with_impression(responses: DataFrame, initiation: DataFrame) -> DataFrame:
    """Responses joined to impressions on the token (all columns of both)."""
    imp = initiation.where(F.col("event_eventName") == "impression").withColumnRenamed(TOKEN, "_tok")
    return responses.join(imp, responses[TOKEN] == imp["_tok"], "inner").drop("_tok")


def answer_matches(
    survey: DataFrame, responses: DataFrame, initiation: DataFrame, slice_start: str, slice_stop: str
) -> DataFrame:
    """J12-J14 + P22: form answers matched to clicks, impressions and eligible views; counts inside a time slice.

    Returns one row: n_answers, n_with_click, n_with_impression, n_with_eligible,
    n_in_slice, n_click_in_slice (slice bounds exclusive).
    """
    s = survey.select(_q(Q_TOKEN).alias("_tok"), form_ts(_q(Q_TIMESTAMP)).alias("_ts"))
    clicks = responses_with_impression(responses, initiation).select(F.col(TOKEN).alias("_tok"))
    imp = _tokens(initiation, "impression").withColumnRenamed(TOKEN, "_tok")
    el = _tokens(initiation, "eligible").withColumnRenamed(TOKEN, "_tok")
    inside = (F.col("_ts") > F.to_timestamp(F.lit(slice_start))) & (F.col("_ts") < F.to_timestamp(F.lit(slice_stop)))
    tagged = (
        s.select(F.lit("answer").alias("_tag"), "_ts")
        .unionByName(s.join(clicks, "_tok").select(F.lit("click").alias("_tag"), "_ts"))
        .unionByName(s.join(imp, "_tok").select(F.lit("impression").alias("_tag"), "_ts"))
        .unionByName(s.join(el, "_tok").select(F.lit("eligible").alias("_tag"), "_ts"))
    )
    tag = F.col("_tag")
    return tagged.agg(
        F.count_if(tag == "answer").alias("n_answers"),
        F.count_if(tag == "click").alias("n_with_click"),
        F.count_if(tag == "impression").alias("n_with_impression"),
        F.count_if(tag == "eligible").alias("n_with_eligible"),
        F.count_if((tag == "answer") & inside).alias("n_in_slice"),
        F.count_if((tag == "click") & inside).alias("n_click_in_slice"),
    )


def funnel_rates(matches: DataFrame, funnel: DataFrame) -> DataFrame:
    """Yes clicks per eligible view, tracked answers per yes click, share of answers tracked."""
    long = funnel.select("metric", F.col("n").cast("bigint").alias("n")).unionByName(
        matches.unpivot([], ["n_answers", "n_with_click"], "metric", "n").select(
            "metric", F.col("n").cast("bigint").alias("n")
        )
    )
    wide = long.groupBy().pivot("metric", ["eligible", "yes", "n_answers", "n_with_click"]).agg(F.first("n"))
    return wide.select(
        (F.col("yes") / F.col("eligible")).alias("yes_per_eligible"),
        (F.col("n_with_click") / F.col("yes")).alias("answers_per_yes"),
        (F.col("n_with_click") / F.col("n_answers")).alias("tracked_share"),
    )


def unmatched_answers(survey: DataFrame, responses: DataFrame, initiation: DataFrame) -> DataFrame:
    """J15 + O6: every form answer with its event-log click if any (left join), ordered by answer time."""
    s = survey.select(_q(Q_TOKEN).alias("answer_token"), form_ts(_q(Q_TIMESTAMP)).alias("answer_time"))
    c = responses_with_impression(responses, initiation).select(
        F.col(TOKEN).alias("click_token"), F.col("timestamp").alias("click_time")
    )
    return s.join(c, s["answer_token"] == c["click_token"], "left").orderBy("answer_time", "answer_token", "click_token")


def ua_shares(initiation: DataFrame) -> DataFrame:
    """User-agent counts among eligible views and their shares, quotes removed."""
    el = initiation.where(F.col("event_eventName") == "eligible")
    shares = ST.value_shares(el, "userAgent")
    return shares.select(strip_quotes(F.col("userAgent")).alias("user_agent"), F.col("count").alias("n"), "proportion")


def ua_counts(requests: DataFrame) -> DataFrame:
    """User agents of the request log with their request counts."""
    return requests.groupBy("user_agent").agg(F.count(F.lit(1)).alias("n"))


def ua_share_delta(ua_counts_df: DataFrame, initiation: DataFrame, top: int = 1000, show: int = 25) -> DataFrame:
    """A10 + O2 + J16 + O3: shares of the ``top`` web agents against all requests, minus their share among
    eligible views (missing -> 0); the ``show`` largest differences."""
    total = ua_counts_df.agg(F.sum("n").alias("n"))
    top_agents = ST.top_k(ua_counts_df, [F.desc("n"), F.asc("user_agent")], top)
    web = ST.share_of_external(top_agents, "n", total).withColumnRenamed("proportion", "proportion_web")
    el = ua_shares(initiation).select(F.col("user_agent").alias("_ua"), F.col("proportion").alias("proportion_el"))
    merged = web.join(el, web["user_agent"] == el["_ua"], "left").drop("_ua").fillna(
        0.0, subset=["proportion_el"]
    )
    merged = merged.withColumn("delta", F.col("proportion_web") - F.col("proportion_el"))
    return ST.top_k(merged, [F.desc("delta"), F.asc("user_agent")], show)


def client_freq_of_freq(clicks: DataFrame) -> DataFrame:
    """How many clients (ip + agent) made one, two, ... yes clicks."""
    return ST.freq_of_freq(clicks, F.concat("clientIp", "userAgent"))
