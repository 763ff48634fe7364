"""Survey clicks and click traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.functions.keys import client_key, event_log_ts, strip_quotes
from clicktrail.functions.textparse import REQUEST_TYPE
from clicktrail.sources.adapters import YES_BUTTON


def yes_clicks(responses: DataFrame, hosts: Sequence[str] | None = None) -> DataFrame:
    """P8: 'yes' button clicks, optionally on the given hosts only."""
    cond = F.col("event_surveyResponseValue") == YES_BUTTON
    if hosts is not None:
        cond = cond & F.col("webHost").isin(list(hosts))
    return responses.where(cond)


def attach_title(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Inner join with the page table for the title of the page the survey was shown on."""
    p = pages.select(F.col("page_id"), F.col("page_title").alias("title"))
    return responses.join(p, responses["event_pageId"] == p["page_id"], "inner").drop("page_id")


def click_events(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """P8 + J3 + F8: yes clicks with title, token, client fields and a parsed timestamp."""
    y = attach_title(yes_clicks(responses), pages)
    return y.select(
        "webHost",
        "title",
        F.col("event_surveyInstanceToken").alias("survey_token"),
        "clientIp",
        "userAgent",
        event_log_ts(F.col("timestamp")).alias("timestamp"),
    )


def first_click(clicks: DataFrame, token: str = "survey_token") -> DataFrame:
    """Earliest click per token; ties broken by the remaining fields so the pick is deterministic.

    An aggregate (``min_by`` on the ordering struct), not a window: partial
    aggregation keeps a token shared by many rows (or a NULL token) from
    landing in one task.
    """
    others = [c for c in clicks.columns if c not in (token, "timestamp")]
    # NULLs sort last, like the original sort; (is_null, value) pairs order that way
    order = F.struct(
        *[x for c in ["timestamp", *others] for x in (F.col(c).isNull().alias(f"_n_{c}"), F.col(c).alias(c))]
    )
    row = F.struct(*[F.col(c) for c in clicks.columns if c != token])
    picked = clicks.groupBy(token).agg(F.min_by(row, order).alias("_r"))
    return picked.select(token, "_r.*").select(*clicks.columns)


def valid_clicks(clicks: DataFrame) -> DataFrame:
    """Drop clicks whose client key cannot be formed."""
    return clicks.where(F.col("clientIp").isNotNull() & F.col("userAgent").isNotNull())


def click_table(clicks: DataFrame) -> DataFrame:
    """F6 + F7: (key, click_data) rows; key = clientIp + userAgent without its quotes."""
    return clicks.select(
        client_key(F.col("clientIp"), strip_quotes(F.col("userAgent"))).alias("key"),
        F.struct("title", "survey_token", "timestamp").alias("click_data"),
    )


def prepared_clicks(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Yes clicks ready for the trace join: P8 -> J3 -> F8 -> W1 -> P9 -> F7/F6."""
    return click_table(valid_clicks(first_click(click_events(responses, pages))))


def clicked_log(log: DataFrame, clicks: DataFrame) -> DataFrame:
    """The request-log rows of clients that clicked: one page view in hundreds leads to a click, so this comes first."""
    keys = clicks.select(F.col("key").alias("_key")).distinct()
    return log.join(keys, client_key(F.col("client_ip"), F.col("user_agent")) == F.col("_key"), "left_semi")


def join_traces_clicks(rows: DataFrame, clicks: DataFrame) -> DataFrame:
    """Inner equi-join of trace rows and clicks on the client key; the click's fields become columns."""
    c = clicks.select(
        "key",
        F.col("click_data.survey_token").alias("survey_token"),
        F.col("click_data.timestamp").alias("click_dt_utc"),
        F.col("click_data.title").alias("click_title"),
    )
    return rows.withColumn("key", client_key(F.col("ip"), F.col("ua"))).join(c, "key", "inner")


def nest_click_traces(joined: DataFrame) -> DataFrame:
    """The nested form for the click-trace sink: ``key, requests, click_data, geo_data, ua_data``.

    An array holds the trace of one clicking client.
    """
    names = [f.name for f in REQUEST_TYPE.fields]
    nested = joined.groupBy("key", "trace", "survey_token", "click_dt_utc", "click_title").agg(
        F.array_sort(F.collect_list(F.struct(*names))).alias("requests"),
        F.first("geocoded_data").alias("geo_data"),
        F.first("user_agent_map").alias("ua_data"),
    )
    click = F.struct(F.col("click_title").alias("title"), "survey_token", F.col("click_dt_utc").alias("timestamp"))
    return nested.select("key", "requests", click.alias("click_data"), "geo_data", "ua_data")


def coverage(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named stage, as one small DataFrame (counts run on the executors)."""
    out = None
    for name, df in stages.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = c if out is None else out.unionByName(c)
    return out
