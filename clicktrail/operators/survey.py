"""Survey answers: cleaning (X8), joins to clicks and traces (J4, J5, X4) and answer filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.functions import recode as RC
from clicktrail.functions.keys import form_ts
from clicktrail.operators.clicks import yes_clicks
from clicktrail.operators.joins import keep_unique
from clicktrail.sources import adapters as A

LAUNCH_CUTOFF = "2016-02-29 16:17:00"  # fixed value: survey launch, answers before it are tests
NO_RESPONSE = "no response"


def after_launch(raw: DataFrame, cutoff: str = LAUNCH_CUTOFF, ts_col: str = A.Q_TIMESTAMP) -> DataFrame:
    """Answers submitted after the cut-off (compared as timestamps, not as text)."""
    return raw.where(form_ts(F.col(f"`{ts_col}`")) > F.to_timestamp(F.lit(cutoff)))


def first_response(df: DataFrame, token: str = "token") -> DataFrame:
    """One answer per token: the earliest submission, ties by the answer fields.

    An aggregate (``min_by``) rather than a window, so a token held by many
    rows - all missing tokens become one - is reduced map-side.
    """
    others = [c for c in df.columns if c not in (token, "submit_timestamp")]
    order = F.struct(
        F.col("submit_timestamp").isNull().alias("_null_ts"),
        F.col("submit_timestamp").alias("_ts"),
        *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(others)],
    )
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != token])
    picked = df.groupBy(token).agg(F.min_by(row, order).alias("_r"))
    return picked.select(token, "_r.*").select(*[F.col(f"`{c}`") for c in df.columns])


def clean_responses(raw: DataFrame, cutoff: str = LAUNCH_CUTOFF) -> DataFrame:
    """P15 -> P16 -> P11 -> F9 -> F11/F12/F13 -> W4.

    Output columns: submit_timestamp, the three raw answers, token, and the
    codes 'information depth', 'prior knowledge', 'motivation' (an array).
    """
    d = after_launch(raw, cutoff)
    d = d.fillna("no_response")  # P16: also fills missing tokens, so they collapse in W4
    d = d.withColumnsRenamed(RC.RAW_COLUMNS)  # P11
    d = d.withColumn("submit_timestamp", form_ts(F.col("submit_timestamp")))  # F9
    d = (
        d.withColumn("information depth", RC.recode_depth(F.col("raw_information_depth")))
        .withColumn("prior knowledge", RC.recode_prior(F.col("raw_prior_knowledge")))
        .withColumn("motivation", RC.recode_motivation(F.col("raw_motivation")))
    )
    return first_response(d)


def survey_clicks(responses: DataFrame, hosts: Sequence[str] = (A.DESKTOP_HOST, A.MOBILE_HOST)) -> DataFrame:
    """Yes clicks on the two wikis as (host, token), host recoded to desktop/mobile (P8 + F10)."""
    return yes_clicks(responses, hosts).select(
        RC.recode_host(F.col("webHost")).alias("host"), F.col("event_surveyInstanceToken").alias("token")
    )


def join_survey_clicks(clean: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers with a yes click; clicks are not de-duplicated, so a token clicked twice gives two rows."""
    return clean.join(survey_clicks(responses), "token", "inner")


def responses_with_traces(survey_in_el: DataFrame, click_hits: DataFrame, max_seconds: float | None = None) -> DataFrame:
    """J5 -> P11 -> P13 -> W2 -> W3 (-> P20 when ``max_seconds`` is given); this order changes results.

    ``click_hits`` has one row per click and trace: the click's fields (P10), the
    ``trace`` key under which the trace's rows are found, and the request that
    the click came from (W6, J6, F22).
    """
    s, c = survey_in_el, click_hits
    df = s.join(c, s["token"] == c["survey_token"], "inner").drop("token")  # J5
    df = df.withColumnsRenamed({"submit_timestamp": "survey_submit_dt", "key": "client_token"})
    df = df.dropna(subset=["click_request"])  # P13
    df = keep_unique(df, "survey_token")  # W2
    df = keep_unique(df, "client_token")  # W3
    return df if max_seconds is None else within(df, max_seconds)  # P20


def drop_no_response(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows answering 'no response' on any of ``cols``."""
    cond = None
    for c in cols:
        x = F.col(f"`{c}`") != NO_RESPONSE
        cond = x if cond is None else cond & x
    return df.where(cond) if cond is not None else df


def with_single_motivation(df: DataFrame, motivations: str = "motivation") -> DataFrame:
    """P18: 'single motivation' column (NULL when several were given)."""
    return df.withColumn("single motivation", RC.single_motivation(F.col(motivations)))


def n_motivations(df: DataFrame, n: int, motivations: str = "motivation") -> DataFrame:
    """Answers with exactly ``n`` motivations."""
    return df.where(F.size(F.col(motivations)) == n)


def condition_on(df: DataFrame, **conditions: str) -> DataFrame:
    """Keep rows equal to each given value; 'any' means no filter on that column."""
    for col, value in conditions.items():
        if value != "any":
            df = df.where(F.col(f"`{col}`") == value)
    return df


def host_slices(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P25: (desktop rows, mobile rows), named after what they hold."""
    return df.where(F.col("host") == "desktop"), df.where(F.col("host") == "mobile")


def within(df: DataFrame, max_seconds: float, col: str = "time_to_click") -> DataFrame:
    """P20: responses clicked within ``max_seconds`` of their request."""
    return df.where(F.col(col) < max_seconds)
