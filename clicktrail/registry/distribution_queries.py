"""Queries of the answer distributions (X11: P25, F21, A20, O5, O7) and of answers over local time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clicktrail.functions import recode as RC
from clicktrail.functions import temporal as TM
from clicktrail.operators import stats as ST
from clicktrail.operators import survey as SV
from clicktrail.plans import jobs as P
from clicktrail.registry import register
from clicktrail.registry.duck_random import beta_interval_ctes
from clicktrail.registry.sqlbits import survey_ctes
from clicktrail.registry.temporal_queries import ZONES
from clicktrail.registry.trace_queries import NO_CUTOFF, RWT_CTES, survey_stages
from clicktrail.sources import tables as T
from clicktrail.sources.adapters import duckdb_with

SURVEY = duckdb_with("raw_survey", "responses_log") + survey_ctes(NO_CUTOFF)
_SINGLE = "CASE WHEN len(motivation_list) = 1 THEN motivation_list[1] END"


def answers(spark, sf):
    return P.survey_in_el(T.raw_survey(spark, sf), T.responses_log(spark, sf), NO_CUTOFF)


# part -> (x, hue, share within: hue or x)
_PARTS = {
    "depth_by_host": ("information_depth", "host", "hue"),
    "prior_by_host": ("prior_knowledge", "host", "hue"),
    "single_motivation_by_host": ("single_motivation", "host", "hue"),
    "prior_given_depth": ("information_depth", "prior_knowledge", "x"),
    "depth_given_prior": ("prior_knowledge", "information_depth", "x"),
    "prior_given_motivation": ("single_motivation", "prior_knowledge", "x"),
    "depth_given_motivation": ("single_motivation", "information_depth", "x"),
}


@register(
    "distribution_tables",
    SURVEY + f", s AS (SELECT *, {_SINGLE} AS single_motivation FROM survey_in_el)\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{part}' AS part, {x} AS x, {hue} AS hue, count(*) AS count,"
        f" count(*) / sum(count(*)) OVER (PARTITION BY {hue if within == 'hue' else x}) AS proportion FROM s"
        f" WHERE {x} IS NOT NULL AND {x} <> 'no response' AND {hue} <> 'no response' GROUP BY {x}, {hue}"
        for part, (x, hue, within) in _PARTS.items()
    ),
)
def distribution_tables(spark, sf):
    """The two-way tables of the answer report."""
    tables = P.distribution_report(answers(spark, sf))
    out = None
    for part, (x, hue, _) in _PARTS.items():
        x, hue = (c.replace("_", " ") for c in (x, hue))
        t = tables[part].select(F.lit(part).alias("part"), F.col(f"`{x}`").alias("x"), F.col(f"`{hue}`").alias("hue"), "count", "proportion")
        out = t if out is None else out.unionByName(t)
    return out


_LEVELS = ", ".join(f"('{lv}')" for lv in RC.MENTION_LEVELS)


@register(
    "mention_ranking",
    SURVEY
    + f""", lv(motivation) AS (VALUES {_LEVELS}),
cnt AS (SELECT lv.motivation, count(s.token) AS count
        FROM lv LEFT JOIN survey_in_el s ON list_contains(s.motivation_list, lv.motivation) GROUP BY lv.motivation)
SELECT cast(row_number() OVER (ORDER BY count DESC, motivation) AS INTEGER) AS place, motivation, count FROM cnt""",
)
def mention_ranking(spark, sf):
    """Motivations by falling number of mentions; there is one row per level, so one window holds a fixed few."""
    m = P.distribution_report(answers(spark, sf))["mentions"]
    order = Window.orderBy(F.desc("count"), "motivation")
    return m.select(F.row_number().over(order).alias("place"), "motivation", "count")


@register(
    "host_slices",
    SURVEY + "SELECT host AS slice, information_depth, count(*) AS count FROM survey_in_el WHERE host IN ('desktop', 'mobile') GROUP BY ALL",
)
def host_slices(spark, sf):
    """Answers of the desktop and of the mobile slice."""
    desktop, mobile = SV.host_slices(answers(spark, sf))
    counted = lambda df, name: ST.value_counts(df, "information depth").select(
        F.lit(name).alias("slice"), F.col("information depth").alias("information_depth"), "count"
    )
    return counted(desktop, "desktop").unionByName(counted(mobile, "mobile"))


@register(
    "pair_labels",
    SURVEY
    + """SELECT array_to_string(list_sort(motivation_list), '|') AS label,
       array_to_string(list_reverse_sort(motivation_list), '|') AS reversed_label, count(*) AS count
FROM survey_in_el WHERE len(motivation_list) = 2 GROUP BY ALL""",
)
def pair_labels(spark, sf):
    """The label of each pair of motivations, in both orders."""
    two = SV.n_motivations(answers(spark, sf), 2)
    labels = two.select(RC.pair_label(F.col("motivation")).alias("label"), RC.pair_label(F.col("motivation"), reverse=True).alias("reversed_label"))
    return labels.groupBy("label", "reversed_label").agg(F.count(F.lit(1)).alias("count"))


@register("peek_answers", SURVEY + "SELECT token, motivation FROM clean ORDER BY token LIMIT 5")
def peek_answers(spark, sf):
    """The first five cleaned answers by token."""
    clean = SV.clean_responses(T.raw_survey(spark, sf), NO_CUTOFF)
    return P.peek(clean, 5, ["token"]).select("token", F.array_join("motivation", "|").alias("motivation"))


_HUES = {"information depth": "information_depth", "prior knowledge": "prior_knowledge", "single motivation": _SINGLE}


def _temporal_sql() -> str:
    buckets = {
        "local_day_type": ("CASE WHEN isodow(local_dt) > 5 THEN 1 ELSE 0 END", list(_HUES), "true"),
        "local_day_of_week": ("isodow(local_dt) - 1", ["single motivation"], "true"),
        "local_hour_of_day_div4": ("floor(hour(local_dt) / 4) * 4", list(_HUES), "isodow(local_dt) <= 5"),
    }
    arms = [
        f"SELECT '{hue} by {name}' AS part, cast({expr} AS INTEGER) AS bucket, {_HUES[hue]} AS answer FROM local WHERE {where}"
        for name, (expr, hues, where) in buckets.items()
        for hue in hues
    ]
    return (
        RWT_CTES
        + f""", local AS (SELECT *, click_ts AT TIME ZONE 'UTC' AT TIME ZONE timezone AS local_dt FROM rwt WHERE timezone IN ({ZONES})),
long AS ({" UNION ALL ".join(arms)}),
cnt0 AS (SELECT part, bucket, answer, count(*) AS count FROM long WHERE answer IS NOT NULL GROUP BY ALL),
cnt AS (SELECT *, sum(count) OVER (PARTITION BY part, bucket) AS n FROM cnt0),
"""
        + beta_interval_ctes("cnt", "count", "n")
        + """SELECT part, bucket, answer, count, cast(n AS BIGINT) AS n, round(count / n, 6) AS proportion,
       round(lower, 6) AS lower, round(upper, 6) AS upper
FROM cnt JOIN beta_q ON beta_q._k = cnt.count AND beta_q._nn = cnt.n"""
    )


@register("temporal_report", _temporal_sql())
def temporal_report(spark, sf):
    """Answers by local day type, weekday and 4-hour bucket, with intervals."""
    t = P.temporal_report(survey_stages(spark, sf).responses, TM.known_zones(spark))
    return t.select(
        "part", "bucket", "answer", "count", F.col("n").cast("bigint").alias("n"),
        *[F.round(c, 6).alias(c) for c in ("proportion", "lower", "upper")],
    )
