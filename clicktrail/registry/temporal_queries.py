"""Queries over client-local time (X10: F14-F18, A22, A23, P19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clicktrail.functions import temporal as TM
from clicktrail.operators import stats as ST
from clicktrail.registry import register
from clicktrail.registry.duck_random import beta_interval_ctes
from clicktrail.registry.sqlbits import TRAFFIC
from clicktrail.sources import tables as T
from clicktrail.sources.adapters import duckdb_with


# the valid zone names of the data, stated here on their own; the one other name is no zone
ZONES = "'America/New_York', 'Europe/Berlin', 'Asia/Tokyo', 'UTC', 'Japan'"


def _local_sql() -> str:
    return f"""local AS (
  SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE timezone AS local_dt FROM traffic
  WHERE timezone IN ({ZONES}))"""


def local_requests(spark, sf):
    from clicktrail.operators.requests import filter_traffic

    log = filter_traffic(T.request_log(spark, sf))
    return TM.with_local_time(log, "ts", F.col("geocoded_data")["timezone"], TM.known_zones(spark))


def _local_features_sql() -> str:
    return (
        duckdb_with("request_log")
        + f", traffic AS ({TRAFFIC}), {_local_sql()}\n"
        + """SELECT req_id, cast(hour(local_dt) AS INTEGER) AS local_hour_of_day,
       cast(floor(hour(local_dt) / 2) * 2 AS INTEGER) AS local_hour_of_day_div2,
       cast(floor(hour(local_dt) / 3) * 3 AS INTEGER) AS local_hour_of_day_div3,
       cast(floor(hour(local_dt) / 4) * 4 AS INTEGER) AS local_hour_of_day_div4,
       cast(floor(hour(local_dt) / 4) * 4 AS INTEGER) || '-' || cast(floor(hour(local_dt) / 4) * 4 + 4 AS INTEGER) AS div4_label,
       cast(isodow(local_dt) - 1 AS INTEGER) AS local_day_of_week, dayname(local_dt) AS day_name,
       CASE WHEN isodow(local_dt) - 1 > 4 THEN 1 ELSE 0 END AS local_day_type
FROM local"""
    )



@register("local_time_features", _local_features_sql())
def local_time_features(spark, sf):
    d = local_requests(spark, sf)
    return d.select(
        "req_id", "local_hour_of_day", "local_hour_of_day_div2", "local_hour_of_day_div3", "local_hour_of_day_div4",
        TM.hour_bucket_label(F.col("local_hour_of_day"), 4).alias("div4_label"), "local_day_of_week",
        TM.day_name(F.col("local_dt")).alias("day_name"), "local_day_type",
    )


def _over_time_sql() -> str:
    return (
        duckdb_with("request_log")
        + f", traffic AS ({TRAFFIC}), {_local_sql()},\n"
        + """wk AS (SELECT * FROM local WHERE isodow(local_dt) - 1 <= 4),
cnt0 AS (SELECT cast(floor(hour(local_dt) / 4) * 4 AS INTEGER) AS local_hour_of_day_div4, access_method,
                count(*) AS count FROM wk GROUP BY ALL),
cnt AS (SELECT *, sum(count) OVER (PARTITION BY local_hour_of_day_div4) AS n FROM cnt0),
"""
        + beta_interval_ctes("cnt", "count", "n")
        + """
SELECT local_hour_of_day_div4, access_method, count, cast(n AS BIGINT) AS n, round(count / n, 6) AS proportion,
       round(lower, 6) AS lower, round(upper, 6) AS upper
FROM cnt JOIN beta_q ON beta_q._k = cnt.count AND beta_q._nn = cnt.n"""
    )


@register("proportions_by_local_hour", _over_time_sql())
def proportions_by_local_hour(spark, sf):
    """Weekday requests (P19) per local 4-hour bucket: share of each access method with its interval."""
    d = local_requests(spark, sf).where(F.col("local_day_type") == 0)
    p = ST.proportions_over_time(d, "local_hour_of_day_div4", "access_method")
    return p.select(
        "local_hour_of_day_div4", "access_method", "count", F.col("n").cast("bigint").alias("n"),
        *[F.round(c, 6).alias(c) for c in ("proportion", "lower", "upper")],
    )
