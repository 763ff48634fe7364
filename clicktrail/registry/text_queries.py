"""Queries over the text trace format and keyed pseudonyms (X2: S7-S9, F2-F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clicktrail.functions import textparse as TP
from clicktrail.functions.privacy import hmac_sha1, hmac_sha1_sql
from clicktrail.registry import register
from clicktrail.registry.trace_queries import TRACES, day_traces
from clicktrail.sources import io as IO
from clicktrail.sources import tables as T
from clicktrail.sources.adapters import duckdb_with

KEY = "clicktrail pseudonym key"
LONG_KEY = "k" * 100  # longer than one SHA-1 block: hashed before use


@register(
    "hash_ips",
    duckdb_with("request_log")
    + f"SELECT DISTINCT client_ip AS ip, {hmac_sha1_sql('client_ip', KEY)} AS hashed,"
    f" {hmac_sha1_sql('client_ip', LONG_KEY)} AS hashed_long FROM request_log",
)
def hash_ips(spark, sf):
    ips = T.flat_request_log(spark, sf).select(F.col("client_ip").alias("ip")).distinct()
    return ips.select("ip", hmac_sha1(F.col("ip"), KEY).alias("hashed"), hmac_sha1(F.col("ip"), LONG_KEY).alias("hashed_long"))


_DAY_REQ_GROUPS = "d.client_ip, d.user_agent, d.timezone, d.country, d.browser_family, d.uri_host, d.year, d.month, d.day"


@register(
    "trace_text_roundtrip",
    TRACES
    + f"""SELECT d.client_ip AS ip, d.user_agent AS ua, d.timezone, count(*) AS n_requests,
       string_agg(d.title, ',' ORDER BY d.ts) AS titles, min(epoch_us(d.ts)) AS first_us
FROM day_reqs d GROUP BY {_DAY_REQ_GROUPS}""",
)
def trace_text_roundtrip(spark, sf):
    """Per-day traces written as text lines and parsed back; traces without requests fall out."""
    parsed = TP.parse_trace_lines(TP.trace_lines(day_traces(spark, sf)))
    return parsed.select(
        "ip", "ua", F.col("geo_data")["timezone"].alias("timezone"),
        F.size("requests").cast("bigint").alias("n_requests"),
        F.array_join(F.transform("requests", lambda r: r["title"]), ",").alias("titles"),
        F.unix_micros(F.col("requests")[0]["ts"]).alias("first_us"),
    )


@register(
    "hashed_traces",
    TRACES
    + f"""SELECT {hmac_sha1_sql('d.client_ip', KEY)} AS ip, d.user_agent AS ua, count(*) AS n_requests,
       min(epoch_us(d.ts)) AS first_us
FROM day_reqs d GROUP BY {_DAY_REQ_GROUPS}""",
)
def hashed_traces(spark, sf):
    """Text -> parse (S7, F2, F3) -> HMAC of the ip (F5) -> JSON lines (S8) -> typed read."""
    parsed = TP.parse_trace_lines(TP.trace_lines(day_traces(spark, sf)))
    hashed = parsed.withColumn("ip", hmac_sha1(F.col("ip"), KEY))
    lines = hashed.select(F.to_json(F.struct(*IO.TRACE_SCHEMA.fieldNames()), IO.JSON_OPTIONS).alias("value"))
    back = lines.select(F.from_json("value", IO.TRACE_SCHEMA, IO.JSON_OPTIONS).alias("t")).select("t.*")
    back = back.where(F.col("ip").isNotNull() & F.col("ua").isNotNull() & F.col("requests").isNotNull())
    return back.select(
        "ip", "ua", F.size("requests").cast("bigint").alias("n_requests"),
        F.unix_micros(F.col("requests")[0]["ts"]).alias("first_us"),
    )


@register(
    "legacy_requests",
    TRACES
    + f"""SELECT d.client_ip AS ip, count(*) AS n_requests,
       min(strftime(d.ts, '%Y-%m-%d %H:%M:%S.%f')) AS first_t, arg_min(d.title, d.ts) AS first_p
FROM day_reqs d GROUP BY {_DAY_REQ_GROUPS}""",
)
def legacy_requests(spark, sf):
    """per-day traces in the legacy layout ('t|r|p' triples joined by '||' in the fourth field), parsed back."""
    t = day_traces(spark, sf).where(F.size("requests") > 0)
    triple = lambda r: F.concat_ws(
        "|", F.date_format(r["ts"], "yyyy-MM-dd HH:mm:ss.SSSSSS"), r["referer"], r["title"]
    )
    lines = t.select(
        F.concat_ws(
            "\t", "ip", "ua", F.lit("-"), F.array_join(F.transform("requests", triple), "||"),
            TP.map_text(F.col("geocoded_data")),
        ).alias("value")
    )
    parsed = TP.parse_legacy_lines(lines)
    return parsed.select(
        "ip", F.size("requests").cast("bigint").alias("n_requests"),
        F.col("requests")[0]["t"].alias("first_t"), F.col("requests")[0]["p"].alias("first_p"),
    )
