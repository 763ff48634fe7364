"""Queries that write tables to the shared work folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from clicktrail.functions import textparse as TP
from clicktrail.functions.privacy import hmac_sha1, hmac_sha1_sql
from clicktrail.operators import clicks as C
from clicktrail.operators import requests as R
from clicktrail.operators import survey as SV
from clicktrail.plans import jobs as P
from clicktrail.registry import register
from clicktrail.registry.sqlbits import CLICKS, survey_ctes
from clicktrail.registry.text_queries import KEY, _DAY_REQ_GROUPS
from clicktrail.registry.trace_queries import ALL, NO_CUTOFF, TRACES, click_stages, day_traces, merged_traces
from clicktrail.sources import adapters as A
from clicktrail.sources import io as IO
from clicktrail.sources import tables as T
from clicktrail.sources.adapters import duckdb_with
from clicktrail.sources.work import work_folder

SPAN = ("2024-01-03", "2024-01-09")
IN_SPAN = f"make_date(year, month, day) BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}'"


@register(
    "request_files",
    duckdb_with("request_log", "redirects")
    + f"""SELECT 'span' AS part, day, count(*) AS n FROM request_log WHERE {IN_SPAN} GROUP BY ALL
UNION ALL SELECT 'snapshot', day, count(*) FROM request_log WHERE day IN (3, 5) GROUP BY ALL
UNION ALL SELECT 'redirects', NULL, count(*) FROM redirects""",
)
def request_files(spark, sf):
    """S1 (P2), S2, S3: the request log written by day, a span and a snapshot of it read back, the redirect table."""
    folder = work_folder(spark, "requests")
    T.request_log(spark, sf).write.partitionBy("year", "month", "day").parquet(f"{folder}/log")
    log = IO.read_requests(spark, f"{folder}/log")
    IO.snapshot_requests(log, [3, 5], f"{folder}/snapshot")
    T.redirects(spark, sf).write.parquet(f"{folder}/redirects")
    n = F.count(F.lit(1)).alias("n")
    days = lambda df, part: df.groupBy(F.lit(part).alias("part"), F.col("day").cast("int").alias("day")).agg(n)
    span = days(IO.read_requests(spark, f"{folder}/log", *SPAN), "span")
    redirects = IO.read_redirects(spark, f"{folder}/redirects").agg(n)
    return span.unionByName(days(IO.read_requests(spark, f"{folder}/snapshot"), "snapshot")).unionByName(
        redirects.select(F.lit("redirects").alias("part"), F.lit(None).cast("int").alias("day"), "n")
    )


@register(
    "trace_files",
    TRACES
    + f"""SELECT host, day, count(*) AS n_traces, cast(sum(k) AS BIGINT) AS n_requests FROM (
  SELECT g.uri_host AS host, g.day, count(d.ts) AS k FROM day_groups g LEFT JOIN day_reqs d
    USING (client_ip, user_agent, timezone, country, browser_family, uri_host, year, month, day)
  WHERE make_date(g.year, g.month, g.day) BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}'
    AND NOT (g.day = 5 AND g.uri_host = '{A.MOBILE_HOST}')
  GROUP BY g.client_ip, g.user_agent, g.timezone, g.country, g.browser_family, g.uri_host, g.year, g.month, g.day)
GROUP BY ALL""",
)
def trace_files(spark, sf):
    """The per-day trace table; day 5 is rebuilt without its mobile traffic, so that partition goes."""
    path = f"{work_folder(spark, 'traces')}/by_day"
    IO.write_traces(day_traces(spark, sf), path)
    log = T.request_log(spark, sf).where(f"day = 5 and uri_host = '{A.DESKTOP_HOST}'")
    IO.overwrite_day(P.build_trace_table(log, T.redirects(spark, sf)), path, [(2024, 1, 5)])
    return IO.read_span(spark, path, *SPAN).groupBy("host", F.col("day").cast("int").alias("day")).agg(
        F.count(F.lit(1)).alias("n_traces"), F.sum(F.size("requests")).alias("n_requests")
    )


@register(
    "trace_partition",
    TRACES + f"SELECT client_ip AS ip, user_agent AS ua, timezone FROM day_groups WHERE day = 4 AND uri_host = '{A.DESKTOP_HOST}'",
)
def trace_partition(spark, sf):
    """One (day, host) partition of the written table."""
    path = f"{work_folder(spark, 'traces')}/by_day"
    IO.write_traces(day_traces(spark, sf), path)
    one = IO.read_partition(spark, path, "2024-01-04", A.DESKTOP_HOST)
    return one.select("ip", "ua", F.col("geocoded_data")["timezone"].alias("timezone"))


@register("merged_files", TRACES + "SELECT count(*) AS written, count(*) AS read_back FROM merged")
def merged_files(spark, sf):
    """The merged trace table, written once, and the row counts of both sides."""
    path = f"{work_folder(spark, 'traces')}/merged"
    merged = merged_traces(spark, sf)
    IO.write_merged(merged, path)
    return IO.roundtrip_counts(merged, spark.read.parquet(path))


CHUNK = 3  # requests in a chunk: a third of a usual trace here, so that traces have several


@register(
    "merged_chunk_files",
    TRACES
    + f"""SELECT client_ip AS ip, user_agent AS ua, timezone, cast(id // {CHUNK} AS BIGINT) AS chunk, cast(id AS BIGINT) AS id,
       epoch_us(ts) AS ts_us, title, referer FROM reqs""",
)
def merged_chunk_files(spark, sf):
    """The merged trace table in chunks, written and read back, every request at its place."""
    path = f"{work_folder(spark, 'traces')}/merged"
    IO.write_merged_chunks(P.build_merged_chunks(T.request_log(spark, sf), T.redirects(spark, sf), CHUNK), path)
    back = R.unchunk_traces(spark.read.parquet(path), CHUNK)
    return back.select(
        "ip", "ua", F.col("geocoded_data")["timezone"].alias("timezone"), F.floor(F.col("id") / CHUNK).alias("chunk"), "id",
        F.unix_micros("ts").alias("ts_us"), "title", "referer",
    )


@register(
    "merged_content",
    TRACES
    + """SELECT client_ip AS ip, user_agent AS ua, timezone, count(*) AS n_requests, min(epoch_us(ts)) AS first_us,
       string_agg(title, ',' ORDER BY ts, referer, title) AS titles, string_agg(referer, ',' ORDER BY ts, referer, title) AS referers
FROM reqs GROUP BY client_ip, user_agent, timezone, country, browser_family""",
)
def merged_content(spark, sf):
    """What the nested merged table holds after it was written, trace by trace."""
    path = f"{work_folder(spark, 'traces')}/merged"
    IO.write_merged(merged_traces(spark, sf), path)
    listed = lambda name: F.array_join(F.transform("requests", lambda r: r[name]), ",")
    return spark.read.parquet(path).select(
        "ip", "ua", F.col("geocoded_data")["timezone"].alias("timezone"), F.size("requests").cast("bigint").alias("n_requests"),
        F.unix_micros(F.col("requests")[0]["ts"]).alias("first_us"), listed("title").alias("titles"), listed("referer").alias("referers"),
    )


@register(
    "hashed_files",
    TRACES
    + f"""SELECT {hmac_sha1_sql('d.client_ip', KEY)} AS ip, d.user_agent AS ua, count(*) AS n_requests,
       min(epoch_us(d.ts)) AS first_us, string_agg(d.title, ',' ORDER BY d.ts, d.referer, d.title) AS titles
FROM day_reqs d GROUP BY {_DAY_REQ_GROUPS}""",
)
def hashed_files(spark, sf):
    """X2 on files: trace text (S7), pseudonyms (F5), JSON lines out (S8) and typed back in."""
    folder = work_folder(spark, "hashed")
    IO.write_trace_text(day_traces(spark, sf), f"{folder}/text")
    parsed = IO.read_trace_text(spark, f"{folder}/text")
    IO.write_hashed(parsed.withColumn("ip", hmac_sha1(F.col("ip"), KEY)), f"{folder}/json")
    back = IO.read_hashed(spark, f"{folder}/json")
    return back.select(
        "ip", "ua", F.size("requests").cast("bigint").alias("n_requests"),
        F.unix_micros(F.col("requests")[0]["ts"]).alias("first_us"),
        F.array_join(F.transform("requests", lambda r: r["title"]), ",").alias("titles"),
    )


_RAW = ST.StructType(
    [ST.StructField(h, ST.StringType()) for h in (A.Q_TIMESTAMP, A.Q_DEPTH, A.Q_PRIOR, A.Q_MOTIVATION, A.Q_TOKEN)]
)


@register(
    "survey_files",
    duckdb_with("raw_survey", "responses_log") + survey_ctes(NO_CUTOFF)
    + "SELECT token, host, information_depth, prior_knowledge, motivation FROM survey_in_el",
)
def survey_files(spark, sf):
    """The event log and the form export read from files, then X8 + J4."""
    folder = work_folder(spark, "survey")
    IO.write_tsv(T.raw_survey(spark, sf), f"{folder}/answers")
    T.responses_log(spark, sf).write.parquet(f"{folder}/clicks")
    clicks = IO.read_event_log(spark, f"{folder}/clicks", T.responses_log(spark, sf).schema)
    s = P.survey_in_el(IO.read_survey_tsv(spark, f"{folder}/answers", _RAW), clicks, NO_CUTOFF)
    return s.select(
        "token", "host", F.col("information depth").alias("information_depth"),
        F.col("prior knowledge").alias("prior_knowledge"), F.array_join("motivation", "|").alias("motivation"),
    )


@register(
    "clean_survey_file",
    duckdb_with("raw_survey", "responses_log") + survey_ctes(NO_CUTOFF)
    + """SELECT token, epoch_us(submit_timestamp) AS submit_us, motivation AS motivation_text, len(motivation_list) AS n_motivations
FROM clean""",
)
def clean_survey_file(spark, sf):
    """Cleaned answers as TSV; the file holds ``a|b`` lists, and lists and timestamps come back typed."""
    path = f"{work_folder(spark, 'survey')}/clean"
    clean = SV.clean_responses(T.raw_survey(spark, sf), NO_CUTOFF)
    IO.write_tsv(clean, path)
    text = spark.read.option("sep", "\t").option("header", True).csv(path).select(F.col("token").alias("t"), F.col("motivation").alias("motivation_text"))
    back = IO.load_tsv_nested(spark, path, clean.schema)
    return back.join(text, F.col("token") == F.col("t")).select(
        "token", F.unix_micros("submit_timestamp").alias("submit_us"), "motivation_text",
        F.size("motivation").cast("bigint").alias("n_motivations"),
    )


@register(
    "click_trace_files",
    ALL + "," + CLICKS + "SELECT key, survey_token, click_title, epoch_us(click_ts) AS click_us, n_requests, timezone, titles"
    " FROM pairs JOIN merged USING (client_ip, user_agent, timezone, country, browser_family, key, n_requests)",
)
def click_trace_files(spark, sf):
    """The nested click traces as JSON lines, written by the executors and read back."""
    st = click_stages(spark, sf)
    path = f"{work_folder(spark, 'click-traces')}/json"
    IO.write_click_traces(C.nest_click_traces(C.join_traces_clicks(st.rows, st.clicks)), path)
    return IO.read_click_traces(spark, path).select(
        "key", F.col("click_data.survey_token").alias("survey_token"), F.col("click_data.title").alias("click_title"),
        F.unix_micros("click_data.timestamp").alias("click_us"), F.size("requests").cast("bigint").alias("n_requests"),
        F.col("geo_data")["timezone"].alias("timezone"),
        F.array_join(F.transform("requests", lambda r: r["title"]), ",").alias("titles"),
    )


@register(
    "trace_sample_file",
    TRACES
    + f"""SELECT d.timezone, count(*) AS n_traces, cast(sum(k) AS BIGINT) AS n_requests FROM (
  SELECT d.timezone, count(*) AS k FROM day_reqs d GROUP BY {_DAY_REQ_GROUPS}) d GROUP BY ALL""",
)
def trace_sample_file(spark, sf):
    """A trace sample from JSON lines; requests with an unreadable time and empty traces are dropped."""
    path = f"{work_folder(spark, 'sample')}/json"
    bad = F.array(F.named_struct(*[x for f in TP.REQUEST_TYPE.fields for x in (F.lit(f.name), F.lit(None).cast(f.dataType))]))
    traces = day_traces(spark, sf).select(
        "ip", "ua", F.col("geocoded_data").alias("geo_data"), F.col("user_agent_map").alias("ua_data"),
        F.concat("requests", bad).alias("requests"),
    )
    IO.write_hashed(traces, path)
    sample = IO.load_sample(IO.read_hashed(spark, path))
    return sample.groupBy(F.col("geo_data")["timezone"].alias("timezone")).agg(
        F.count(F.lit(1)).alias("n_traces"), F.sum(F.size("trace_data")).alias("n_requests")
    )
