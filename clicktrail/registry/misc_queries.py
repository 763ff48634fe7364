"""Remaining checks: coverage (A32), unrecoded answers (O4), nested sessions (T1), intended ambiguity (T3),
answer levels (F25, P23), day range (S18), partition names (F23) and URL keys (F1, F19, F20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clicktrail.functions import recode as RC
from clicktrail.functions.keys import partition_name
from clicktrail.functions.urls import page_key, referer_key, referer_path, referer_query, url_decode
from clicktrail.operators import clicks as C
from clicktrail.operators import requests as R
from clicktrail.operators import sessions as SS
from clicktrail.operators import stats as ST
from clicktrail.operators import survey as SV
from clicktrail.operators import trees as TR
from clicktrail.plans import jobs as P
from clicktrail.registry import register
from clicktrail.registry import sqlbits as SB
from clicktrail.registry.trace_queries import NO_CUTOFF, RWT_CTES, survey_stages
from clicktrail.registry.trees import GROUP, session_pages
from clicktrail.sources import io as IO
from clicktrail.sources import tables as T
from clicktrail.sources.adapters import duckdb_with

GAP_MINUTES = 1440
GAP_US = GAP_MINUTES * 60_000_000


@register(
    "coverage_report",
    RWT_CTES
    + """SELECT 'clicks' AS stage, count(*) AS n FROM clicks
UNION ALL SELECT 'click_traces', count(*) FROM pairs
UNION ALL SELECT 'survey', count(*) FROM clean
UNION ALL SELECT 'survey_in_el', count(*) FROM survey_in_el
UNION ALL SELECT 'responses', count(*) FROM rwt""",
)
def coverage_report(spark, sf):
    """Rows at each stage of the click and survey joins."""
    st = survey_stages(spark, sf)  # every stage is written once; the counts read the written tables
    return C.coverage(
        {
            "clicks": st.clicks,
            "click_traces": st.click_hits,
            "survey": st.survey,
            "survey_in_el": st.survey_in_el,
            "responses": st.responses,
        }
    )


@register(
    "unrecoded_examples",
    duckdb_with("raw_survey", "responses_log")
    + SB.survey_ctes(NO_CUTOFF)
    + "SELECT token, raw_motivation FROM clean WHERE motivation = 'other' ORDER BY token LIMIT 10",
)
def unrecoded_examples(spark, sf):
    """The first ten answers whose motivation could not be recoded (a top-k listing by token)."""
    c = SV.clean_responses(T.raw_survey(spark, sf), NO_CUTOFF)
    return c.where(F.array_join("motivation", "|") == "other").orderBy("token").limit(10).select("token", "raw_motivation")


@register(
    "sessions_nested",
    duckdb_with("request_log")
    + f", traffic AS ({SB.TRAFFIC}), "
    + SB.sessionized("traffic", GAP_US)
    + """SELECT client_ip, user_agent, session_id, count(*) AS n_requests,
       string_agg(cast(req_id AS VARCHAR), ',' ORDER BY ts, req_id) AS req_ids
FROM sessionized GROUP BY ALL""",
)
def sessions_nested(spark, sf):
    """Per client and session, the array of its requests."""
    log = R.filter_traffic(T.request_log(spark, sf))
    n = SS.session_arrays(log, ["client_ip", "user_agent"], ["ts", "req_id"], gap_minutes=GAP_MINUTES)
    return n.select(
        "client_ip", "user_agent", "session_id", F.size("session").cast("bigint").alias("n_requests"),
        F.array_join(F.transform("session", lambda r: r["req_id"].cast("string")), ",").alias("req_ids"),
    )


@register(
    "ambiguous_parents",
    SB.forest_ctes(GAP_US)
    + """, seen AS (
  SELECT v.node, count(*) AS n_seen FROM keyed v JOIN keyed p
    ON p.client_ip = v.client_ip AND p.user_agent = v.user_agent AND p.session_id = v.session_id
   AND p.page_key = v.referer_key AND (p.us < v.us OR (p.us = v.us AND p.node < v.node))
  GROUP BY v.node)
SELECT n.root, cast(max(CASE WHEN s.n_seen > 1 THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous_max,
       cast(sum(CASE WHEN s.n_seen > 1 THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous_sum
FROM nodes n LEFT JOIN seen s USING (node) GROUP BY n.root""",
)
def ambiguous_parents(spark, sf):
    """T3 + T18/T19 as intended: a node is ambiguous when its referer page was viewed more than once before."""
    f = TR.build_forest(session_pages(spark, sf), GROUP, ambiguity="intended")
    m = TR.tree_metrics(f, GROUP, with_dfsness=False)
    return m.select("root", "ambiguous_max", "ambiguous_sum")


_APP = {
    "Information_Need": "information_depth",
    "Prior_Knowledge": "prior_knowledge",
    "Motivation": "motivation",
}


def _level_sql(col: str, src: str) -> str:
    lv = ", ".join(f"'{v}'" for v in RC.APP_LEVELS[col])
    return f"CASE WHEN {src} IN ({lv}) THEN {src} END"


@register(
    "answer_levels",
    duckdb_with("raw_survey", "responses_log")
    + SB.survey_ctes(NO_CUTOFF)
    + ", app AS (SELECT "
    + ", ".join(f"{_level_sql(k, v)} AS {k}" for k, v in _APP.items())
    + " FROM clean), cond AS (SELECT * FROM app WHERE Prior_Knowledge = 'familiar')\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{k}' AS question, {k} AS answer, count(*) AS count FROM cond GROUP BY {k}" for k in _APP
    ),
)
def answer_levels(spark, sf):
    """F25 + P23 + A30: coded answers as ordered levels (values off the list -> NULL), conditioned on
    prior knowledge 'familiar' ('any' for the others), counted per question."""
    c = SV.clean_responses(T.raw_survey(spark, sf), NO_CUTOFF).select(
        F.col("`information depth`").alias("Information_Need"),
        F.col("`prior knowledge`").alias("Prior_Knowledge"),
        F.array_join("motivation", "|").alias("Motivation"),
    )
    for col, levels in RC.APP_LEVELS.items():
        c = RC.with_levels(c, col, levels)
    c = SV.condition_on(c, Information_Need="any", Prior_Knowledge="familiar", Motivation="any")
    return ST.answer_counts(c, list(_APP))


@register(
    "day_range",
    "SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM events),"
    " generate_series(a, b, INTERVAL 1 DAY) g(d)",
)
def day_range(spark, sf):
    """Every day from the first to the last event, inclusive."""
    a, b = T.table(spark, sf, "events").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    return IO.day_range(spark, a.isoformat(), b.isoformat()).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@register(
    "partition_names",
    duckdb_with("request_log")
    + f", traffic AS ({SB.TRAFFIC})\n"
    + "SELECT DISTINCT 'year=' || year || '/month=' || month || '/day=' || day || '/host=' || uri_host AS partition"
    " FROM traffic",
)
def partition_names(spark, sf):
    """partition path of every (day, host) of the traced traffic."""
    log = R.filter_traffic(T.request_log(spark, sf))
    d = log.select(F.make_date("year", "month", "day").alias("d"), "uri_host").distinct()
    return d.select(partition_name(F.col("d"), F.col("uri_host")).alias("partition"))


@register(
    "url_keys",
    f"""SELECT page_id, {SB.referer_key('url')} AS referer_key,
       {SB.page_key(SB.referer_path('url'), SB.referer_query('url'))} AS page_key,
       url_decode(replace(url, '+', ' ')) AS decoded
FROM pages""",
)
def url_keys(spark, sf):
    """F1 + F19 + F20 on real page URLs (query strings, fragments)."""
    p = T.table(spark, sf, "pages").select("page_id", "url")
    u = F.col("url")
    return p.select(
        "page_id", referer_key(u).alias("referer_key"),
        page_key(referer_path(u), referer_query(u)).alias("page_key"), url_decode(u).alias("decoded"),
    )


@register(
    "trace_span",
    duckdb_with("request_log", "redirects")
    + SB.trace_ctes()
    + """SELECT client_ip AS ip, user_agent AS ua, year, month, day, uri_host AS host FROM day_groups
WHERE make_date(year, month, day) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'""",
)
def trace_span(spark, sf):
    """S11 + U1 over the per-day traces: all (day, host) partitions in a span, as one DataFrame."""
    t = P.build_trace_table(T.request_log(spark, sf), T.redirects(spark, sf))
    return t.where(IO.day_span("2024-01-03", "2024-01-09")).select("ip", "ua", "year", "month", "day", "host")
