"""Queries over the sessions and trees of survey responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from clicktrail.operators import sessions as SS
from clicktrail.operators import trees as TR
from clicktrail.plans import jobs as P
from clicktrail.registry import register
from clicktrail.registry.duck_random import poisson1, uniform
from clicktrail.registry.sqlbits import forest_sql, page_key, referer_key, sessionized, tree_metric_sql
from clicktrail.registry.trace_queries import RWT_CTES, all_rows, survey_stages

GAP_MINUTES = 1440  # driver data: hours between a user's events
GAP_US = GAP_MINUTES * 60_000_000
SEED = "sample"
BOOT = 1000
IDENT = "client_ip, user_agent, timezone, country, browser_family"
_PER = ["survey_token", "session_id"]

_BASE = RWT_CTES.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
tr AS (
  SELECT w.survey_token, r.id, r.ts, r.referer, r.uri_path, r.uri_query, r.is_pageview, r.referer_class,
         r.access_method
  FROM rwt w JOIN reqs r USING ({IDENT})),
{sessionized("tr", GAP_US, "trs", key="survey_token", order="ts, id")},
hit AS (SELECT t.survey_token, t.session_id FROM trs t JOIN rwt w
        ON w.survey_token = t.survey_token AND t.id = w.click_request_id),
srows AS (SELECT t.* FROM trs t SEMI JOIN hit USING (survey_token, session_id)),
click_summary AS (
  SELECT survey_token, count(*) AS n_requests, count(*) FILTER (WHERE is_pageview) AS num_pageviews,
         CASE WHEN count(*) < 2 THEN 0.0
              ELSE (floor(max(us) / 1000000) - floor(min(us) / 1000000)) / 60.0 END AS session_length,
         count(*) FILTER (WHERE referer_class = 'external (search engine)') AS external_searches,
         coalesce(arg_min(access_method, struct_pack(u := us, i := id)), 'unknown') AS host
  FROM srows GROUP BY survey_token),
keyed AS (
  SELECT survey_token, session_id, id AS node, us, {page_key()} AS page_key, {referer_key()} AS referer_key
  FROM srows),
{forest_sql("keyed", _PER, "ct")},
{tree_metric_sql("ct", _PER)},
click_root AS (
  SELECT n.survey_token, n.session_id, n.root FROM ct_nodes n JOIN rwt w
    ON w.survey_token = n.survey_token AND n.node = w.click_request_id),
click_metrics AS (SELECT m.* FROM ct_metrics m JOIN click_root c USING (survey_token, session_id, root))
"""


@register("click_session_metrics", _BASE + "SELECT * FROM click_summary")
def click_session_metrics(spark, sf):
    """X5 + T4-T6: the session holding each response's click request."""
    st = survey_stages(spark, sf)
    rows, _ = P.sessions_and_trees(st.responses, st.rows, gap_minutes=GAP_MINUTES, trees=False)
    return SS.session_summary(rows, ["survey_token"])


@register(
    "click_tree_metrics",
    _BASE + "SELECT survey_token, size, num_leafs, mean_time_diff, degree_max, depth_max FROM click_metrics",
)
def click_tree_metrics(spark, sf):
    """X5 + J9 + T22: metrics of the referer tree holding each response's click request."""
    st = survey_stages(spark, sf)
    _, tree = P.sessions_and_trees(st.responses, st.rows, gap_minutes=GAP_MINUTES)
    m = TR.tree_metrics(tree, _PER, node="id", with_dfsness=False)
    return m.select("survey_token", "size", "num_leafs", "mean_time_diff", "degree_max", "depth_max")


_DIMS = {
    "response_host": "r.host",
    "information depth": "information_depth",
    "prior knowledge": "prior_knowledge",
    "single motivation": "CASE WHEN len(string_split(motivation, '|')) = 1 THEN motivation END",
}


def _report_sql() -> str:
    arms = []
    for metric in (*P.SESSION_METRICS, *P.TREE_METRICS):
        for name, expr in _DIMS.items():
            arms.append(
                f"SELECT '{metric}' AS metric, '{name}' AS dimension, v AS value, count(*) AS n, round(avg(y), 6) AS mean,"
                f" round(median(y), 6) AS median FROM (SELECT {expr} AS v, cast({metric} AS DOUBLE) AS y FROM rwt r"
                " JOIN click_summary c USING (survey_token) JOIN click_metrics m USING (survey_token))"
                " WHERE v IS NOT NULL AND v <> 'no response' GROUP BY v"
            )
    return _BASE + "\nUNION ALL\n".join(arms)


@register("metric_report", _report_sql())
def metric_report(spark, sf):
    """X6 + A28: eight metrics of the click session and the click tree, broken down by host and each answer."""
    st = survey_stages(spark, sf)
    m = P.metric_report(st.responses, st.rows, gap_minutes=GAP_MINUTES)
    return m.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


_IDENT_LIST = IDENT.split(", ")
_W = poisson1(uniform("'boot/' || unit || '/' || cast(b AS VARCHAR)"))


@register(
    "click_vs_sample",
    _BASE
    + f""",
st AS (SELECT {IDENT}, id, ts, is_pageview, referer_class, access_method, uri_path, uri_query, referer FROM reqs),
{sessionized("st", GAP_US, "sts", key=IDENT, order="ts, id")},
pick AS (
  SELECT * FROM (SELECT DISTINCT {IDENT}, session_id FROM sts)
  QUALIFY row_number() OVER (PARTITION BY {IDENT}
                             ORDER BY md5(cast(session_id AS VARCHAR) || '{SEED}'), session_id) = 1),
srs AS (SELECT s.* FROM sts s SEMI JOIN pick USING ({IDENT}, session_id)),
skeyed AS (
  SELECT {IDENT}, session_id, id AS node, us, {page_key()} AS page_key, {referer_key()} AS referer_key FROM srs),
{forest_sql("skeyed", [*_IDENT_LIST, "session_id"], "sf")},
stree AS (
  SELECT {IDENT}, count(*) AS tree_size FROM sf_nodes SEMI JOIN (
    SELECT * FROM (SELECT DISTINCT {IDENT}, root FROM sf_nodes)
    QUALIFY row_number() OVER (PARTITION BY {IDENT} ORDER BY md5(cast(root AS VARCHAR) || '{SEED}'), root) = 1) p
  USING ({IDENT}, root) GROUP BY {IDENT}),
samp AS (
  SELECT {IDENT}, count(*) FILTER (WHERE is_pageview) AS num_pageviews,
         CASE WHEN count(*) < 2 THEN 0.0
              ELSE (floor(max(us) / 1000000) - floor(min(us) / 1000000)) / 60.0 END AS session_length,
         coalesce(arg_min(access_method, struct_pack(u := us, i := id)), 'unknown') AS host
  FROM srs GROUP BY {IDENT}),
labelled AS (
  SELECT client_ip || chr(9) || user_agent AS unit, num_pageviews, session_length, tree_size, host, 'sample' AS condition
  FROM samp JOIN stree USING ({IDENT})
  UNION ALL
  SELECT survey_token, num_pageviews, session_length, size, host, 'click'
  FROM click_summary JOIN click_metrics USING (survey_token)),
long AS (
  SELECT unit, host, condition, metric, y FROM (
    SELECT unit, host, condition, cast(num_pageviews AS DOUBLE) AS num_pageviews,
           cast(session_length AS DOUBLE) AS session_length, cast(tree_size AS DOUBLE) AS tree_size
    FROM labelled WHERE host <> 'unknown')
  UNPIVOT (y FOR metric IN (num_pageviews, session_length, tree_size))),
reps AS (
  SELECT metric, host, condition, b, sum(w * y) / sum(w) AS m FROM (
    SELECT *, {_W} AS w FROM long, range(1, {BOOT} + 1) r(b))
  GROUP BY ALL HAVING sum(w) > 0),
ci AS (SELECT metric, host, condition, quantile_cont(m, [0.025, 0.975]) AS q FROM reps GROUP BY ALL),
means AS (SELECT metric, host, condition, avg(y) AS mean, count(*) AS n FROM long GROUP BY ALL)
SELECT metric, host, condition, round(mean, 4) AS mean, n, round(q[1], 4) AS ci_lower, round(q[2], 4) AS ci_upper
FROM means JOIN ci USING (metric, host, condition)""",
)
def click_vs_sample(spark, sf):
    """X7 + A29 + A24: page views, length and tree size of click sessions against one random session (and tree) of every trace."""
    st = survey_stages(spark, sf)
    df = P.click_vs_sample(st.responses, st.rows, all_rows(spark, sf), gap_minutes=GAP_MINUTES, seed=SEED)
    out = P.compare_conditions(df, ["num_pageviews", "session_length", "tree_size"], boot=BOOT)
    return out.select(
        "metric", "host", "condition", F.round("mean", 4).alias("mean"), "n",
        F.round("ci_lower", 4).alias("ci_lower"), F.round("ci_upper", 4).alias("ci_upper"),
    )
