"""Queries over referer forests: J8 + T2 (build_forest) and T7-T22 (tree_metrics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clicktrail.functions.urls import page_key, referer_key
from clicktrail.operators import requests as R
from clicktrail.operators import sessions as S
from clicktrail.operators import trees as TR
from clicktrail.registry import register
from clicktrail.registry.sqlbits import forest_ctes
from clicktrail.sources import tables as T

GAP_MINUTES = 1440
GAP_US = GAP_MINUTES * 60_000_000
GROUP = ("client_ip", "user_agent", "session_id")


def session_pages(spark, sf_dir, unit=None):
    """Page views of human traffic, split into sessions, with page and referer keys; node = request id. ``unit``: times are cut to it."""
    log = R.filter_traffic(T.request_log(spark, sf_dir)).where(F.col("is_pageview"))
    if unit:
        log = log.withColumn("ts", F.date_trunc(unit, "ts"))
    s = S.sessionize(log, gap_minutes=GAP_MINUTES)
    return s.select(
        "client_ip", "user_agent", "session_id", F.col("req_id").alias("node"), "ts",
        page_key(F.col("uri_path"), F.col("uri_query")).alias("page_key"),
        referer_key(F.col("referer")).alias("referer_key"),
        "access_method", "referer_class", "is_pageview",
    )


def forest(spark, sf_dir, path=False, unit=None):
    pages = session_pages(spark, sf_dir, unit).drop("access_method", "referer_class", "is_pageview")
    return TR.build_forest(pages, GROUP, path=path, drop=("page_key", "referer_key"))


@register(
    "build_forest",
    forest_ctes(GAP_US)
    + "SELECT node, parent, root, cast(depth AS INTEGER) AS depth, path, session_id FROM nodes",
)
def build_forest(spark, sf_dir):
    f = forest(spark, sf_dir, path=True)
    return f.select(
        "node", "parent", "root", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"),
        "session_id",
    )


TREE_METRICS_SQL = forest_ctes(GAP_US) + """,
clo AS (
  SELECT node AS anc, node AS des, 0 AS dist FROM edges
  UNION ALL
  SELECT c.anc, e.node, c.dist + 1 FROM clo c JOIN edges e ON e.parent = c.des),
st AS (
  SELECT anc AS node, count(*) AS subtree, max(dist) AS height, count(*) FILTER (WHERE dist = 1) AS n_children
  FROM clo GROUP BY anc),
n AS (
  SELECT nodes.*, st.subtree, st.height, st.n_children, us - parent_us AS dt
  FROM nodes JOIN st USING (node)),
grp AS (
  SELECT root, parent AS g, max(parent_us) AS open_us, max(us) AS close_us
  FROM n WHERE parent IS NOT NULL GROUP BY root, parent),
pos AS (
  SELECT v.node, v.root, count(*) AS k, count(*) FILTER (WHERE g.open_us < v.parent_us) AS rnk
  FROM n v JOIN grp g ON g.root = v.root AND g.open_us < v.us AND v.us <= g.close_us
  WHERE v.parent IS NOT NULL GROUP BY v.node, v.root),
dfs AS (
  SELECT root, avg(rnk / (k - 1.0)) FILTER (WHERE k > 1) AS dfsness FROM pos GROUP BY root)
SELECT n.root,
       count(*) AS size,
       cast(sum(depth + 1) AS BIGINT) AS size_sum,
       cast(sum(subtree * subtree) AS BIGINT) AS size_sq_sum,
       count(*) FILTER (WHERE n_children = 0) AS num_leafs,
       cast(max(depth) AS BIGINT) AS depth_max,
       cast(sum(height) AS BIGINT) AS depth_sum,
       cast(max(n_children) AS BIGINT) AS degree_max,
       count(dt) AS degree_sum,
       cast(coalesce(sum(dt), 0) AS DOUBLE) / 1e6 AS timediff_sum,
       cast(min(dt) FILTER (WHERE depth = 1) AS DOUBLE) / 1e6 AS timediff_min,
       cast(max(dt) FILTER (WHERE depth = 1) AS DOUBLE) / 1e6 AS timediff_max,
       cast(0 AS BIGINT) AS ambiguous_max,
       cast(0 AS BIGINT) AS ambiguous_sum,
       (cast(coalesce(sum(dt), 0) AS DOUBLE) / 1e6) / greatest(1, count(dt)) AS mean_time_diff,
       any_value(dfs.dfsness) AS dfsness
FROM n LEFT JOIN dfs USING (root)
GROUP BY n.root
"""


@register("tree_metrics", TREE_METRICS_SQL)
def tree_metrics(spark, sf_dir):
    return TR.tree_metrics(forest(spark, sf_dir), GROUP).drop(*GROUP)


TIED_SQL = forest_ctes(GAP_US, "cast(date_trunc('day', ts) AS TIMESTAMP)") + """,
chains AS (
  SELECT node, root, parent, us, 0 AS tie, [{'us': us, 'tie': 0}] AS chain, [node] AS ids FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT e.node, c.root, e.parent, e.us, t.tie, [{'us': e.us, 'tie': t.tie}] || c.chain, c.ids || [e.node]
  FROM chains c JOIN edges e ON e.parent = c.node, LATERAL (SELECT CASE WHEN e.us = c.us THEN c.tie + 1 ELSE 0 END AS tie) t),
visits AS (SELECT node, root, parent, row_number() OVER (PARTITION BY root ORDER BY us, tie, chain, ids) AS s, tie FROM chains),
grp AS (
  SELECT v.root, v.parent AS g, any_value(p.s) AS opened, max(v.s) AS closed
  FROM visits v JOIN visits p ON p.node = v.parent GROUP BY v.root, v.parent),
pos AS (
  SELECT v.node, v.root, count(*) AS k, count(*) FILTER (WHERE o.opened < own.opened) AS rnk
  FROM visits v JOIN grp own ON own.g = v.parent
  JOIN grp o ON o.root = v.root AND o.opened < v.s AND v.s <= o.closed
  GROUP BY v.node, v.root),
dfs AS (SELECT root, avg(rnk / (k - 1.0)) FILTER (WHERE k > 1) AS dfsness FROM pos GROUP BY root)
SELECT v.root, count(*) AS size, count(*) FILTER (WHERE v.tie > 0) AS tied, any_value(dfs.dfsness) AS dfsness
FROM visits v LEFT JOIN dfs USING (root) GROUP BY v.root
"""


@register("tied_visit_metrics", TIED_SQL)
def tied_visit_metrics(spark, sf_dir):
    """T21 where most times tie: page views of whole days, ordered by their parents and by the trace."""
    f = forest(spark, sf_dir, unit="day")
    m = TR.tree_metrics(f, GROUP, more={"tied": F.count_if(F.col("tie_level") > 0)})
    return m.select("root", "size", "tied", "dfsness")
