"""DuckDB SQL fragments shared by oracle queries."""

from __future__ import annotations

from clicktrail.sources import adapters as A
from clicktrail.sources.adapters import duckdb_with

TRAFFIC = f"""
SELECT * FROM request_log
WHERE webrequest_source = 'text' AND agent_type = 'user' AND access_method <> 'mobile app'
  AND uri_host IN ('{A.DESKTOP_HOST}', '{A.MOBILE_HOST}')
"""


def join_path(path: str, part: str) -> str:
    """os.path.join of two components."""
    return (
        f"CASE WHEN {path} IS NULL OR {part} IS NULL THEN NULL "
        f"WHEN starts_with({part}, '/') THEN {part} "
        f"WHEN {path} = '' THEN {part} "
        f"WHEN ends_with({path}, '/') THEN {path} || {part} "
        f"ELSE {path} || '/' || {part} END"
    )


def referer_path(url: str) -> str:
    p = f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    return f"coalesce(regexp_replace({p}, ';[^/]*$', ''), '')"


def referer_query(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '\\?([^#]*)', 1), '')"


def page_key(path: str = "uri_path", query: str = "uri_query") -> str:
    return join_path(path, query)


def referer_key(url: str = "referer") -> str:
    return join_path(referer_path(url), referer_query(url))


def sessionized(
    source: str, gap_us: int, name: str = "sessionized", key: str = "client_ip, user_agent", order: str = "ts, req_id"
) -> str:
    """CTEs ``{name}_lag`` and ``{name}`` numbering gap sessions of ``source`` per ``key``."""
    return f"""
{name}_lag AS (
  SELECT *, epoch_us(ts) AS us,
         lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY {order}) AS prev_us
  FROM {source}),
{name} AS (
  SELECT *, cast(sum(CASE WHEN prev_us IS NULL OR us - prev_us > {gap_us} THEN 1 ELSE 0 END)
              OVER (PARTITION BY {key} ORDER BY {order}
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS session_id
  FROM {name}_lag)
"""


def forest_sql(src: str, group: list[str], p: str) -> str:
    """CTEs ``{p}_cand``, ``{p}_edges``, ``{p}_rec`` and ``{p}_nodes`` over ``src`` (columns: group...,
    node, us, page_key, referer_key). Needs WITH RECURSIVE."""
    on = " AND ".join(f"pp.{g} = v.{g}" for g in group)
    using = ", ".join(group)
    gsel = ", ".join(f"e.{g}" for g in group)
    return f"""
{p}_cand AS (
  SELECT {", ".join(f"v.{g}" for g in group)}, v.node,
         arg_max(pp.node, struct_pack(u := pp.us, n := pp.node)) AS parent, max(pp.us) AS parent_us
  FROM {src} v JOIN {src} pp
    ON {on} AND pp.page_key = v.referer_key AND (pp.us < v.us OR (pp.us = v.us AND pp.node < v.node))
  GROUP BY {", ".join(f"v.{g}" for g in group)}, v.node),
{p}_edges AS (SELECT k.*, c.parent, c.parent_us FROM {src} k LEFT JOIN {p}_cand c USING ({using}, node)),
{p}_rec AS (
  SELECT {using}, node, node AS root, 0 AS depth FROM {p}_edges WHERE parent IS NULL
  UNION ALL
  SELECT {gsel}, e.node, r.root, r.depth + 1
  FROM {p}_edges e JOIN {p}_rec r ON {" AND ".join(f"e.{g} = r.{g}" for g in group)} AND e.parent = r.node),
{p}_nodes AS (SELECT e.*, r.root, r.depth FROM {p}_edges e JOIN {p}_rec r USING ({using}, node))
"""


def tree_metric_sql(p: str, group: list[str]) -> str:
    """CTEs ``{p}_clo``, ``{p}_st``, ``{p}_n`` and ``{p}_metrics`` (size, num_leafs, degree_max, depth_max,
    mean_time_diff per group + root) over ``{p}_nodes`` / ``{p}_edges``."""
    using = ", ".join(group)
    return f"""
{p}_clo AS (
  SELECT {using}, node AS anc, node AS des, 0 AS dist FROM {p}_edges
  UNION ALL
  SELECT {", ".join(f"c.{g}" for g in group)}, c.anc, e.node, c.dist + 1
  FROM {p}_clo c JOIN {p}_edges e ON {" AND ".join(f"e.{g} = c.{g}" for g in group)} AND e.parent = c.des),
{p}_st AS (
  SELECT {using}, anc AS node, count(*) FILTER (WHERE dist = 1) AS n_children FROM {p}_clo GROUP BY {using}, anc),
{p}_n AS (SELECT x.*, s.n_children, us - parent_us AS dt FROM {p}_nodes x JOIN {p}_st s USING ({using}, node)),
{p}_metrics AS (
  SELECT {using}, root, count(*) AS size, count(*) FILTER (WHERE n_children = 0) AS num_leafs,
         cast(max(n_children) AS BIGINT) AS degree_max, cast(max(depth) AS BIGINT) AS depth_max,
         (cast(coalesce(sum(dt), 0) AS DOUBLE) / 1e6) / greatest(1, count(dt)) AS mean_time_diff
  FROM {p}_n GROUP BY {using}, root)
"""


def forest_ctes(gap_us: int, ts: str = "ts") -> str:
    """Page views of human traffic (their time taken as ``ts``) -> sessions -> referer parents -> root/depth/path (recursive)."""
    return (
        duckdb_with("request_log").replace("WITH ", "WITH RECURSIVE ", 1)
        + f", traffic AS ({TRAFFIC}), pv AS (SELECT * REPLACE ({ts} AS ts) FROM traffic WHERE is_pageview), "
        + sessionized("pv", gap_us)
        + f""",
keyed AS (
  SELECT client_ip, user_agent, session_id, req_id AS node, ts, epoch_us(ts) AS us,
         {page_key()} AS page_key, {referer_key()} AS referer_key
  FROM sessionized),
cand AS (
  SELECT v.node, arg_max(p.node, struct_pack(u := p.us, n := p.node)) AS parent, max(p.us) AS parent_us
  FROM keyed v JOIN keyed p
    ON p.client_ip = v.client_ip AND p.user_agent = v.user_agent AND p.session_id = v.session_id
   AND p.page_key = v.referer_key AND (p.us < v.us OR (p.us = v.us AND p.node < v.node))
  GROUP BY v.node),
edges AS (SELECT k.*, c.parent, c.parent_us FROM keyed k LEFT JOIN cand c USING (node)),
rec AS (
  SELECT node, node AS root, 0 AS depth, cast(node AS varchar) AS path FROM edges WHERE parent IS NULL
  UNION ALL
  SELECT e.node, r.root, r.depth + 1, r.path || '>' || cast(e.node AS varchar)
  FROM edges e JOIN rec r ON e.parent = r.node),
nodes AS (SELECT e.*, r.root, r.depth, r.path FROM edges e JOIN rec r USING (node))
"""
    )


def trace_ctes(cap: int | None = None) -> str:
    """CTEs after ``request_log, redirects``: traffic -> titles -> completeness -> day groups (under the cap, if one is
    given; ``day_groups``), their complete requests (``day_reqs``), merged client traces (``merged``) and the
    numbered requests of each merged trace (``reqs``)."""
    having = "" if cap is None else f"HAVING count(*) < {cap}"
    complete = " AND ".join(
        f"{c} IS NOT NULL"
        for c in (
            "ts", "referer", "title", "uri_path", "uri_query", "is_pageview", "access_method", "referer_class",
            "project_class", "project",
        )
    )
    grp = "client_ip, user_agent, timezone, country, browser_family"
    return f""",
traffic AS ({TRAFFIC}),
titled AS (
  SELECT t.*, CASE WHEN NOT t.is_pageview THEN NULL ELSE coalesce(r.rd_to, t.page_title) END AS title
  FROM traffic t LEFT JOIN redirects r ON (CASE WHEN t.is_pageview THEN t.page_title END) = r.rd_from),
packed AS (SELECT *, ({complete}) AS complete FROM titled),
day_groups AS (
  SELECT {grp}, uri_host, year, month, day FROM packed
  GROUP BY {grp}, uri_host, year, month, day {having}),
day_reqs AS (
  SELECT p.* FROM packed p SEMI JOIN day_groups g USING ({grp}, uri_host, year, month, day) WHERE p.complete),
merged AS (
  SELECT {grp}, client_ip || user_agent AS key, count(*) AS n_requests,
         string_agg(title, ',' ORDER BY ts, referer, title) AS titles
  FROM day_reqs GROUP BY {grp}),
reqs AS (
  SELECT {grp}, ts, title, referer, uri_path, uri_query, is_pageview, referer_class, access_method,
         row_number() OVER (PARTITION BY {grp} ORDER BY ts, referer, title) - 1 AS id
  FROM day_reqs)
"""


CLICKS = f"""
ev AS (
  SELECT s.webHost, p.page_title AS title, s.event_surveyInstanceToken AS survey_token, s.clientIp, s.userAgent,
         try_strptime(s.timestamp, '%Y%m%d%H%M%S') AS ts
  FROM responses_log s JOIN page p ON p.page_id = s.event_pageId
  WHERE s.event_surveyResponseValue = '{A.YES_BUTTON}'),
first_ev AS (
  SELECT *, row_number() OVER (PARTITION BY survey_token
             ORDER BY ts NULLS LAST, webHost NULLS LAST, title NULLS LAST, clientIp NULLS LAST,
                      userAgent NULLS LAST) AS rn
  FROM ev),
clicks AS (
  SELECT clientIp || substr(userAgent, 2, greatest(length(userAgent) - 2, 0)) AS key, survey_token, title, ts
  FROM first_ev WHERE rn = 1 AND clientIp IS NOT NULL AND userAgent IS NOT NULL),
pairs AS (
  SELECT m.client_ip, m.user_agent, m.timezone, m.country, m.browser_family, m.key, m.n_requests,
         c.survey_token, c.title AS click_title, c.ts AS click_ts
  FROM merged m JOIN clicks c USING (key)),
hits AS (
  SELECT p.key, p.timezone, p.country, p.browser_family, p.survey_token,
         arg_max(r.id, struct_pack(t := epoch_us(r.ts), n := -r.id)) AS id, max(epoch_us(r.ts)) AS req_us
  FROM pairs p JOIN reqs r
    ON r.client_ip = p.client_ip AND r.user_agent = p.user_agent AND r.timezone = p.timezone
   AND r.country = p.country AND r.browser_family = p.browser_family
   AND r.title = p.click_title AND r.ts <= p.click_ts
  GROUP BY p.key, p.timezone, p.country, p.browser_family, p.survey_token),
click_asof AS (
  SELECT p.*, h.id AS click_request_id, (epoch_us(p.click_ts) - h.req_us) / 1e6 AS time_to_click
  FROM pairs p LEFT JOIN hits h USING (key, timezone, country, browser_family, survey_token))
"""


def survey_ctes(cutoff: str) -> str:
    """CTEs after ``raw_survey, responses_log``: cleaned answers (``clean``) and those with a yes click
    on the two wikis (``survey_in_el``)."""
    from clicktrail.functions import recode as RC

    def lit(s):
        return "'" + s.replace("'", "''") + "'"

    def lookup(col, d):
        arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in d.items())
        return f"CASE {col} {arms} ELSE 'other' END"

    x = "raw_motivation"
    for text, code in RC.MOTIVATION_CODES:
        x = f"replace({x}, {lit(text)}, {lit(code)})"
    levels = ", ".join(lit(v) for v in RC.MOTIVATION_LEVELS)
    motivation = (
        f"list_sort(list_distinct(list_transform(string_split({x}, ', '), "
        f"lambda p: CASE WHEN p IN ({levels}) THEN p ELSE 'other' END)))"
    )
    q = {k: '"' + k + '"' for k in RC.RAW_COLUMNS}
    return f""",
filled AS (
  SELECT try_strptime(coalesce({q[A.Q_TIMESTAMP]}, 'no_response'), '%m/%d/%Y %H:%M:%S') AS submit_timestamp,
         coalesce({q[A.Q_DEPTH]}, 'no_response') AS raw_information_depth,
         coalesce({q[A.Q_PRIOR]}, 'no_response') AS raw_prior_knowledge,
         coalesce({q[A.Q_MOTIVATION]}, 'no_response') AS raw_motivation,
         coalesce({q[A.Q_TOKEN]}, 'no_response') AS token
  FROM raw_survey
  WHERE try_strptime({q[A.Q_TIMESTAMP]}, '%m/%d/%Y %H:%M:%S') > TIMESTAMP '{cutoff}'),
coded AS (
  SELECT *, {lookup('raw_information_depth', RC.DEPTH_CODES)} AS information_depth,
            {lookup('raw_prior_knowledge', RC.PRIOR_CODES)} AS prior_knowledge,
            {motivation} AS motivation_list
  FROM filled),
clean AS (
  SELECT * EXCLUDE (rn), array_to_string(motivation_list, '|') AS motivation FROM (
    SELECT *, row_number() OVER (PARTITION BY token ORDER BY submit_timestamp NULLS LAST,
               raw_information_depth, raw_prior_knowledge, raw_motivation) AS rn
    FROM coded) WHERE rn = 1),
yes_tokens AS (
  SELECT CASE webHost WHEN '{A.MOBILE_HOST}' THEN 'mobile' WHEN '{A.DESKTOP_HOST}' THEN 'desktop' END AS host,
         event_surveyInstanceToken AS token
  FROM responses_log
  WHERE event_surveyResponseValue = '{A.YES_BUTTON}'
    AND webHost IN ('{A.DESKTOP_HOST}', '{A.MOBILE_HOST}')),
survey_in_el AS (SELECT c.*, y.host FROM clean c JOIN yes_tokens y USING (token))
"""
