"""Projections of the driver's tables onto the inputs the pipeline expects.

Each adapter is one SQL text that both Spark and DuckDB run, so the Spark
operators and the DuckDB oracle start from identical rows. Only a handful
of date-format and interval snippets differ between the two dialects; they
are filled in by :class:`Dialect`. Table references are written ``{events}``:
Spark binds them to DataFrames, DuckDB to its pre-registered views.

The adapters stay flat (scalar columns). Maps and structs of the request-log
schema are assembled on the Spark side in :mod:`clicktrail.sources.tables`.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str  # 'spark' or 'duckdb'

    def compact_ts(self, col: str) -> str:
        if self.name == "spark":
            return f"date_format({col}, 'yyyyMMddHHmmss')"
        return f"strftime({col}, '%Y%m%d%H%M%S')"

    def form_ts(self, col: str) -> str:
        if self.name == "spark":
            return f"date_format({col}, 'M/d/yyyy H:mm:ss')"
        return f"strftime({col}, '%-m/%-d/%Y %-H:%M:%S')"

    def day_str(self, col: str) -> str:
        if self.name == "spark":
            return f"date_format({col}, 'yyyyMMdd')"
        return f"strftime({col}, '%Y%m%d')"

    def minutes(self, n: int) -> str:
        return f"INTERVAL '{n}' MINUTE" if self.name == "spark" else f"INTERVAL {n} MINUTE"

    def ident(self, name: str) -> str:
        return f"`{name}`" if self.name == "spark" else f'"{name}"'


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")

# ---------------------------------------------------------------------------
# Survey question headers and answer texts of the raw form
# export, the response-button values of the event log, and the wiki hosts.
# They must equal the original survey for the recoding to work.
# ---------------------------------------------------------------------------
Q_TIMESTAMP = "Timestamp"
Q_DEPTH = "I am reading this article to"
Q_PRIOR = "Prior to visiting this article"
Q_MOTIVATION = "I am reading this article because"
Q_TOKEN = "This is you survey ID. Please do not modify."

A_FACT = "look up a specific fact or to get a quick answer."
A_OVERVIEW = "get an overview of the topic."
A_INDEPTH = "get an in-depth understanding of the topic."
A_FAMILIAR = "I was already familiar with the topic."
A_UNFAMILIAR = "I was not familiar with the topic and I am learning about it for the first time."
A_WORK = "I have a work or school-related assignment."
A_DECISION = "I need to make a personal decision based on this topic (e.g. to buy a  book, choose a travel destination)."
A_EVENT = "I want to know more about a current event (e.g. a soccer game, a recent earthquake, somebody's death)."
A_MEDIA = "the topic was referenced in a piece of media (e.g. TV, radio, article, film, book)."
A_CONVERSATION = "the topic came up in a conversation."
A_BORED = "I am bored or randomly exploring Wikipedia for fun."
A_INTRINSIC = (
    "this topic is important to me and I want to learn more about it. (e.g., to learn about a culture)."
)

YES_BUTTON = "ext-quicksurveys-external-survey-yes-button"
NO_BUTTON = "ext-quicksurveys-external-survey-no-button"
DESKTOP_HOST = "en.wikipedia.org"
MOBILE_HOST = "en.m.wikipedia.org"

MOTIVATION_TEXTS = [A_WORK, A_DECISION, A_EVENT, A_MEDIA, A_CONVERSATION, A_BORED, A_INTRINSIC]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(expr: str, values: list[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {_lit(v) if v is not None else 'NULL'}" for i, v in enumerate(values)
    )
    return f"CASE {expr} {arms} END"


# events with the integer k of props; every adapter starts here
_EV = "(SELECT *, cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM {events})"
# clients, agents and titles come from the full user id, so a client's data does not grow with the table
_CLIENT_IP = "'10.' || cast(user_id AS string) || '.1'"
_USER_AGENT = "'Mozilla/5.0 (agent ' || cast(user_id AS string) || ')'"


def _title(k: str) -> str:
    return f"'P' || cast(user_id AS string) || '_' || cast({k} AS string)"




def request_log_sql(d: Dialect) -> str:
    """Flat web-request log: one row per event."""
    return f"""
SELECT
  event_id AS req_id,
  {_CLIENT_IP} AS client_ip,
  {_USER_AGENT} AS user_agent,
  cast(ts AS timestamp) AS ts,
  'https://h/wiki/' || {_title('cast(floor(k / 3) AS int) % 3')} || '/' AS referer,
  CASE WHEN k % 2 = 0 THEN '{DESKTOP_HOST}' ELSE '{MOBILE_HOST}' END AS uri_host,
  '/wiki/' || {_title('k % 3')} AS uri_path,
  '' AS uri_query,
  event_type IN ('view', 'click', 'purchase') AS is_pageview,
  CASE WHEN k % 2 = 0 THEN 'desktop' ELSE 'mobile web' END AS access_method,
  CASE WHEN k % 5 = 0 THEN 'external (search engine)' ELSE 'internal' END AS referer_class,
  'text' AS webrequest_source,
  CASE WHEN user_id % 10 = 0 THEN 'spider' ELSE 'user' END AS agent_type,
  {_title('k % 3')} AS page_title,
  'wikipedia' AS project_class,
  'en' AS project,
  {_case('user_id % 6', ['America/New_York', 'Europe/Berlin', 'Asia/Tokyo', 'Mars/Olympus_Mons', 'UTC', 'Japan'])} AS timezone,
  {_case('user_id % 3', ['US', 'DE', 'JP'])} AS country,
  {_case('user_id % 3', ['Firefox', 'Chrome', 'Safari'])} AS browser_family,
  cast(year(ts) AS int) AS year,
  cast(month(ts) AS int) AS month,
  cast(dayofmonth(ts) AS int) AS day,
  cast(hour(ts) AS int) AS hour
FROM {_EV} e
"""


def redirects_sql(d: Dialect) -> str:
    """Redirect table derived from the titles in use: every user's third title redirects to the first."""
    return f"""
SELECT DISTINCT {_title('2')} AS rd_from, {_title('0')} AS rd_to
FROM {_EV} e WHERE k % 3 = 2
"""


_TOKEN = "CASE WHEN k = 4 THEN 'dup' || cast(user_id AS string) ELSE 't' || cast(event_id AS string) END"


def responses_log_sql(d: Dialect) -> str:
    """Survey button clicks (yes: 'error' events, no: 'signup' events, both with k < 10)."""
    return f"""
SELECT
  CASE WHEN k = 9 THEN 'de.wikipedia.org' WHEN k % 2 = 0 THEN '{DESKTOP_HOST}' ELSE '{MOBILE_HOST}' END AS webHost,
  user_id * 3 + k % 3 AS event_pageId,
  {_TOKEN} AS event_surveyInstanceToken,
  CASE WHEN event_type = 'error' THEN '{YES_BUTTON}' ELSE '{NO_BUTTON}' END AS event_surveyResponseValue,
  CASE WHEN k = 8 THEN NULL ELSE {_CLIENT_IP} END AS clientIp,
  '"' || {_USER_AGENT} || '"' AS userAgent,
  {d.compact_ts('cast(ts AS timestamp)')} AS timestamp
FROM {_EV} e
WHERE event_type IN ('error', 'signup') AND k < 10
"""


def page_sql(d: Dialect) -> str:
    return f"""
SELECT DISTINCT user_id * 3 + k % 3 AS page_id, {_title('k % 3')} AS page_title
FROM {_EV} e
"""


def initiation_log_sql(d: Dialect) -> str:
    """Survey initiation events: 'eligible' page views and widget 'impression's."""
    session_token = f"'s' || cast(user_id AS string) || '-' || {d.day_str('cast(ts AS timestamp)')}"
    common = f"""{_TOKEN} AS event_surveyInstanceToken,
  {session_token} AS event_surveySessionToken,
  {_CLIENT_IP} AS clientIP,
  '"' || {_USER_AGENT} || '"' AS userAgent"""
    return f"""
SELECT 'eligible' AS event_eventName, {common}
FROM {_EV} e WHERE event_type IN ('error', 'signup') AND k < 12
UNION ALL
SELECT 'impression' AS event_eventName, {common}
FROM {_EV} e WHERE (event_type IN ('error', 'signup') AND k < 11) OR (event_type = 'purchase' AND k = 0)
"""


def raw_survey_sql(d: Dialect) -> str:
    """Raw form export: one row per submitted answer, question texts as headers.

    Answers exist for yes-click tokens (k not 4 or 7), once for each repeated
    'dup' token, and for some no-click tokens (k < 3). k = 6 leaves the token
    empty, k % 4 = 3 leaves the first question unanswered.
    """
    depth = _case("k % 4", [A_FACT, A_OVERVIEW, A_INDEPTH, None])
    prior = _case("k % 3", [A_FAMILIAR, A_UNFAMILIAR, "Something else entirely"])
    first = _case("(k + 5) % 8", MOTIVATION_TEXTS + ["my own reason"])
    second = _case("(k + 3) % 7", MOTIVATION_TEXTS)
    motivation = f"CASE WHEN k % 3 = 0 THEN {first} || ', ' || {second} ELSE {first} END"
    ts = f"cast(ts AS timestamp) + {d.minutes(5)}"
    return f"""
SELECT
  {d.form_ts(ts)} AS {d.ident(Q_TIMESTAMP)},
  {depth} AS {d.ident(Q_DEPTH)},
  {prior} AS {d.ident(Q_PRIOR)},
  {motivation} AS {d.ident(Q_MOTIVATION)},
  CASE WHEN k = 6 THEN NULL ELSE {_TOKEN} END AS {d.ident(Q_TOKEN)}
FROM {_EV} e
WHERE (event_type = 'error' AND k < 10 AND k NOT IN (7)) OR (event_type = 'signup' AND k < 3)
"""


ADAPTERS = {
    "request_log": request_log_sql,
    "redirects": redirects_sql,
    "responses_log": responses_log_sql,
    "page": page_sql,
    "initiation_log": initiation_log_sql,
    "raw_survey": raw_survey_sql,
}


def duckdb_with(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for oracle queries, over DuckDB's views."""
    parts = []
    for n in names:
        sql = ADAPTERS[n](DUCKDB).replace("{events}", "events")
        parts.append(f"{n} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n"
