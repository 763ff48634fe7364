"""Queries over counts, shares and interval estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from clicktrail.functions import recode as RC
from clicktrail.operators import stats as ST
from clicktrail.plans import jobs as P
from clicktrail.registry import register
from clicktrail.registry.duck_random import beta_interval_ctes, poisson1, uniform
from clicktrail.registry.trace_queries import NO_CUTOFF
from clicktrail.registry.sqlbits import survey_ctes
from clicktrail.sources import tables as T
from clicktrail.sources.adapters import duckdb_with

BOOT = 1000  # bootstrap replicates
SURVEY = duckdb_with("raw_survey", "responses_log") + survey_ctes(NO_CUTOFF)
OC = "oc AS (SELECT o.*, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)"


def orders_customers(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    c = T.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "inner").drop("c_custkey")


def survey_in_el(spark, sf_dir):
    s = P.survey_in_el(T.raw_survey(spark, sf_dir), T.responses_log(spark, sf_dir), NO_CUTOFF)
    return s.withColumnsRenamed({"information depth": "information_depth", "prior knowledge": "prior_knowledge"})


# ---------------------------------------------------------------- proportions
@register(
    "proportions",
    f"WITH {OC}, cnt AS (SELECT c_mktsegment, o_orderpriority, count(*) AS count FROM oc GROUP BY ALL)\n"
    "SELECT *, count / sum(count) OVER (PARTITION BY o_orderpriority) AS proportion FROM cnt",
)
def proportions(spark, sf_dir):
    return ST.proportions(orders_customers(spark, sf_dir), "c_mktsegment", "o_orderpriority", normx=True)


@register(
    "proportions_survey",
    SURVEY
    + """, cnt AS (SELECT information_depth, host, count(*) AS count FROM survey_in_el
          WHERE information_depth <> 'no response' AND host <> 'no response' GROUP BY ALL)
SELECT *, count / sum(count) OVER (PARTITION BY host) AS proportion FROM cnt""",
)
def proportions_survey(spark, sf_dir):
    return ST.proportions(survey_in_el(spark, sf_dir), "information_depth", "host", normx=True)


@register(
    "proportions_by_x",
    SURVEY
    + """, cnt AS (SELECT information_depth, prior_knowledge, count(*) AS count FROM survey_in_el
          WHERE information_depth <> 'no response' AND prior_knowledge <> 'no response' GROUP BY ALL)
SELECT *, count / sum(count) OVER (PARTITION BY information_depth) AS proportion FROM cnt""",
)
def proportions_by_x(spark, sf_dir):
    return ST.proportions(survey_in_el(spark, sf_dir), "information_depth", "prior_knowledge", normx=False)


@register(
    "expand_bernoulli",
    f"WITH {OC}, cnt AS (SELECT c_mktsegment, o_orderpriority, count(*) AS count FROM oc GROUP BY ALL),\n"
    "sized AS (SELECT *, cast(sum(count) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS n FROM cnt)\n"
    "SELECT c_mktsegment, o_orderpriority, 1 AS in_data, count AS rows FROM sized\n"
    "UNION ALL SELECT c_mktsegment, o_orderpriority, 0, n - count FROM sized WHERE n > count",
)
def expand_bernoulli(spark, sf_dir):
    props = ST.proportions(orders_customers(spark, sf_dir), "c_mktsegment", "o_orderpriority")
    e = ST.expand_bernoulli(props, "c_mktsegment", "o_orderpriority")
    return e.groupBy("c_mktsegment", "o_orderpriority", "in_data").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- motivations
@register(
    "n_motivations",
    SURVEY
    + """, cnt AS (SELECT cast(len(motivation_list) AS INTEGER) AS n_motivations, count(*) AS count
                   FROM survey_in_el GROUP BY ALL)
SELECT *, count / sum(count) OVER () AS proportion FROM cnt""",
)
def n_motivations(spark, sf_dir):
    return ST.n_motivations_distribution(survey_in_el(spark, sf_dir))


@register(
    "single_motivation",
    SURVEY
    + """, cnt AS (SELECT motivation_list[1] AS motivation, count(*) AS count FROM survey_in_el
                   WHERE len(motivation_list) = 1 GROUP BY ALL)
SELECT *, count / sum(count) OVER () AS proportion FROM cnt""",
)
def single_motivation(spark, sf_dir):
    return ST.single_motivation_distribution(survey_in_el(spark, sf_dir))


_LEVELS = ", ".join(f"('{lv}')" for lv in RC.MENTION_LEVELS)


@register(
    "mention_counts",
    SURVEY
    + f""", lv(motivation) AS (VALUES {_LEVELS}),
cnt AS (SELECT lv.motivation, count(s.token) AS count
        FROM lv LEFT JOIN survey_in_el s ON list_contains(s.motivation_list, lv.motivation)
        GROUP BY lv.motivation)
SELECT *, count / sum(count) OVER () AS proportion FROM cnt""",
)
def mention_counts(spark, sf_dir):
    return ST.mention_counts(survey_in_el(spark, sf_dir), RC.MENTION_LEVELS)


_PAIRS_SQL = SURVEY + """, pairs AS (
  SELECT list_sort(motivation_list)[1] AS m1, list_sort(motivation_list)[2] AS m2, count(*) AS count
  FROM survey_in_el WHERE len(motivation_list) = 2 GROUP BY ALL),
mirrored AS (SELECT m1, m2, count FROM pairs UNION ALL SELECT m2, m1, count FROM pairs)
"""


@register("pair_counts", _PAIRS_SQL + "SELECT * FROM pairs")
def pair_counts(spark, sf_dir):
    return ST.pair_counts(survey_in_el(spark, sf_dir))


@register(
    "pair_conditional",
    _PAIRS_SQL + "SELECT *, count / sum(count) OVER (PARTITION BY m1) AS p_m2_given_m1 FROM mirrored",
)
def pair_conditional(spark, sf_dir):
    return ST.pair_conditional(ST.pair_counts(survey_in_el(spark, sf_dir)))


_MATRIX_COLS = ", ".join(
    f"cast(sum(count) FILTER (WHERE m2 = '{lv}') AS BIGINT) AS \"{lv}\"" for lv in RC.MENTION_LEVELS
)


@register("cooccurrence_matrix", _PAIRS_SQL + f"SELECT m1, {_MATRIX_COLS} FROM mirrored GROUP BY m1")
def cooccurrence_matrix(spark, sf_dir):
    return ST.cooccurrence_matrix(ST.pair_counts(survey_in_el(spark, sf_dir)), RC.MENTION_LEVELS)


# ---------------------------------------------------------------- intervals
@register(
    "proportions_over_time",
    f"WITH {OC}, cnt0 AS (SELECT cast(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(*) AS count\n"
    "  FROM oc GROUP BY ALL),\n"
    "cnt AS (SELECT *, sum(count) OVER (PARTITION BY year) AS n FROM cnt0),\n"
    + beta_interval_ctes("cnt", "count", "n")
    + """
SELECT year, o_orderpriority, count, cast(n AS BIGINT) AS n, round(count / n, 6) AS proportion,
       round(lower, 6) AS lower, round(upper, 6) AS upper,
       round(count / n - lower, 6) AS lower_err, round(upper - count / n, 6) AS upper_err
FROM cnt JOIN beta_q ON beta_q._k = cnt.count AND beta_q._nn = cnt.n
""",
)
def proportions_over_time(spark, sf_dir):
    o = orders_customers(spark, sf_dir).withColumn("year", F.year("o_orderdate").cast("int"))
    p = ST.proportions_over_time(o, "year", "o_orderpriority")
    return p.select(
        "year", "o_orderpriority", "count", F.col("n").cast("bigint").alias("n"),
        *[F.round(c, 6).alias(c) for c in ("proportion", "lower", "upper", "lower_err", "upper_err")],
    )


_BOOT_W = poisson1(uniform("'boot/' || cast(o_orderkey AS VARCHAR) || '/' || cast(b AS VARCHAR)"))


@register(
    "group_mean_ci",
    f"""WITH reps AS (
  SELECT o_orderpriority, b, sum(w * y) / sum(w) AS m FROM (
    SELECT o_orderpriority, b, o_totalprice AS y, {_BOOT_W} AS w
    FROM orders, range(1, {BOOT} + 1) r(b))
  GROUP BY ALL HAVING sum(w) > 0),
ci AS (SELECT o_orderpriority, quantile_cont(m, [0.025, 0.975]) AS q FROM reps GROUP BY ALL),
means AS (SELECT o_orderpriority, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, round(mean, 2) AS mean, n, round(q[1], 2) AS ci_lower, round(q[2], 2) AS ci_upper
FROM means JOIN ci USING (o_orderpriority)""",
)
def group_mean_ci(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    g = ST.group_mean_ci(o, ["o_orderpriority"], "o_totalprice", "o_orderkey", boot=BOOT)
    return g.select("o_orderpriority", F.round("mean", 2).alias("mean"), "n",
                    F.round("ci_lower", 2).alias("ci_lower"), F.round("ci_upper", 2).alias("ci_upper"))


BINS = 512
_BIN = f"cast('0x' || substr(md5('boot/' || cast(l_orderkey AS VARCHAR) || '-' || cast(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) % {BINS}"
_BIN_W = poisson1(uniform("'boot/' || l_returnflag || '/' || cast(bin AS VARCHAR) || '/' || cast(b AS VARCHAR)"))


@register(
    "group_mean_ci_binned",
    f"""WITH sums AS (
  SELECT l_returnflag, {_BIN} AS bin, sum(l_extendedprice) AS s, count(*) AS k FROM lineitem GROUP BY ALL),
reps AS (
  SELECT l_returnflag, b, sum(w * s) / sum(w * k) AS m FROM (
    SELECT l_returnflag, b, s, k, {_BIN_W} AS w FROM sums, range(1, {BOOT} + 1) r(b))
  GROUP BY ALL HAVING sum(w) > 0),
ci AS (SELECT l_returnflag, quantile_cont(m, [0.025, 0.975]) AS q FROM reps GROUP BY ALL),
means AS (SELECT l_returnflag, avg(l_extendedprice) AS mean, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(mean, 2) AS mean, n, round(q[1], 2) AS ci_lower, round(q[2], 2) AS ci_upper
FROM means JOIN ci USING (l_returnflag)""",
)
def group_mean_ci_binned(spark, sf_dir):
    """A24 with draws that do not grow with the rows."""
    li = T.table(spark, sf_dir, "lineitem").withColumn("row", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    g = ST.group_mean_ci_binned(li, ["l_returnflag"], "l_extendedprice", "row", bins=BINS, boot=BOOT)
    return g.select("l_returnflag", F.round("mean", 2).alias("mean"), "n",
                    F.round("ci_lower", 2).alias("ci_lower"), F.round("ci_upper", 2).alias("ci_upper"))


@register(
    "group_median",
    f"WITH {OC} SELECT c_mktsegment, median(o_totalprice) AS median FROM oc GROUP BY ALL",
)
def group_median(spark, sf_dir):
    return ST.group_median(orders_customers(spark, sf_dir), ["c_mktsegment"], "o_totalprice")


@register(
    "box_summary",
    f"""WITH {OC}, q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM oc GROUP BY ALL)
SELECT o.o_orderpriority, q.q[1] AS q1, q.q[2] AS median, q.q[3] AS q3,
  min(o_totalprice) FILTER (WHERE o_totalprice >= q.q[1] - 1.5 * (q.q[3] - q.q[1])
                               AND o_totalprice <= q.q[3] + 1.5 * (q.q[3] - q.q[1])) AS whisker_low,
  max(o_totalprice) FILTER (WHERE o_totalprice >= q.q[1] - 1.5 * (q.q[3] - q.q[1])
                               AND o_totalprice <= q.q[3] + 1.5 * (q.q[3] - q.q[1])) AS whisker_high
FROM oc o JOIN q USING (o_orderpriority) GROUP BY o.o_orderpriority, q.q""",
)
def box_summary(spark, sf_dir):
    return ST.box_summary(orders_customers(spark, sf_dir), ["o_orderpriority"], "o_totalprice")


@register(
    "histogram",
    """WITH v AS (SELECT cast(o_totalprice AS DOUBLE) AS v FROM orders WHERE o_totalprice IS NOT NULL),
st AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
cnt AS (SELECT cast(least(floor((v - lo) / ((hi - lo) / 10.0e0)), 9) AS INTEGER) AS bin, count(*) AS count
        FROM v, st GROUP BY 1),
edges AS (SELECT cast(b AS INTEGER) AS bin, lo + (hi - lo) * b / 10.0e0 AS lower,
                 lo + (hi - lo) * (b + 1) / 10.0e0 AS upper FROM st, range(0, 10) r(b))
SELECT bin, lower, upper, coalesce(count, 0) AS count FROM edges LEFT JOIN cnt USING (bin)""",
)
def histogram(spark, sf_dir):
    return ST.histogram(T.table(spark, sf_dir, "orders"), "o_totalprice", bins=10)


_DIMS = ["c_mktsegment", "o_orderpriority", "o_orderstatus"]


@register(
    "metric_breakdowns",
    f"WITH {OC}\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{d}' AS dimension, cast({d} AS VARCHAR) AS value, count(*) AS n, round(avg(o_totalprice), 4) AS mean,"
        f" median(o_totalprice) AS median FROM oc WHERE {d} IS NOT NULL AND {d} <> 'no response' GROUP BY {d}"
        for d in _DIMS
    ),
)
def metric_breakdowns(spark, sf_dir):
    m = ST.metric_breakdowns(orders_customers(spark, sf_dir), ["o_totalprice"], _DIMS)
    return m.drop("metric").withColumn("mean", F.round("mean", 4))


# ---------------------------------------------------------------- answer browser
_QUESTIONS = ["information_depth", "prior_knowledge", "host"]


def _answer_counts_sql(where: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{q}' AS question, cast({q} AS VARCHAR) AS answer, count(*) AS count FROM survey_in_el"
        f" WHERE {where} GROUP BY {q}"
        for q in _QUESTIONS
    )


@register("answer_counts", SURVEY + "\n" + _answer_counts_sql("true"))
def answer_counts(spark, sf_dir):
    return ST.answer_counts(survey_in_el(spark, sf_dir), _QUESTIONS)


@register(
    "compare_conditionings",
    SURVEY
    + f""", a0 AS ({_answer_counts_sql("prior_knowledge = 'familiar'")}),
b0 AS ({_answer_counts_sql("prior_knowledge = 'unfamiliar'")}),
a AS (SELECT *, count / sum(count) OVER (PARTITION BY question) AS share FROM a0),
b AS (SELECT *, count / sum(count) OVER (PARTITION BY question) AS share FROM b0)
SELECT coalesce(a.question, b.question) AS question, coalesce(a.answer, b.answer) AS answer,
       coalesce(a.count, 0) AS count_1, coalesce(a.share, 0) AS share_1,
       coalesce(b.count, 0) AS count_2, coalesce(b.share, 0) AS share_2
FROM a FULL OUTER JOIN b ON a.question = b.question AND a.answer = b.answer""",
)
def compare_conditionings(spark, sf_dir):
    return ST.compare_conditionings(
        survey_in_el(spark, sf_dir), _QUESTIONS, {"prior_knowledge": "familiar"}, {"prior_knowledge": "unfamiliar"}
    )


@register(
    "value_counts",
    "SELECT source, count(*) AS count FROM documents GROUP BY ALL",
)
def value_counts(spark, sf_dir):
    return ST.value_counts(T.table(spark, sf_dir, "documents"), "source")
