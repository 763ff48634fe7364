"""Composed jobs (X1-X11): each is a lazy DataFrame plan over the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.functions.recode import single_motivation
from clicktrail.functions.urls import page_key, referer_key
from clicktrail.operators import clicks as C
from clicktrail.operators import requests as R
from clicktrail.operators import sessions as SS
from clicktrail.operators import stats as ST
from clicktrail.operators import survey as SV
from clicktrail.operators import trees as TR
from clicktrail.operators.asof import asof_click_request
from clicktrail.sources.work import stored, work_folder


def build_trace_table(
    log: DataFrame,
    redirects: DataFrame,
    hosts: Sequence[str] = R.TRACED_HOSTS,
    hour: int | None = None,
    max_requests: int | None = None,
) -> DataFrame:
    """X1, the nested per-day table for its writers (S4, S5): S1 -> P1 (-> A2) -> P3 -> J1 -> P4 -> P5 -> A1."""
    traffic = R.filter_traffic(log, hosts, hour)
    if max_requests is not None:
        traffic = R.drop_heavy(traffic, max_requests)
    return R.build_traces(R.pack_request(R.resolve_redirects(R.raw_title(traffic), redirects, untitled=True, heavy=True)))


def build_merged_traces(
    log: DataFrame,
    redirects: DataFrame,
    hosts: Sequence[str] = R.TRACED_HOSTS,
    hour: int | None = None,
    max_requests: int | None = None,
    year: int | None = None,
) -> DataFrame:
    """X1, the nested all-days table for its writer (S6): per-day traces merged into one trace per client (A3)."""
    return R.merge_traces(build_trace_table(log, redirects, hosts, hour, max_requests), year=year)


def flat_trace_summary(traces: DataFrame) -> DataFrame:
    """Scalar view of a nested trace table: request count and the title sequence."""
    req = F.col("requests")
    return traces.select(
        "*",
        F.size(req).cast("bigint").alias("n_requests"),
        F.when(F.size(req) > 0, F.array_join(F.transform(req, lambda r: r["title"]), ",")).alias("titles"),
    )


def numbered_trace_rows(log: DataFrame, redirects: DataFrame, **options) -> DataFrame:
    """X1 + W6 as rows: every complete request with its trace and its position ``id`` in it.

    The rows are written first: numbering reads them twice, the second time their keys alone.
    """
    rows = stored(R.trace_rows(log, redirects, **options), f"{work_folder(log.sparkSession, 'traces')}/rows")
    return SS.number_requests(rows, ["trace"], R.TRACE_ORDER)


def build_merged_chunks(log: DataFrame, redirects: DataFrame, size: int = 1000, **options) -> DataFrame:
    """X1, the all-days table for its writer (S6) without an array that grows with a client's history (A3 in chunks)."""
    return R.chunk_traces(numbered_trace_rows(log, redirects, **options), size)


CLICK_COLS = ("key", "trace", "survey_token", "click_dt_utc", "click_title")


@dataclass
class SurveyStages:
    """The tables of X3 and X4, each written once: what a report counts or joins is read, not computed again."""

    clicks: DataFrame
    rows: DataFrame
    click_hits: DataFrame
    survey: DataFrame | None = None
    survey_in_el: DataFrame | None = None
    responses: DataFrame | None = None


def click_stages(log: DataFrame, redirects: DataFrame, responses: DataFrame, pages: DataFrame, **options) -> SurveyStages:
    """Yes clicks (P8, J3, F8, W1, P9, F7, F6), the trace rows of the clients that clicked, and per click and
    trace the request it came from (J2, J6). The log is cut down to those clients before traces are built."""
    folder = work_folder(log.sparkSession, "clicks")
    clicks = stored(C.prepared_clicks(responses, pages), f"{folder}/clicks")
    rows = stored(numbered_trace_rows(C.clicked_log(log, clicks), redirects, **options), f"{folder}/rows")
    joined = C.join_traces_clicks(rows, clicks)
    maps = joined.groupBy(*CLICK_COLS).agg(
        F.first("geocoded_data").alias("geo_data"), F.first("user_agent_map").alias("ua_data")
    )
    hits = asof_click_request(joined, CLICK_COLS)
    return SurveyStages(clicks, rows, stored(hits.join(maps, list(CLICK_COLS)), f"{folder}/hits"))


def survey_in_el(raw_survey: DataFrame, responses: DataFrame, cutoff: str = SV.LAUNCH_CUTOFF) -> DataFrame:
    """X8 + J4: cleaned answers that have a yes click in the event log."""
    return SV.join_survey_clicks(SV.clean_responses(raw_survey, cutoff), responses)


def survey_stages(
    log: DataFrame,
    redirects: DataFrame,
    raw_survey: DataFrame,
    responses: DataFrame,
    pages: DataFrame,
    cutoff: str = SV.LAUNCH_CUTOFF,
    max_seconds: float | None = 3600,
    **options,
) -> SurveyStages:
    """X3 + X8 + X4 end to end: answers -> clicks -> traces -> the request the click came from."""
    st = click_stages(log, redirects, responses, pages, **options)
    folder = work_folder(log.sparkSession, "survey")
    st.survey = stored(SV.clean_responses(raw_survey, cutoff), f"{folder}/clean")
    st.survey_in_el = stored(SV.join_survey_clicks(st.survey, responses), f"{folder}/in_el")
    st.responses = stored(SV.responses_with_traces(st.survey_in_el, st.click_hits, max_seconds), f"{folder}/responses")
    return st


# ---------------------------------------------------------------- sessions and trees of responses
def sessions_and_trees(
    responses: DataFrame,
    rows: DataFrame,
    key: str = "survey_token",
    gap_minutes: float = 60,
    ambiguity: str = "reference",
    trees: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """W5 -> J7 -> T2 -> J9 for each response: (rows of the click session, nodes of the click tree).

    ``rows`` are numbered trace rows; each response finds its own by the
    ``trace`` key. Both results are read from working tables.
    """
    folder = work_folder(responses.sparkSession, "sessions")
    wanted = responses.select(key, "trace", F.col("click_request.id").alias("click_id"))
    own = rows.join(wanted, "trace")
    s = stored(SS.sessionize(own, [key], gap_minutes=gap_minutes), f"{folder}/sessions")
    hit = s.where(F.col("id") == F.col("click_id")).select(key, "session_id", "click_id")
    session_rows = s.join(hit.select(key, "session_id"), [key, "session_id"], "left_semi")  # J7
    if not trees:
        return session_rows, None
    forest = click_forest(session_rows, [key, "session_id"], ambiguity)
    return session_rows, TR.click_tree(forest, hit, [key, "session_id"], node="id", click_node="click_id")  # J9


def click_forest(session_rows: DataFrame, group: Sequence[str], ambiguity: str = "reference") -> DataFrame:
    """T2 over session rows: page and referer keys (F19, F20), then the referer forest of each group."""
    keyed = session_rows.withColumn("page_key", page_key(F.col("uri_path"), F.col("uri_query"))).withColumn(
        "referer_key", referer_key(F.col("referer"))
    )
    return TR.build_forest(keyed, group, node="id", ambiguity=ambiguity)


ANSWERS = ("response_host", "information depth", "prior knowledge", "single motivation")
SESSION_METRICS = ("num_pageviews", "session_length", "external_searches")
TREE_METRICS = ("size", "num_leafs", "mean_time_diff", "degree_max", "depth_max")


def metric_report(responses: DataFrame, rows: DataFrame, key: str = "survey_token", gap_minutes: float = 60) -> DataFrame:
    """Mean, median and count of eight metrics of the click session (T4-T6) and the click tree (T7, T10, T11,
    T13, T20) per value of the host and of each answer (P18, A28): ``metric, dimension, value, n, mean, median``."""
    session_rows, tree = sessions_and_trees(responses, rows, key, gap_minutes)
    answers = responses.select(
        key, F.col("host").alias("response_host"), "`information depth`", "`prior knowledge`",
        single_motivation(F.col("motivation")).alias("single motivation"),
    )
    sess = SS.session_summary(session_rows, [key]).drop("host")
    metrics = TR.tree_metrics(tree, [key, "session_id"], node="id", with_dfsness=False).select(key, *TREE_METRICS)
    wide = sess.join(metrics, key).join(answers, key)
    wide = stored(wide, f"{work_folder(responses.sparkSession, 'metrics')}/wide")
    return ST.metric_breakdowns(wide, [*SESSION_METRICS, *TREE_METRICS], ANSWERS)


def click_vs_sample(
    responses: DataFrame,
    rows: DataFrame,
    sample_rows: DataFrame,
    key: str = "survey_token",
    gap_minutes: float = 60,
    seed: str = "sample",
) -> DataFrame:
    """X7 data: one row per click and per sampled trace, labelled by condition (U2, P24), with the host of the first
    request (F24), known hosts only (P21): page views, session length (T4, T5) of the click's session or of one random
    session (F26), and the size of the click's tree or of one random tree of that session (F27, T7)."""
    click_rows, tree = sessions_and_trees(responses, rows, key, gap_minutes)
    sizes = tree.groupBy(key).agg(F.count(F.lit(1)).alias("tree_size"))
    click = SS.session_summary(click_rows, [key]).join(sizes, key, "left").withColumn("unit", F.col(key))
    folder = work_folder(responses.sparkSession, "sample")
    s = SS.sessionize(sample_rows, ["trace"], gap_minutes=gap_minutes)
    s = stored(s.withColumn("unit", F.concat_ws("\t", "ip", "ua")), f"{folder}/sessions")
    picked = SS.pick_session(s.select("trace", "session_id").distinct(), ["trace"], seed)  # F26
    s = stored(s.join(picked, ["trace", "session_id"], "left_semi"), f"{folder}/picked")
    one = TR.pick_tree(click_forest(s, ["trace", "session_id"]), ["trace", "session_id"], seed)  # F27
    sizes = one.groupBy("trace").agg(F.count(F.lit(1)).alias("tree_size"))
    samp = SS.session_summary(s, ["trace", "unit"]).join(sizes, "trace", "left")
    cols = ["unit", "num_pageviews", "session_length", "tree_size", "host"]
    both = click.select(*cols, F.lit("click").alias("condition")).unionByName(samp.select(*cols, F.lit("sample").alias("condition")))
    return both.where(F.col("host") != "unknown")  # P21


def compare_conditions(df: DataFrame, metrics: Sequence[str], boot: int = 1000) -> DataFrame:
    """A29 + A24: mean of each metric per host and condition with its bootstrap interval: ``metric, host, condition,
    mean, n, ci_lower, ci_upper``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics]))
    long = df.select("unit", "host", "condition", pairs.alias("_m")).select("unit", "host", "condition", "_m.metric", "_m.y")
    return ST.group_mean_ci(long.where("y is not null"), ["metric", "host", "condition"], "y", "unit", boot=boot)


# ---------------------------------------------------------------- reports
def hash_traces(lines: DataFrame, key: str) -> DataFrame:
    """Text trace lines -> typed traces (S7, F2, F3) with the ip replaced by its keyed HMAC.

    Write the result with :func:`clicktrail.sources.io.write_hashed` (S8).
    """
    from clicktrail.functions.privacy import hmac_sha1
    from clicktrail.functions.textparse import parse_trace_lines

    return parse_trace_lines(lines).withColumn("ip", hmac_sha1(F.col("ip"), key))


def qa_report(
    initiation: DataFrame,
    responses: DataFrame,
    survey: DataFrame,
    requests: DataFrame,
    pages: DataFrame,
    slice_start: str,
    slice_stop: str,
) -> dict[str, DataFrame]:
    """The tracking quality report as named DataFrames (nothing runs until each is used)."""
    from clicktrail.operators import quality as Q
    from clicktrail.sources.adapters import Q_TOKEN

    funnel = Q.survey_funnel(initiation, responses)
    matches = Q.answer_matches(survey, responses, initiation, slice_start, slice_stop)
    return {
        "funnel": funnel,  # A4
        "distinct_tokens": Q.distinct_tokens(initiation),  # A5
        "distinct_clients": Q.distinct_clients(initiation),  # A6-A8
        "matched_tokens": Q.matched_tokens(initiation),  # J10
        "responses_with_impression": Q.responses_with_impression(responses, initiation),  # J11
        "answer_matches": matches,  # J12-J14, P22
        "funnel_rates": Q.funnel_rates(matches, funnel),  # A33
        "unmatched_answers": Q.unmatched_answers(survey, responses, initiation),  # J15, O6
        "token_lengths": ST.length_distribution(survey, Q_TOKEN),  # A12
        "ua_shares": Q.ua_shares(initiation),  # A9
        "ua_share_delta": Q.ua_share_delta(Q.ua_counts(requests), initiation),  # A10, O2, J16, O3
        "client_freq_of_freq": Q.client_freq_of_freq(C.click_events(responses, pages)),  # A11
    }


def temporal_report(responses: DataFrame, zones: list[str], draws: int = 5000) -> DataFrame:
    """Answers by client-local day type, day of week and 4-hour bucket (weekdays only, P19), each as proportions
    with Beta intervals (F14-F18, P13, P18, A22, A23): ``part, bucket, answer, count, n, proportion, lower, upper``."""
    from clicktrail.functions import temporal as TM

    d = responses.withColumn("single motivation", single_motivation(F.col("motivation")))
    d = TM.with_local_time(d, "click_dt_utc", F.col("geo_data")["timezone"], zones)
    parts = []
    for x, hues in (
        ("local_day_type", ANSWERS[1:]),
        ("local_day_of_week", ("single motivation",)),
        ("local_hour_of_day_div4", ANSWERS[1:]),
    ):
        for hue in hues:
            here = (F.col("local_day_type") == 0) if x == "local_hour_of_day_div4" else F.lit(True)
            parts.append(F.when(here, F.struct(F.lit(f"{hue} by {x}").alias("part"), F.col(x).alias("bucket"), F.col(f"`{hue}`").alias("answer"))))
    long = d.select(F.explode(F.array(*parts)).alias("c")).select("c.*").where("answer is not null")
    slot = long.withColumn("slot", F.struct("part", "bucket"))
    out = ST.proportions_over_time(slot, "slot", "answer", draws=draws)
    return out.select("slot.part", "slot.bucket", "answer", "count", "n", "proportion", "lower", "upper")


def distribution_report(survey_in_el_df: DataFrame) -> dict[str, DataFrame]:
    """X11: answer distributions (J4 output in, P18, P25, P26, A14-A20, U3)."""
    from clicktrail.functions import recode as RC

    d = SV.with_single_motivation(survey_in_el_df)
    single = d.where(F.col("`single motivation`").isNotNull())
    desktop, mobile = SV.host_slices(d)
    pairs = ST.pair_counts(SV.n_motivations(d, 2))
    return {
        "depth_by_host": ST.proportions(d, "information depth", "host"),  # A20
        "prior_by_host": ST.proportions(d, "prior knowledge", "host"),
        "n_motivations": ST.n_motivations_distribution(d),  # A14
        "single_motivation": ST.single_motivation_distribution(d),  # A15
        "single_motivation_by_host": ST.proportions(single, "single motivation", "host"),
        "mentions": ST.mention_counts(d, RC.MENTION_LEVELS).orderBy(F.desc("count"), "motivation"),  # A16, O5
        "pair_counts": pairs,  # A17
        "cooccurrence": ST.cooccurrence_matrix(pairs, RC.MENTION_LEVELS),  # U3, A18
        "pair_conditional": ST.pair_conditional(pairs),  # A19
        "prior_given_depth": ST.proportions(d, "information depth", "prior knowledge", normx=False),
        "depth_given_prior": ST.proportions(d, "prior knowledge", "information depth", normx=False),
        "prior_given_motivation": ST.proportions(single, "single motivation", "prior knowledge", normx=False),
        "depth_given_motivation": ST.proportions(single, "single motivation", "information depth", normx=False),
        "host_counts": ST.value_counts(d, "host"),
        "desktop_rows": desktop,
        "mobile_rows": mobile,
    }


def peek(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a fixed order (deterministic, unlike take on an unordered plan)."""
    return df.orderBy(*order).limit(n)
