"""Request-log filters, redirect resolution, request packing and trace building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.functions.urls import url_decode

# The two wiki hosts whose traffic is traced.
TRACED_HOSTS = ("en.wikipedia.org", "en.m.wikipedia.org")

# Field order of a packed request, as in the trace text format.
REQUEST_FIELDS = (
    "ts",
    "referer",
    "title",
    "uri_path",
    "uri_query",
    "is_pageview",
    "access_method",
    "referer_class",
    "project",
    "lang",
)


def filter_traffic(
    df: DataFrame, hosts: Sequence[str] = TRACED_HOSTS, hour: int | None = None
) -> DataFrame:
    """Human web traffic on the traced hosts; ``hour=1`` reproduces the original single-hour sample."""
    cond = (
        (F.col("webrequest_source") == "text")
        & (F.col("agent_type") == "user")
        & (F.col("access_method") != "mobile app")
        & F.col("uri_host").isin(list(hosts))
    )
    if hour is not None:
        cond = cond & (F.col("hour") == hour)
    return df.where(cond)


def raw_title(df: DataFrame) -> DataFrame:
    """Page title of page views, NULL otherwise.

    The original spread non-page-view rows over random join keys to avoid a
    NULL-key hot spot in a shuffled join; here NULL is kept: ``trace_rows``
    drops those rows before the join, the nested table leads them round it.
    """
    return df.withColumn(
        "raw_title", F.when(F.col("is_pageview"), F.element_at(F.col("pageview_info"), F.lit("page_title")))
    )


def resolve_redirects(df: DataFrame, redirects: DataFrame, untitled: bool = False, heavy: bool = False) -> DataFrame:
    """J1 + P4: left join on the raw title; canonical title = redirect target, else raw title, NULL for non-page views.

    Rows without a title have nothing to look up. ``untitled=True`` leads them
    round the join by a union; without it they take part in it, so they
    should be dropped first (``trace_rows`` does). ``heavy=True`` also deals the
    rows of titles that many views share over several copies of their redirect
    rows (``heavy_titles``); without it only the adaptive skew join splits them.
    """
    r = redirects.select(F.col("rd_from"), F.col("rd_to"))
    if untitled:
        found = resolve_redirects(df.where("raw_title is not null"), redirects, heavy=heavy)
        return found.unionByName(df.where("raw_title is null").withColumn("title", F.lit(None).cast("string")))
    if heavy:
        often = F.broadcast(heavy_titles(df))  # at most HEAVY_TITLES rows
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1))
        r = r.join(often.withColumnRenamed("_often", "rd_from"), "rd_from", "left").select("rd_from", "rd_to", copies.alias("_copy"))
        rows = df.join(often, df["raw_title"] == often["_often"], "left").drop("_often")
        place = F.xxhash64("client_ip", "user_agent", "ts", "uri_path", "uri_query")
        rows = rows.withColumn("_row", F.pmod(place, F.coalesce(F.col("_copies"), F.lit(1)).cast("bigint")).cast("int"))
        joined = rows.join(r, (F.col("raw_title") == F.col("rd_from")) & (F.col("_row") == F.col("_copy")), "left").drop("_copies", "_row", "_copy")
    else:
        joined = df.join(r, df["raw_title"] == r["rd_from"], "left")
    title = F.when(~F.col("is_pageview"), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.col("rd_to"), F.col("raw_title"))
    )
    return joined.withColumn("title", title).drop("rd_from", "rd_to")


HEAVY_TITLES = 1000  # titles that a summary may report
SHARE = 500  # a title with more than one row in SHARE is heavy; each copy of its redirect rows meets about one row in SHARE


def heavy_titles(df: DataFrame) -> DataFrame:
    """``_often, _copies``: the titles that hold more than one row in ``SHARE``, by a frequent-items summary of fixed size.

    The summary (ten counters for each title that it may report) overestimates by less than one row in 3,000; a title
    taken for heavy without need costs a few copies of its redirect rows, never a result.
    """
    summary = df.where("raw_title is not null").agg(
        F.expr(f"approx_top_k(raw_title, {HEAVY_TITLES}, {10 * HEAVY_TITLES})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    each = summary.select("n", F.explode("top").alias("x")).where(F.col("x.count") * SHARE > F.col("n"))
    return each.select(F.col("x.item").alias("_often"), F.ceil(F.col("x.count") * SHARE / F.col("n")).cast("int").alias("_copies"))


def pack_request(df: DataFrame, decode: bool = True) -> DataFrame:
    """P5: request struct; NULL when any field is NULL (like the original CONCAT), so collect_list drops it."""
    fields = {
        "ts": F.col("ts"),
        "referer": F.col("referer"),
        "title": F.col("title"),
        "uri_path": url_decode(F.col("uri_path")) if decode else F.col("uri_path"),
        "uri_query": url_decode(F.col("uri_query")) if decode else F.col("uri_query"),
        "is_pageview": F.col("is_pageview"),
        "access_method": F.col("access_method"),
        "referer_class": F.col("referer_class"),
        "project": F.col("normalized_host.project_class"),
        "lang": F.col("normalized_host.project"),
    }
    complete = None
    for c in fields.values():
        complete = c.isNotNull() if complete is None else complete & c.isNotNull()
    packed = F.when(complete, F.struct(*[c.alias(n) for n, c in fields.items()]))
    return df.withColumn("request", packed)


def _entries(c: str) -> Column:
    """A map's sorted entries: unlike the map, they can be grouped and joined on."""
    return F.array_sort(F.map_entries(F.col(c)))


def trace_key(ip: str = "ip", ua: str = "ua") -> Column:
    """What makes requests one trace: address, agent and both maps, as one key (never NULL)."""
    return F.struct(
        F.col(ip).alias("ip"),
        F.col(ua).alias("ua"),
        _entries("geocoded_data").alias("geo"),
        _entries("user_agent_map").alias("agent"),
    )


def trace_rows(
    log: DataFrame, redirects: DataFrame, hosts: Sequence[str] = TRACED_HOSTS, hour: int | None = None
) -> DataFrame:
    """P1 -> P3 -> J1 -> P4 -> P5: the complete requests of all traces, one row each, with their ``trace`` key.

    This is the trace table (A1, A3) unnested: a client's history is as many
    rows as it has requests and is never gathered. Rows that the NULL-strict
    packing would drop anyway, non-page views first of all, are dropped before
    the redirect join. ``number_requests`` gives the position in the trace.
    """
    r = raw_title(filter_traffic(log, hosts, hour)).where("raw_title is not null")
    r = pack_request(resolve_redirects(r, redirects)).where("request is not null")
    return r.select(
        trace_key("client_ip", "user_agent").alias("trace"),
        F.col("client_ip").alias("ip"),
        F.col("user_agent").alias("ua"),
        "geocoded_data",
        "user_agent_map",
        F.col("uri_host").alias("host"),
        "year",
        "month",
        "day",
        "request.*",
    )


#: order of requests in a trace; rows equal in all of these are interchangeable
TRACE_ORDER = ("ts", "referer", "title", "uri_path", "uri_query", "access_method", "referer_class")


def drop_heavy(df: DataFrame, max_requests: int) -> DataFrame:
    """A2: drops all rows of a client, day and host with ``max_requests`` or more rows, page views or not.

    Rows are counted with partial aggregates; what is dropped is found before
    any row is gathered.
    """
    keys = ["client_ip", "user_agent", "uri_host", "year", "month", "day"]
    keyed = df.withColumn("_t", F.struct(trace_key("client_ip", "user_agent").alias("t"), *keys[2:]))
    heavy = keyed.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max_requests)
    return keyed.join(heavy.select("_t"), "_t", "left_anti").drop("_t")


def build_traces(df: DataFrame, max_requests: int | None = None) -> DataFrame:
    """A1 (+ A2 when ``max_requests`` is given), nested: one trace per client, day and host, for the table writers.

    ``df`` has packed requests (P5). An array holds one client's day on one
    host; a client without a complete request keeps an empty one. Requests are
    sorted by (ts, other fields), which fixes the order of ties.
    """
    if max_requests is not None:
        df = drop_heavy(df, max_requests)
    traces = df.groupBy(trace_key("client_ip", "user_agent").alias("t"), "uri_host", "year", "month", "day").agg(
        F.first("geocoded_data").alias("geocoded_data"),
        F.first("user_agent_map").alias("user_agent_map"),
        F.sort_array(F.collect_list("request")).alias("requests"),
    )
    return traces.select(
        F.col("t.ip").alias("ip"),
        F.col("t.ua").alias("ua"),
        "geocoded_data",
        "user_agent_map",
        "requests",
        "year",
        "month",
        "day",
        F.col("uri_host").alias("host"),
    )


def merge_traces(traces_by_day: DataFrame, year: int | None = None, drop_empty: bool = True) -> DataFrame:
    """A3, nested: a client's day/host traces as one trace sorted by time, for the merged-table writer.

    The array holds a client's whole history; operators work on ``trace_rows``
    instead. ``year`` restricts the merged partitions (the original fixed it to
    2016). Clients without a single complete request are dropped, as the text
    round trip of the original drops them (S7).
    """
    t = traces_by_day if year is None else traces_by_day.where(F.col("year") == year)
    merged = t.groupBy(trace_key().alias("t")).agg(
        F.first("geocoded_data").alias("geocoded_data"),
        F.first("user_agent_map").alias("user_agent_map"),
        F.sort_array(F.flatten(F.collect_list("requests"))).alias("requests"),
    )
    merged = merged.select(F.col("t.ip").alias("ip"), F.col("t.ua").alias("ua"), "geocoded_data", "user_agent_map", "requests")
    return merged.where(F.size("requests") > 0) if drop_empty else merged


def chunk_traces(rows: DataFrame, size: int = 1000) -> DataFrame:
    """A3, in chunks: numbered trace rows as ``ip, ua, geocoded_data, user_agent_map, chunk, requests``.

    Chunk c holds the requests at positions c * ``size`` to (c + 1) * ``size`` - 1
    of a trace in time order, so no array is longer than ``size`` and a client
    with a third of all requests is many rows. The chunks of a trace in order,
    put together, are the array of ``merge_traces``.
    """
    keyed = rows.withColumn("chunk", F.floor(F.col("id") / F.lit(size)).cast("bigint"))
    gathered = keyed.groupBy("trace", "chunk").agg(
        F.first("geocoded_data").alias("geocoded_data"),
        F.first("user_agent_map").alias("user_agent_map"),
        F.sort_array(F.collect_list(F.struct("id", F.struct(*REQUEST_FIELDS).alias("request")))).alias("placed"),
    )
    requests = F.transform("placed", lambda x: x["request"]).alias("requests")
    return gathered.select(F.col("trace.ip").alias("ip"), F.col("trace.ua").alias("ua"), "geocoded_data", "user_agent_map", "chunk", requests)


def unchunk_traces(chunks: DataFrame, size: int = 1000) -> DataFrame:
    """The rows of a chunked trace table, each with its position ``id`` in its trace; ``size`` is that of the writer."""
    placed = chunks.select("ip", "ua", "geocoded_data", "user_agent_map", "chunk", F.posexplode("requests").alias("at", "request"))
    return placed.select("ip", "ua", "geocoded_data", "user_agent_map", (F.col("chunk") * size + F.col("at")).alias("id"), "request.*")


def sort_trace(requests: Column) -> Column:
    """O1: sort an array of request structs by ts, ties by the remaining fields."""
    return F.array_sort(requests)
