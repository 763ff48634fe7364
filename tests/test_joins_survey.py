import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from clicktrail.functions import recode as RC
from clicktrail.operators import requests as R
from clicktrail.operators.asof import asof_click_request
from clicktrail.operators.joins import keep_unique, null_safe_join
from clicktrail.plans import jobs as P
from clicktrail.sources import adapters as A
from clicktrail.sources import tables as TB

T0 = dt.datetime(2024, 1, 1, 12)


def test_asof_ties_and_boundaries(spark):
    trace = [(0, "A"), (10, "A"), (10, "A"), (20, "B"), (30, "A")]
    clicks = [
        ("exact", "A", 30),  # a request at exactly the click time counts
        ("tie", "A", 15),  # equal ts: the lowest position wins
        ("none", "C", 99),
        ("early", "B", 19),
    ]
    at = lambda sec: T0 + dt.timedelta(seconds=sec)
    data = [(k, t, at(c), i, at(s), title) for k, t, c in clicks for i, (s, title) in enumerate(trace)]
    rows = spark.createDataFrame(data, "k string, click_title string, click_dt_utc timestamp, id int, ts timestamp, title string")
    out = asof_click_request(rows, ["k", "click_title", "click_dt_utc"], fields=("ts", "title"))
    got = {r.k: (r.click_request.id if r.click_request else None, r.time_to_click, r.n_requests) for r in out.collect()}
    assert got == {"exact": (4, 0.0, 5), "tie": (1, 5.0, 5), "none": (None, None, 5), "early": (None, None, 5)}


def test_null_safe_join(spark):
    left = spark.createDataFrame([("a", None, 1), (None, None, 2), ("b", "x", 3)], "k string, l string, v int")
    right = spark.createDataFrame([("a", None, 10), (None, None, 20), ("b", "y", 30)], "k string, l string, w int")
    assert rows(null_safe_join(left, right, ["k", "l"]), "v", "w") == [(1, 10), (2, 20)]
    assert rows(null_safe_join(left, right, ["k", "l"], "left_anti"), "v") == [(3,)]
    assert sorted(r.w or 0 for r in null_safe_join(left, right, ["k", "l"], "left").collect()) == [0, 10, 20]


def test_trace_rows_are_the_nested_traces_unnested(spark):
    sf = "/root/testdata/sf0.001"
    log, redirects = TB.request_log(spark, sf), TB.redirects(spark, sf)
    nested = P.build_merged_traces(log, redirects)
    want = nested.select("ip", "ua", F.posexplode("requests").alias("id", "r")).select("ip", "ua", "id", "r.ts", "r.title")
    got = P.numbered_trace_rows(log, redirects).select("ip", "ua", "id", "ts", "title")
    assert rows(got) == rows(want) and got.count() > 100


def test_keep_unique_drops_all_copies_and_nulls_are_equal(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,), ("c",)], "t string")
    assert rows(keep_unique(df, "t")) == [("b",), ("c",)]


def test_w2_then_w3_order(spark):
    df = spark.createDataFrame([("s1", "c1"), ("s1", "c2"), ("s2", "c2"), ("s3", "c3")], "s string, c string")
    assert rows(keep_unique(keep_unique(df, "s"), "c")) == [("s2", "c2"), ("s3", "c3")]


def test_recode_motivation_with_commas_in_text(spark):
    raw = ", ".join([A.A_DECISION, A.A_MEDIA, "something else", A.A_DECISION])
    df = spark.createDataFrame([(raw,), ("no_response",)], "m string")
    got = [r[0] for r in df.select(RC.recode_motivation(F.col("m"))).collect()]
    assert got == [["media", "other", "personal decision"], ["no response"]]


def test_null_strict_packing_and_cap(spark):
    base = dict(client_ip="1", user_agent="u", uri_host=A.DESKTOP_HOST, year=2024, month=1, day=1)
    def row(i, pv, referer="r"):
        return (base["client_ip"], base["user_agent"], T0 + dt.timedelta(seconds=i), referer, base["uri_host"], "/p", "",
                pv, "desktop", "internal", "P" if pv else None, 2024, 1, 1)
    schema = ("client_ip string, user_agent string, ts timestamp, referer string, uri_host string, uri_path string, "
              "uri_query string, is_pageview boolean, access_method string, referer_class string, title string, "
              "year int, month int, day int")
    data = [row(0, True), row(1, False), row(2, True, referer=None), row(3, True)]
    df = (spark.createDataFrame(data, schema)
          .withColumn("normalized_host", F.struct(F.lit("wikipedia").alias("project_class"), F.lit("en").alias("project")))
          .withColumn("geocoded_data", F.create_map(F.lit("timezone"), F.lit("UTC")))
          .withColumn("user_agent_map", F.create_map(F.lit("browser_family"), F.lit("X"))))
    packed = R.pack_request(df)
    for cap in (None, 5):
        kept = R.build_traces(packed, max_requests=cap).collect()
        assert len(kept) == 1 and len(kept[0].requests) == 2  # non-page view and NULL referer dropped from the list
    assert R.build_traces(packed, max_requests=4).count() == 0  # but all 4 rows count toward the cap


def test_split_redirect_join(spark):
    """95 % of the rows without a title, one title on a third of the others: same titles, and even tasks without adaptive execution."""

    n = 60_000
    page = (F.col("id") % 20) == 0
    third = (F.col("id") % 60) == 0
    log = spark.range(n).select(
        F.concat(F.lit("ip"), F.col("id") % 1000).alias("client_ip"),
        F.lit("ua").alias("user_agent"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.lit("/").alias("uri_path"),
        F.lit("").alias("uri_query"),
        page.alias("is_pageview"),
        F.when(page, F.when(third, "hot").otherwise(F.concat(F.lit("t"), F.col("id")))).alias("raw_title"),
    )
    redirects = spark.createDataFrame([("hot", "target"), ("t20", "other"), ("unused", "x")], "rd_from string, rd_to string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert R.heavy_titles(log).collect()[0][0] == "hot" and R.heavy_titles(log).count() == 1
        found = R.resolve_redirects(log, redirects, untitled=True, heavy=True)
        titled = R.resolve_redirects(log.where("raw_title is not null"), redirects, heavy=True)
        assert found.columns == [*log.columns, "title"]
        got = {r.title: r["count"] for r in found.groupBy("title").count().collect()}
        assert got[None] == n - n // 20 and got["target"] == n // 60 and got["other"] == 1 and sum(got.values()) == n
        tasks = sorted(r["count"] for r in titled.groupBy(F.spark_partition_id()).count().collect())
        assert len(tasks) == 4 and tasks[-1] <= 2 * tasks[len(tasks) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
