import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from clicktrail.operators import sessions as S

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _df(spark, events):
    data = [(c, "ua", i, T0 + dt.timedelta(seconds=s), pv, rc) for i, (c, s, pv, rc) in enumerate(events)]
    return spark.createDataFrame(
        data, "client_ip string, user_agent string, req_id long, ts timestamp, is_pageview boolean, referer_class string"
    )


def _py_sessionize(times, gap_s):
    """Straight loop: a new session after a gap strictly over gap_s."""
    out, sid, prev = [], 0, None
    for t in sorted(times):
        if prev is not None and (t - prev) > gap_s:
            sid += 1
        out.append(sid)
        prev = t
    return out


def test_gap_boundary(spark):
    # 0, +60 min (kept), +60 min + 1 s (split), single far request
    ev = [("a", 0, True, "internal"), ("a", 3600, True, "internal"), ("a", 7201, True, "internal"),
          ("b", 50, False, "external (search engine)")]
    out = S.sessionize(_df(spark, ev), gap_minutes=60)
    assert rows(out, "client_ip", "req_id", "session_id") == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("b", 3, 0)]


def test_metrics(spark):
    ev = [("a", 0, True, "internal"), ("a", 90, False, "external (search engine)"), ("a", 10_000, True, "internal")]
    m = S.session_metrics(_df(spark, ev), gap_minutes=60)
    got = rows(m, "session_id", "n_requests", "num_pageviews", "session_length", "external_searches")
    assert got == [(0, 2, 1, 1.5, 1), (1, 1, 1, 0.0, 0)]


def test_equal_timestamps_same_session(spark):
    ev = [("a", 0, True, "x"), ("a", 0, True, "x"), ("a", 0, True, "x")]
    out = S.sessionize(_df(spark, ev), gap_minutes=1)
    assert {r.session_id for r in out.collect()} == {0}


def test_random_against_loop(spark):
    rng = random.Random(7)
    ev, expect = [], {}
    for c in "abcd":
        times = sorted(rng.sample(range(0, 50_000), 60)) + [50_000 + 3600]  # includes exact-gap cases
        for t in times:
            ev.append((c, t, True, "internal"))
        for t, s in zip(sorted(times), _py_sessionize(times, 3600)):
            expect.setdefault(c, []).append(s)
    out = S.sessionize(_df(spark, ev), gap_minutes=60).orderBy("client_ip", "ts", "req_id").collect()
    got = {}
    for r in out:
        got.setdefault(r.client_ip, []).append(r.session_id)
    assert got == expect


def test_session_metrics_agree_with_row_sessions(spark):
    rng = random.Random(3)
    ev = [(rng.choice("xyz"), rng.randrange(0, 200_000), rng.random() < 0.7, rng.choice(["internal", "external (search engine)"]))
          for _ in range(400)]
    df = _df(spark, ev)
    a = S.session_metrics(df, gap_minutes=30)
    s = S.sessionize(df, gap_minutes=30)
    b = s.groupBy("client_ip", "user_agent", "session_id").agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if("is_pageview").alias("num_pageviews")
    )
    assert rows(a, "client_ip", "session_id", "n_requests", "num_pageviews") == rows(
        b, "client_ip", "session_id", "n_requests", "num_pageviews"
    )


def test_pick_session_is_deterministic(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "client_ip string, session_id int")
    p1 = rows(S.pick_session(df, ["client_ip"], "seed"))
    p2 = rows(S.pick_session(df.repartition(3), ["client_ip"], "seed"))
    assert p1 == p2 and len(p1) == 2


def test_agrees_with_session_window(spark):
    """Two implementations: our bucketed sessions vs Spark's session_window (no gap exactly at the boundary)."""
    rng = random.Random(19)
    ev = []
    for c in "pqr":
        t = 0
        for _ in range(80):
            t += rng.choice([rng.randrange(1, 3000), rng.randrange(3700, 20000)])
            ev.append((c, t, True, "internal"))
    df = _df(spark, ev)
    ours = S.sessionize(df, gap_minutes=60).groupBy("client_ip").agg(F.countDistinct("session_id").alias("n"))
    theirs = df.groupBy("client_ip", F.session_window("ts", "60 minutes")).count().groupBy("client_ip").count()
    assert rows(ours) == rows(theirs)


def test_hot_client_sessions_and_plan(spark):
    """One client holds a third of all rows: results stay exact and the window sees only bucket rows."""
    rng = random.Random(99)
    ev, times = [], {}
    for c in ["hot"] * 600 + [f"c{i}" for i in range(60) for _ in range(20)]:
        t = times.get(c, 0) + rng.choice([rng.randrange(1, 1200), rng.randrange(3700, 30000)])
        times[c] = t
        ev.append((c, t, True, "internal"))
    df = _df(spark, ev)
    out = S.sessionize(df, gap_minutes=60).orderBy("client_ip", "ts", "req_id").collect()
    by_client = {}
    for r in out:
        by_client.setdefault(r.client_ip, []).append(r.session_id)
    want = {}
    for c, t, _, _ in ev:
        want.setdefault(c, []).append(t)
    assert by_client == {c: _py_sessionize(ts, 3600) for c, ts in want.items()}
    plan = S.session_metrics(df, gap_minutes=60)._jdf.queryExecution().executedPlan().toString()
    window_input = plan.split("Window", 1)[1]
    # below the window: the per-(client, bucket) aggregate, then the row scan
    agg, scan = window_input.find("HashAggregate"), window_input.find("Scan")
    assert 0 <= agg < scan


def test_null_timestamps_get_no_session(spark):
    data = [("a", 0, T0), ("a", 1, None), ("a", 2, T0 + dt.timedelta(hours=3))]
    df = spark.createDataFrame(
        [(c, "ua", i, t, True, "internal") for c, i, t in data],
        "client_ip string, user_agent string, req_id long, ts timestamp, is_pageview boolean, referer_class string",
    )
    got = {r.req_id: r.session_id for r in S.sessionize(df, gap_minutes=60).collect()}
    assert got == {0: 0, 1: None, 2: 1}
    assert S.session_metrics(df, gap_minutes=60).count() == 2
