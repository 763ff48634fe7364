"""Smoke tests for helpers not exercised by the registered queries."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from clicktrail.functions import keys as K
from clicktrail.functions import recode as RC
from clicktrail.operators import requests as R
from clicktrail.operators import sessions as S
from clicktrail.operators import survey as SV
from clicktrail.plans import jobs
from clicktrail.sources import io as IO

T0 = dt.datetime(2024, 1, 1)


def test_request_helpers(spark):
    df = spark.createDataFrame(
        [("c", T0, 2024, 1, 3), ("c", T0 + dt.timedelta(seconds=5), 2024, 1, 9)],
        "client_ip string, ts timestamp, year int, month int, day int",
    )
    assert df.where(IO.day_span("2024-01-01", "2024-01-05")).count() == 1
    numbered = S.number_requests(df, ["client_ip"], ["ts"])
    assert rows(numbered, "id") == [(0,), (1,)]
    arr = df.groupBy("client_ip").agg(F.collect_list(F.struct("ts", "day")).alias("r"))
    assert [x.day for x in arr.select(R.sort_trace(F.col("r")).alias("s")).first().s] == [3, 9]
    secs = df.agg(K.seconds_between(F.max("ts"), F.min("ts")).alias("d")).first().d
    assert secs == 5.0
    assert [r.day for r in jobs.peek(df, 1, ["day"]).collect()] == [3]


def test_survey_helpers(spark):
    df = spark.createDataFrame(
        [("mobile", "fact", ["media"], 10.0), ("desktop", "no response", ["media", "other"], 99999.0)],
        "host string, `information depth` string, motivation array<string>, time_to_click double",
    )
    assert SV.drop_no_response(df, ["information depth"]).count() == 1
    assert SV.within(df, 3600).count() == 1
    assert SV.n_motivations(df, 2).count() == 1
    desktop, mobile = SV.host_slices(df)
    assert (desktop.count(), mobile.count()) == (1, 1)
    single = SV.with_single_motivation(df).select("`single motivation`").collect()
    assert sorted(str(r[0]) for r in single) == ["None", "media"]
    lab = df.select(RC.pair_label(F.col("motivation")), RC.pair_label(F.col("motivation"), reverse=True)).collect()
    assert lab[1][0] == "media|other" and lab[1][1] == "other|media"
    lv = RC.with_levels(df.select(F.col("`information depth`").alias("Information_Need")), "Information_Need",
                        RC.APP_LEVELS["Information_Need"], ordinal_col="ord").collect()
    assert sorted((r.Information_Need, r.ord) for r in lv if r.ord) == [("fact", 1)]
    assert df.select(K.partition_name(F.lit(dt.date(2016, 3, 1)), F.lit("en.wikipedia.org"))).first()[0] == (
        "year=2016/month=3/day=1/host=en.wikipedia.org"
    )
