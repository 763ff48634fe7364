import datetime as dt

import pytest
from pyspark.sql import functions as F

from clicktrail.sources import io as IO

T0 = dt.datetime(2024, 1, 1, 10)


def _traces(spark, day, n):
    data = [(f"ip{i}", "ua", {"timezone": "UTC"}, {"b": "x"}, 2024, 1, day, "en.wikipedia.org") for i in range(n)]
    return spark.createDataFrame(
        data,
        "ip string, ua string, geocoded_data map<string,string>, user_agent_map map<string,string>, "
        "year int, month int, day int, host string",
    )


def test_overwrite_day_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "traces")
    IO.write_traces(_traces(spark, 1, 3), path)
    IO.overwrite_day(_traces(spark, 2, 2), path)
    IO.overwrite_day(_traces(spark, 2, 2), path)  # rerun of day 2 replaces it
    back = spark.read.parquet(path)
    assert back.where("day = 1").count() == 3 and back.where("day = 2").count() == 2
    assert IO.read_partition(spark, path, "2024-01-02", "en.wikipedia.org").count() == 2
    assert IO.read_span(spark, path, "2024-01-01", "2024-01-02").count() == 5


def test_overwrite_day_drops_emptied_partitions(spark, tmp_path):
    path = str(tmp_path / "traces")
    other = F.lit("en.m.wikipedia.org")
    IO.write_traces(_traces(spark, 1, 3).unionByName(_traces(spark, 1, 2).withColumn("host", other)).unionByName(_traces(spark, 2, 1)), path)
    IO.overwrite_day(_traces(spark, 1, 1), path, [(2024, 1, 1)])  # the rebuilt day has no mobile rows any more
    back = {(r.day, r.host): r.n for r in spark.read.parquet(path).groupBy("day", "host").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert back == {(1, "en.wikipedia.org"): 1, (2, "en.wikipedia.org"): 1}
    IO.overwrite_day(_traces(spark, 3, 0), path, [(2024, 1, 2)])  # nothing is left of day 2
    assert {r.day for r in spark.read.parquet(path).select("day").distinct().collect()} == {1}


def _state(spark, path):
    return {(r.day, r.host): r.n for r in spark.read.parquet(path).groupBy("day", "host").agg(F.count(F.lit(1)).alias("n")).collect()}


def _two_hosts(spark, path):
    other = F.lit("en.m.wikipedia.org")
    IO.write_traces(_traces(spark, 1, 3).unionByName(_traces(spark, 1, 2).withColumn("host", other)).unionByName(_traces(spark, 2, 1)), path)


@pytest.mark.parametrize("after", range(4))
def test_overwrite_day_interrupted_while_swapping(spark, tmp_path, monkeypatch, after):
    """A writer that dies after its manifest (at any later step) is completed by whoever writes next."""
    path = str(tmp_path / "traces")
    _two_hosts(spark, path)
    steps = {"n": 0}

    def dying(real):
        def step(*args):
            if "manifest-open" not in args[1]:
                steps["n"] += 1
                if steps["n"] > after:
                    raise OSError("lost")
            return real(*args)

        return step

    new = _traces(spark, 1, 4).unionByName(_traces(spark, 3, 2))
    with monkeypatch.context() as m:
        m.setattr(IO, "rename", dying(IO.rename))
        m.setattr(IO, "drop", dying(IO.drop))
        with pytest.raises(OSError):
            IO.overwrite_day(new, path, [(2024, 1, 1), (2024, 1, 3)])
    IO.finish_overwrites(spark, path)
    assert _state(spark, path) == {(1, "en.wikipedia.org"): 4, (2, "en.wikipedia.org"): 1, (3, "en.wikipedia.org"): 2}
    assert IO.children(spark, f"{path}/{IO.STAGED}") == []


def test_overwrite_day_interrupted_before_manifest(spark, tmp_path, monkeypatch):
    """Without a manifest nothing has happened: the table is the old one, and what was staged goes with the next write."""
    path = str(tmp_path / "traces")
    _two_hosts(spark, path)
    before = _state(spark, path)

    def lost(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(IO, "rename", lost)
        with pytest.raises(OSError):
            IO.overwrite_day(_traces(spark, 1, 4), path, [(2024, 1, 1)])
    assert _state(spark, path) == before and len(IO.children(spark, f"{path}/{IO.STAGED}")) == 1
    IO.overwrite_day(_traces(spark, 2, 2), path, [(2024, 1, 2)])
    assert _state(spark, path) == before | {(2, "en.wikipedia.org"): 2}
    assert IO.children(spark, f"{path}/{IO.STAGED}") == []


def test_overwrite_day_runs_its_input_once(spark, tmp_path):
    path = str(tmp_path / "traces")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = _traces(spark, 1, 5)
    IO.overwrite_day(df.mapInArrow(counted, df.schema), path, [(2024, 1, 1)])
    assert seen.value == 5 and _state(spark, path) == {(1, "en.wikipedia.org"): 5}


def test_span_lists_its_own_folders(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    days = [(2023, 12, 31), (2024, 1, 1), (2024, 1, 2), (2024, 1, 30), (2024, 2, 1), (2024, 2, 2), (2024, 3, 1), (2025, 1, 1)]
    rows = spark.createDataFrame([(i, *d) for i, d in enumerate(days)], "id long, year int, month int, day int")
    rows.write.partitionBy("year", "month", "day").parquet(path)
    listed = []
    real = IO.children
    monkeypatch.setattr(IO, "children", lambda s, f: listed.append(f[len(path) :]) or real(s, f))
    got = IO.read_requests(spark, path, "2024-01-02", "2024-02-01")
    assert listed == ["", "/year=2024", "/year=2024/month=1", "/year=2024/month=2"]
    assert sorted(r.id for r in got.collect()) == [2, 3, 4]
    assert len(got.inputFiles()) == 3 and got.columns == ["id", "year", "month", "day"]
    assert IO.read_span(spark, path, "2024-12-01", "2024-12-31").count() == 0
    assert sorted(r.id for r in IO.read_span(spark, path, "2023-12-31", "2024-01-01", got.schema).collect()) == [0, 1]


def test_chunked_traces(spark, tmp_path):
    """No array is longer than the chunk; the chunks in order are the nested trace; one client holds most requests."""
    from clicktrail.operators import requests as R

    data = [(c, "ua", i, T0 + dt.timedelta(seconds=i)) for c, n in (("hot", 2500), ("cold", 3), (None, 5)) for i in range(n)]
    rows = spark.createDataFrame(data, "ip string, ua string, id long, ts timestamp")
    text = [F.col("id").cast("string").alias(f) for f in R.REQUEST_FIELDS if f not in ("ts", "is_pageview")]
    none = F.create_map(F.lit("a"), F.lit("b"))
    rows = rows.select("*", *text, F.lit(True).alias("is_pageview"), none.alias("geocoded_data"), none.alias("user_agent_map")).withColumn("trace", F.struct("ip", "ua"))
    path = str(tmp_path / "chunks")
    IO.write_merged_chunks(R.chunk_traces(rows, 100), path)
    back = spark.read.parquet(path)
    sizes = {(r.ip, r.chunk): r.n for r in back.select("ip", "chunk", F.size("requests").alias("n")).collect()}
    assert sizes == {("hot", c): 100 for c in range(25)} | {("cold", 0): 3, (None, 0): 5}
    got = sorted((r.ip or "", r.id, r.ts, r.title) for r in R.unchunk_traces(back, 100).collect())
    assert got == sorted((c or "", i, t, str(i)) for c, _, i, t in data)
    with pytest.raises(Exception):
        IO.write_merged_chunks(R.chunk_traces(rows, 100), path)


def test_write_merged_fails_when_present(spark, tmp_path):
    path = str(tmp_path / "merged")
    IO.write_merged(_traces(spark, 1, 1), path)
    with pytest.raises(Exception):
        IO.write_merged(_traces(spark, 1, 1), path)


def test_hashed_json_keeps_microseconds_and_drops_incomplete(spark, tmp_path):
    path = str(tmp_path / "hashed")
    req = (T0.replace(microsecond=123456), "r", "t", "/p", "", True, "desktop", "internal", "wikipedia", "en")
    df = spark.createDataFrame([("h1", "ua", {"a": "1"}, {"b": "2"}, [req]), ("h2", None, {}, {}, [])], IO.TRACE_SCHEMA)
    IO.write_hashed(df, path)
    back = IO.read_hashed(spark, path).collect()
    assert len(back) == 1 and back[0].requests[0].ts == T0.replace(microsecond=123456)


def test_tsv_nested_roundtrip(spark, tmp_path):
    path = str(tmp_path / "tsv")
    df = spark.createDataFrame(
        [("a", T0, ["x", "y"], {"k": "v"})], "token string, ts timestamp, m array<string>, g map<string,string>"
    )
    IO.write_tsv(df, path)
    back = IO.load_tsv_nested(spark, path, df.schema)
    assert back.collect() == df.collect()
    rt = IO.roundtrip_counts(df, back).first()
    assert (rt.written, rt.read_back) == (1, 1)


def test_text_trace_table_roundtrip(spark, tmp_path):
    path = str(tmp_path / "text")
    req = (T0, "r", "t", "/p", "", True, "desktop", "internal", "wikipedia", "en")
    df = spark.createDataFrame(
        [("ip", "ua", {"tz": "UTC"}, {"b": "x"}, [req])],
        "ip string, ua string, geocoded_data map<string,string>, user_agent_map map<string,string>, "
        "requests array<struct<ts:timestamp,referer:string,title:string,uri_path:string,uri_query:string,"
        "is_pageview:boolean,access_method:string,referer_class:string,project:string,lang:string>>",
    )
    IO.write_trace_text(df, path)
    back = IO.read_trace_text(spark, path).first()
    assert back.ip == "ip" and back.geo_data == {"tz": "UTC"} and back.requests[0].ts == T0


def test_working_tables_are_swept(spark):
    from clicktrail.sources import work

    folder = work.work_folder(spark, "t")
    assert work.stored(spark.range(3), f"{folder}/x").count() == 3 and work.children(spark, folder) == ["x"]
    work.sweep(spark)
    assert not work.exists(spark, folder)


def test_day_range(spark):
    days = [r.day for r in IO.day_range(spark, "2016-02-28", "2016-03-01").collect()]
    assert [d.isoformat() for d in days] == ["2016-02-28", "2016-02-29", "2016-03-01"]


def test_load_sample_drops_bad_and_empty(spark):
    req_ok = (T0, "r", "t", "/p", "", True, "desktop", "internal", "wikipedia", "en")
    req_bad = (None, "r", "t", "/p", "", True, "desktop", "internal", "wikipedia", "en")
    df = spark.createDataFrame([("a", "u", {}, {}, [req_ok, req_bad]), ("b", "u", {}, {}, [req_bad])], IO.TRACE_SCHEMA)
    out = IO.load_sample(df).collect()
    assert len(out) == 1 and len(out[0].trace_data) == 1 and "ip" not in out[0].asDict()


def test_snapshot_requests(spark, tmp_path):
    from clicktrail.sources import tables as T

    path = str(tmp_path / "snap")
    log = T.flat_request_log(spark, "/root/testdata/sf0.001")
    IO.snapshot_requests(log, [1, 2, 3], path)
    back = spark.read.parquet(path)
    assert back.count() == log.where("day in (1, 2, 3)").count()
    with pytest.raises(Exception):
        IO.snapshot_requests(log, [1], path)  # a second CREATE TABLE AS fails


def test_survey_tsv_source_matches_table(spark, tmp_path):
    """The raw form export as TSV (question texts as headers) reads back to the same cleaned answers."""
    from pyspark.sql import types as T2

    from clicktrail.operators.survey import clean_responses
    from clicktrail.sources import tables as T

    raw = T.raw_survey(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "raw.tsv")
    raw.coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    schema = T2.StructType([T2.StructField(c, T2.StringType()) for c in raw.columns])
    back = IO.read_survey_tsv(spark, path, schema)
    a = clean_responses(raw, "2024-01-03 00:00:00").drop("motivation")
    b = clean_responses(back, "2024-01-03 00:00:00").drop("motivation")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_read_event_log(spark, tmp_path):
    from clicktrail.sources import tables as T

    path = str(tmp_path / "el")
    T.responses_log(spark, "/root/testdata/sf0.001").write.parquet(path)
    assert IO.read_event_log(spark, path).count() == T.responses_log(spark, "/root/testdata/sf0.001").count()
