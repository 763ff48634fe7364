"""Plan checks: partition pruning, filter pushdown and column pruning reach the parquet scan."""

from clicktrail.operators import requests as R
from clicktrail.sources import io as IO
from clicktrail.sources import tables as T

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_request_scan_prunes_and_pushes(spark, tmp_path):
    path = str(tmp_path / "webrequest")
    T.flat_request_log(spark, SF).write.partitionBy("year", "month", "day").parquet(path)
    log = IO.read_requests(spark, path, "2024-01-03", "2024-01-04")
    q = R.filter_traffic(log).select("client_ip", "ts")
    plan = _plan(q)
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1][:400]
    pushed = plan.split("PushedFilters")[1][:600]
    for col in ("webrequest_source", "agent_type", "access_method", "uri_host"):
        assert col in pushed, col
    read_schema = plan.split("ReadSchema")[1][:400]
    assert "referer" not in read_schema and "client_ip" in read_schema
    assert q.count() == T.flat_request_log(spark, SF).where("day in (3, 4)").transform(R.filter_traffic).count()


def test_session_metrics_plan_has_no_python(spark):
    from clicktrail.operators.sessions import session_metrics

    plan = _plan(session_metrics(R.filter_traffic(T.request_log(spark, SF)), gap_minutes=60))
    assert "Python" not in plan and "ArrowEval" not in plan


def test_scale_conf():
    from clicktrail.session import scale_conf

    c = scale_conf(100e12, 4000)
    assert 100_000 < int(c["spark.sql.shuffle.partitions"]) < 130_000
    assert scale_conf(1e6, 8)["spark.sql.shuffle.partitions"] == "16"
