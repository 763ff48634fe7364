"""The driver's correctness gate, locally: every registered query against its DuckDB oracle."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    from compare import duck_conn

    if not Path(SF).exists():
        pytest.skip("driver tables not present")
    return duck_conn(SF)


def _names():
    import __spark_entry__ as E

    E.load_all()
    return sorted(E.SPARK_QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from compare import compare

    res = compare(spark, duck, name, E.queries()[name], E.oracle_sql().get(name), SF)
    if res.get("check") == "rows-only":
        assert res["spark_rows"] >= 0
    else:
        assert res["cols_match"] and res["values_match"], res
        assert not res["type_diffs"], res["type_diffs"]


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and "session_length" in df.columns


def test_every_query_has_an_oracle():
    import __spark_entry__ as E

    E.load_all()
    q = E.SPARK_QUERIES
    assert set(E.ORACLES) == set(q) and len(q) >= 60 and set(q) <= set(E.queries())


def test_flagship_schema_is_stable(spark):
    import __spark_entry__ as E

    a = E.queries()["session_metrics"](spark, "/root/testdata/sf0.001").schema
    b = E.queries()["session_metrics"](spark, "/root/testdata/sf0.01").schema
    assert a == b == E.entry(spark).schema
