import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from clicktrail.functions import textparse as TP
from clicktrail.functions import urls as U
from clicktrail.functions.privacy import hmac_sha1


def _one(spark, col_expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr.alias("x")).first().x


def test_map_text(spark):
    s = "a\x031\x02b\x02a\x033\x02c\x03x\x03y"
    got = _one(spark, TP.parse_map_text(F.col("v")), s)
    assert got == {"a": "3", "c": "x"}  # entry without 0x03 skipped, last key wins, cut at second 0x03


def test_request_list(spark):
    reqs = "REQUEST_DELIM".join(
        [
            "ts|2024-01-01 10:00:02|title|B",
            "ts|2024-01-01 10:00:01|title|A|B",  # '|' inside a value: odd count, dropped
            "title|no ts",  # no ts: dropped
            "ts|2024-01-01 10:00:00|title|A|title|A2",  # repeated name: last wins
        ]
    )
    got = _one(spark, TP.parse_request_maps(F.col("v")), reqs)
    assert [(m["ts"], m["title"]) for m in got] == [("2024-01-01 10:00:00", "A2"), ("2024-01-01 10:00:02", "B")]


def test_trace_lines_roundtrip_and_short_rows(spark):
    line_ok = "1.2.3.4\tua\ttimezone\x03UTC\tbrowser\x03X\tts|2024-01-01 10:00:00|title|T|is_pageview|true"
    line_short = "1.2.3.4\tua\ttimezone\x03UTC\tbrowser\x03X\t"  # trailing tab stripped -> 4 fields
    df = spark.createDataFrame([(line_ok,), (line_short,)], "value string")
    out = TP.parse_trace_lines(df).collect()
    assert len(out) == 1 and out[0].geo_data == {"timezone": "UTC"}
    r = out[0].requests[0]
    assert r.title == "T" and r.is_pageview is True and r.ts is not None


def test_legacy(spark):
    got = _one(spark, TP.parse_legacy_requests(F.col("v")), "t2|r|p2||t1|r|p1||bad|x")
    assert [(x["t"], x["p"]) for x in got] == [("t1", "p1"), ("t2", "p2")]


@pytest.mark.parametrize(
    "key,msg",
    [
        ("\x0b" * 20, "Hi There"),
        ("Jefe", "what do ya want for nothing?"),
        ("k" * 100, "10.0.0.1"),  # longer than one block: hashed first
        ("clé", "192.168.0.1"),
    ],
)
def test_hmac_matches_python(spark, key, msg):
    want = hmac.new(key.encode(), msg.encode(), hashlib.sha1).hexdigest()
    assert _one(spark, hmac_sha1(F.col("v"), key), msg) == want


def test_hmac_rfc2202_case2(spark):
    assert _one(spark, hmac_sha1(F.col("v"), "Jefe"), "what do ya want for nothing?") == (
        "effcdf6ae5eb2fa2d27416d5f184df9c259a7c79"
    )


@pytest.mark.parametrize(
    "path,query,want",
    [
        ("/wiki/A", "", "/wiki/A/"),
        ("/wiki/A/", "", "/wiki/A/"),
        ("/wiki/A", "x=1", "/wiki/A/x=1"),
        ("", "x", "x"),
        ("/wiki/A", "/abs", "/abs"),
        ("", "", ""),
        ("/a/", "b", "/a/b"),
        ("a", "b", "a/b"),
    ],
)
def test_page_key_like_path_join(spark, path, query, want):
    df = spark.createDataFrame([(path, query)], "p string, q string")
    assert df.select(U.page_key(F.col("p"), F.col("q"))).first()[0] == want


@pytest.mark.parametrize(
    "ref,want",
    [
        ("https://en.wikipedia.org/wiki/A", "/wiki/A/"),
        ("https://en.wikipedia.org/wiki/A?x=1#frag", "/wiki/A/x=1"),
        ("https://en.wikipedia.org/wiki/A;p=1", "/wiki/A/"),
        ("-", "-/"),
    ],
)
def test_referer_key(spark, ref, want):
    assert _one(spark, U.referer_key(F.col("v")), ref) == want


def test_url_decode_malformed_is_null(spark):
    assert _one(spark, U.url_decode(F.col("v")), "a%2") is None
    assert _one(spark, U.url_decode(F.col("v")), "a%20b+c") == "a b c"
