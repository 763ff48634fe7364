"""Trace text format: Hive map text (F2), request lists (F3), the legacy request list (F4), and the writer.

A trace table row in text form is five tab-separated fields: ip, user agent,
geo map, agent map, requests. Map entries are joined by 0x02, key and value
by 0x03; requests are joined by ``REQUEST_DELIM`` and each is a
``name|value|name|value...`` list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the text format.
ENTRY_SEP = "\x02"
KV_SEP = "\x03"
REQUEST_DELIM = "REQUEST_DELIM"
LEGACY_DELIM = "||"
# Python's str.strip() whitespace that Java's \s lacks: the four 0x1c-0x1f separators.
_STRIP = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

REQUEST_TYPE = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("referer", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("uri_path", T.StringType()),
        T.StructField("uri_query", T.StringType()),
        T.StructField("is_pageview", T.BooleanType()),
        T.StructField("access_method", T.StringType()),
        T.StructField("referer_class", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)
TEXT_FIELDS = [f.name for f in REQUEST_TYPE.fields]


# ------------------------------------------------------------------ writer
def map_text(m: Column) -> Column:
    """Map -> 'k\\x03v\\x02k\\x03v' (Hive's default map text)."""
    return F.array_join(
        F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(KV_SEP), e["value"])), ENTRY_SEP
    )


def request_text(r: Column) -> Column:
    parts = []
    for name in TEXT_FIELDS:
        v = r[name]
        if name == "ts":
            v = F.date_format(v, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif name == "is_pageview":
            v = F.when(v, F.lit("true")).when(~v, F.lit("false"))
        parts += [F.lit(name), v.cast("string")]
    return F.concat_ws("|", *parts)


def requests_text(requests: Column) -> Column:
    return F.array_join(F.transform(requests, request_text), REQUEST_DELIM)


def trace_lines(traces: DataFrame) -> DataFrame:
    """Traces (ip, ua, geocoded_data, user_agent_map, requests) -> one text line per row (``value``)."""
    return traces.select(
        F.concat_ws(
            "\t",
            F.col("ip"),
            F.col("ua"),
            map_text(F.col("geocoded_data")),
            map_text(F.col("user_agent_map")),
            requests_text(F.col("requests")),
        ).alias("value")
    )


# ------------------------------------------------------------------ reader
def strip_line(line: Column) -> Column:
    return F.regexp_replace(line, _STRIP, "")


def parse_map_text(s: Column) -> Column:
    """map text -> map; entries without 0x03 are skipped, the last of a repeated key wins,
    and a value is cut at a second 0x03."""
    entries = F.filter(F.split(s, ENTRY_SEP, -1), lambda e: F.instr(e, KV_SEP) > 0)
    pairs = F.transform(
        entries,
        lambda e: F.struct(
            F.get(F.split(e, KV_SEP, -1), 0).alias("key"), F.get(F.split(e, KV_SEP, -1), 1).alias("value")
        ),
    )
    return F.map_from_entries(pairs)


def parse_request_maps(s: Column) -> Column:
    """request list text -> array of name/value maps.

    A request whose '|' parts do not pair up is dropped (a '|' inside a
    value does that); one without 'ts' is dropped too. Sorted by the ts text.
    """
    parts = F.transform(F.split(s, REQUEST_DELIM, -1), lambda r: F.split(r, r"\|", -1))
    even = F.filter(parts, lambda p: F.size(p) % 2 == 0)
    maps = F.transform(
        even,
        lambda p: F.map_from_arrays(
            F.filter(p, lambda _, i: i % 2 == 0), F.filter(p, lambda _, i: i % 2 == 1)
        ),
    )
    with_ts = F.filter(maps, lambda m: m.getItem("ts").isNotNull())
    by_ts = lambda a, b: F.when(a.getItem("ts") < b.getItem("ts"), -1).when(a.getItem("ts") > b.getItem("ts"), 1).otherwise(0)
    return F.array_sort(with_ts, by_ts)


def typed_request(m: Column) -> Column:
    """Name/value map -> request struct (unparsable ts -> NULL ts)."""
    fields = []
    for f in REQUEST_TYPE.fields:
        v = m.getItem(f.name)
        if f.name == "ts":
            v = F.try_to_timestamp(v)
        elif f.name == "is_pageview":
            v = F.when(v == "true", F.lit(True)).when(v == "false", F.lit(False))
        fields.append(v.alias(f.name))
    return F.struct(*fields)


def parse_trace_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trace text lines -> (ip, ua, geo_data, ua_data, requests); lines without exactly five fields
    after stripping are dropped."""
    fields = F.split(strip_line(F.col(col)), "\t", -1)
    return (
        lines.select(fields.alias("_f"))
        .where(F.size("_f") == 5)
        .select(
            F.get(F.col("_f"), 0).alias("ip"),
            F.get(F.col("_f"), 1).alias("ua"),
            parse_map_text(F.get(F.col("_f"), 2)).alias("geo_data"),
            parse_map_text(F.get(F.col("_f"), 3)).alias("ua_data"),
            F.transform(parse_request_maps(F.get(F.col("_f"), 4)), typed_request).alias("requests"),
        )
    )


def parse_legacy_requests(s: Column) -> Column:
    """legacy request list: '||'-joined 't|r|p' triples; other part counts are dropped; sorted by t."""
    parts = F.transform(F.split(s, r"\|\|", -1), lambda r: F.split(r, r"\|", -1))
    triples = F.filter(parts, lambda p: F.size(p) == 3)
    return F.array_sort(
        F.transform(triples, lambda p: F.struct(F.get(p, 0).alias("t"), F.get(p, 1).alias("r"), F.get(p, 2).alias("p")))
    )


def parse_legacy_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Legacy layout: requests in the fourth field, geo text in the fifth."""
    fields = F.split(strip_line(F.col(col)), "\t", -1)
    return (
        lines.select(fields.alias("_f"))
        .where(F.size("_f") == 5)
        .select(
            F.get(F.col("_f"), 0).alias("ip"),
            F.get(F.col("_f"), 1).alias("ua"),
            parse_legacy_requests(F.get(F.col("_f"), 3)).alias("requests"),
            F.get(F.col("_f"), 4).alias("geo_data"),
        )
    )
