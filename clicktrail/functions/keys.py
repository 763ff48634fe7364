"""Client keys and timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_LOG_TS = "yyyyMMddHHmmss"  # event-log timestamp text
FORM_TS = "M/d/yyyy H:mm:ss"  # survey form export
REQUEST_TS = "yyyy-MM-dd HH:mm:ss"  # request timestamps in trace text


def client_key(ip: Column, ua: Column) -> Column:
    """ip and user agent concatenated without a separator (NULL if either is NULL)."""
    return F.concat(ip, ua)


def strip_quotes(s: Column) -> Column:
    """drop the first and last character (``s[1:-1]``)."""
    return s.substr(F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))


def parse_ts(s: Column, fmt: str) -> Column:
    """Text -> timestamp with a pattern; unparsable text gives NULL."""
    return F.try_to_timestamp(s, F.lit(fmt))


def event_log_ts(s: Column) -> Column:
    return parse_ts(s, EVENT_LOG_TS)


def form_ts(s: Column) -> Column:
    return parse_ts(s, FORM_TS)


def seconds_between(later: Column, earlier: Column) -> Column:
    """(later - earlier) in seconds, with microseconds."""
    return ((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)).cast("double")


def partition_name(day: Column, host: Column) -> Column:
    """``year=Y/month=M/day=D/host=H`` of a date and host."""
    return F.format_string(
        "year=%d/month=%d/day=%d/host=%s", F.year(day), F.month(day), F.dayofmonth(day), host
    )
