"""Client-local time features."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Day names, Monday first.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@lru_cache(maxsize=1)
def _python_zones() -> tuple[str, ...]:
    import zoneinfo

    return tuple(sorted(zoneinfo.available_timezones()))


def known_zones(spark: SparkSession | None = None) -> list[str]:
    """Every zone name that both the JVM and Python's tz database know (the guard list of F14)."""
    zones = set(_python_zones())
    if spark is not None:
        try:
            jvm_zones = set(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())  # noqa: SLF001
            zones &= jvm_zones
        except Exception:  # no JVM gateway (e.g. a remote client): the Python list alone
            pass
    return sorted(zones)


def utc_to_local(ts: Column, tz: Column, zones: list[str]) -> Column:
    """UTC timestamp -> wall clock of ``tz``; NULL when the zone is unknown or missing."""
    ok = tz.isin(zones)
    return F.when(ok, F.from_utc_timestamp(ts, F.when(ok, tz).otherwise(F.lit("UTC"))))


def hour_of_day(ts: Column) -> Column:
    """F15."""
    return F.hour(ts)


def hour_bucket(hour: Column, k: int) -> Column:
    """F16: start hour of the k-hour bucket."""
    return (F.floor(hour / F.lit(k)) * F.lit(k)).cast("int")


def hour_bucket_label(hour: Column, k: int) -> Column:
    """F16: '<start>-<end>' label of the k-hour bucket."""
    b = hour_bucket(hour, k)
    return F.format_string("%d-%d", b, b + F.lit(k))


def day_of_week(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def day_name(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), F.weekday(ts) + 1)


def day_type(ts: Column) -> Column:
    """1 on Saturday and Sunday, else 0."""
    return (F.weekday(ts) > 4).cast("int")


def with_local_time(df, ts: str, tz: Column, zones: list[str], prefix: str = "local_"):
    """X10 preparation: local time, hour, 2/3/4-hour buckets, weekday and day type; rows without a
    known zone are dropped (P13)."""
    local = utc_to_local(F.col(ts), tz, zones)
    out = df.withColumn(f"{prefix}dt", local).where(F.col(f"{prefix}dt").isNotNull())
    lt = F.col(f"{prefix}dt")
    out = out.withColumn(f"{prefix}hour_of_day", hour_of_day(lt))
    for k in (2, 3, 4):
        out = out.withColumn(f"{prefix}hour_of_day_div{k}", hour_bucket(F.col(f"{prefix}hour_of_day"), k))
    return out.withColumn(f"{prefix}day_of_week", day_of_week(lt)).withColumn(f"{prefix}day_type", day_type(lt))
