"""File sources and sinks (S1-S19): partitioned parquet, Hive-style text, JSON lines and TSV.

Every reader takes an explicit schema; nothing is inferred. Writers run on
the executors (no collect) and replace data idempotently.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktrail.functions import textparse as TP
from clicktrail.functions.recode import join_codes, split_codes
from clicktrail.sources.work import children, drop, exists, rename

PARTITIONS = ["year", "month", "day", "host"]
# JSON timestamps keep microseconds (Spark's default text format stops at milliseconds).
JSON_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
JSON_OPTIONS = {"timestampFormat": JSON_TS}

STR_MAP = T.MapType(T.StringType(), T.StringType())
TRACE_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("ua", T.StringType()),
        T.StructField("geo_data", STR_MAP),
        T.StructField("ua_data", STR_MAP),
        T.StructField("requests", T.ArrayType(TP.REQUEST_TYPE)),
    ]
)
CLICK_DATA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("survey_token", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
CLICK_TRACE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("requests", T.ArrayType(TP.REQUEST_TYPE)),
        T.StructField("click_data", CLICK_DATA),
        T.StructField("geo_data", STR_MAP),
        T.StructField("ua_data", STR_MAP),
    ]
)


# ------------------------------------------------------------------ request log
def day_span(start: str, stop: str) -> Column:
    """Inclusive day span over year/month/day partition columns."""
    d = F.make_date("year", "month", "day")
    return d.between(F.to_date(F.lit(start)), F.to_date(F.lit(stop)))


def _numbered(spark: SparkSession, folder: str, name: str) -> list[tuple[int, str]]:
    """``(value, folder name)`` of the partitions ``name=value`` in ``folder``, for whole numbers."""
    parts = [c.partition("=") for c in children(spark, folder)]
    return [(int(v), f"{n}={v}") for n, _, v in parts if n == name and v.isdigit()]


def day_folders(spark: SparkSession, path: str, start: str, stop: str) -> list[str]:
    """The day folders of a year/month/day partitioned table that lie in [start, stop].

    Only the table's folder, the years and the months of the span are listed, however many days the table holds.
    """
    first, last = dt.date.fromisoformat(start[:10]), dt.date.fromisoformat(stop[:10])
    found = []
    for year, y in _numbered(spark, path, "year"):
        if not first.year <= year <= last.year:
            continue
        for month, m in _numbered(spark, f"{path}/{y}", "month"):
            if not (first.year, first.month) <= (year, month) <= (last.year, last.month):
                continue
            days = _numbered(spark, f"{path}/{y}/{m}", "day")
            found += [(dt.date(year, month, day), f"{path}/{y}/{m}/{d}") for day, d in days if first <= dt.date(year, month, day) <= last]
    return [folder for _, folder in sorted(found)]


def _read_days(spark: SparkSession, path: str, start: str, stop: str, schema: T.StructType | None = None) -> DataFrame:
    """A span of a year/month/day partitioned table: its day folders alone are named to the reader."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    folders = day_folders(spark, path, start, stop)
    found = reader.option("basePath", path).parquet(*folders) if folders else reader.parquet(path)
    return found.where(day_span(start, stop))


def read_requests(spark: SparkSession, path: str, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Partitioned request log; of a span only its day folders are listed and read."""
    if start is None:
        return spark.read.parquet(path)
    return _read_days(spark, path, start, stop or start)


def snapshot_requests(df: DataFrame, days: Sequence[int], path: str, month: int | None = None) -> None:
    """Copy the requests of some days to their own table (``CREATE TABLE AS SELECT``)."""
    cond = F.col("day").isin(list(days))
    if month is not None:
        cond = cond & (F.col("month") == month)
    df.where(cond).write.mode("errorifexists").partitionBy("year", "month", "day").parquet(path)


def read_redirects(spark: SparkSession, path: str) -> DataFrame:
    """S3: redirect table (rd_from, rd_to)."""
    return spark.read.parquet(path).select("rd_from", "rd_to")


# ------------------------------------------------------------------ trace tables
def write_traces(df: DataFrame, path: str) -> None:
    """Per-day trace table partitioned by year, month, day and host (replaces the whole table)."""
    df.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)


STAGED = "_staged"  # readers of the table skip names that begin with an underscore
_MANIFEST = "partition string, gone boolean"


def _partitions(spark: SparkSession, path: str, above: str = "") -> list[str]:
    """The partition folders (year, month, day, host) in ``path`` that lie under ``above``, relative to ``path``."""
    found = [above] if above else [""]
    for name in PARTITIONS[above.count("=") :]:
        found = [f"{f}/{c}".lstrip("/") for f in found for c in children(spark, f"{path}/{f}") if c.startswith(f"{name}=")]
    return found


def overwrite_day(df: DataFrame, path: str, days: Sequence[tuple[int, int, int]] = ()) -> None:
    """Replace the partitions of some days (every host) with the rows of ``df``: reruns are idempotent.

    Partitions present in ``df`` are overwritten. Of the rebuilt ``days``
    (year, month, day), hosts that no longer have a row lose their old
    partition, so the table always equals a build from scratch.

    ``df`` is run once, into a folder aside. One manifest then names the
    partitions to swap in and to remove; from there on the change is certain: a
    writer that dies is completed by the next one (``finish_overwrites``), one
    that dies before leaves the table as it was. One writer at a time; a reader
    may meet partitions of both states while they are swapped.
    """
    spark = df.sparkSession
    finish_overwrites(spark, path)
    staged = f"{path}/{STAGED}/{uuid.uuid4().hex}"
    df.write.partitionBy(*PARTITIONS).parquet(f"{staged}/rows")
    made = _partitions(spark, f"{staged}/rows")
    old = {p for day in days for p in _partitions(spark, path, "year={}/month={}/day={}".format(*day))}
    entries = [(p, False) for p in made] + [(p, True) for p in sorted(old - set(made))]
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.json(f"{staged}/manifest-open")
    rename(spark, f"{staged}/manifest-open", f"{staged}/manifest")
    finish_overwrites(spark, path)


def finish_overwrites(spark: SparkSession, path: str) -> None:
    """Completes overwrites whose manifest was written, and removes what others left; without either, does nothing."""
    for name in children(spark, f"{path}/{STAGED}"):
        staged = f"{path}/{STAGED}/{name}"
        if exists(spark, f"{staged}/manifest"):
            for r in spark.read.schema(_MANIFEST).json(f"{staged}/manifest").collect():  # days x hosts
                made = f"{staged}/rows/{r.partition}"
                if r.gone:
                    drop(spark, f"{path}/{r.partition}")
                elif exists(spark, made):  # else it was swapped in before
                    drop(spark, f"{path}/{r.partition}")
                    rename(spark, made, f"{path}/{r.partition}")
        drop(spark, staged)


def write_merged(df: DataFrame, path: str) -> None:
    """All-days trace table; fails if it exists, like a CREATE TABLE AS SELECT without IF NOT EXISTS."""
    df.write.mode("errorifexists").parquet(path)


def write_merged_chunks(chunks: DataFrame, path: str) -> None:
    """S6, chunked (``requests.chunk_traces``): files cover ranges of (client, chunk) and are sorted by it, so that a
    client is found by the files' statistics and a client with a third of all requests lies in many files."""
    place = ["ip", "ua", "chunk"]
    chunks.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("errorifexists").parquet(path)


def read_partition(spark: SparkSession, path: str, day: str, host: str) -> DataFrame:
    """One (day, host) partition of a partitioned table, found by partition pruning."""
    d = dt.date.fromisoformat(day[:10])
    return spark.read.parquet(path).where(
        (F.col("year") == d.year) & (F.col("month") == d.month) & (F.col("day") == d.day) & (F.col("host") == host)
    )


def read_span(spark: SparkSession, path: str, start: str, stop: str, schema: T.StructType | None = None) -> DataFrame:
    """S11 + U1: every day x host partition in [start, stop] of a partitioned table, as one DataFrame."""
    return _read_days(spark, path, start, stop, schema)


def day_range(spark: SparkSession, start: str, stop: str) -> DataFrame:
    """One row per day from start to stop inclusive."""
    return spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(stop)), F.expr("INTERVAL 1 DAY"))).alias("day")
    )


# ------------------------------------------------------------------ text and JSON
def write_trace_text(traces: DataFrame, path: str) -> None:
    """Trace table in the tab-separated text form (see :mod:`clicktrail.functions.textparse`)."""
    TP.trace_lines(traces).write.mode("overwrite").text(path)


def read_trace_text(spark: SparkSession, path: str) -> DataFrame:
    """Text trace table -> typed traces; malformed lines are dropped."""
    return TP.parse_trace_lines(spark.read.text(path))


def write_hashed(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what is there."""
    df.write.mode("overwrite").options(**JSON_OPTIONS).json(path)


def read_hashed(spark: SparkSession, path: str, schema: T.StructType = TRACE_SCHEMA) -> DataFrame:
    """JSON lines with a declared schema; lines missing any field are dropped (arity check)."""
    df = spark.read.schema(schema).options(**JSON_OPTIONS).json(path)
    cond = None
    for f in schema.fieldNames():
        c = F.col(f).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def write_click_traces(df: DataFrame, path: str) -> None:
    """Nested click traces as JSON lines, written by the executors."""
    df.write.mode("overwrite").options(**JSON_OPTIONS).json(path)


def read_click_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLICK_TRACE_SCHEMA).options(**JSON_OPTIONS).json(path)


# ------------------------------------------------------------------ event log
def read_event_log(
    spark: SparkSession, path: str | None = None, schema: T.StructType | None = None, **jdbc_options: str
) -> DataFrame:
    """Survey event log (responses or initiation events).

    A parquet table at ``path`` (with a declared schema when given), or - the
    original's MySQL tables - a JDBC read when ``jdbc_options`` (url, dbtable,
    partitionColumn, lowerBound, upperBound, numPartitions, ...) are passed, so
    the database is read by parallel tasks rather than through the driver.
    """
    if jdbc_options:
        return spark.read.format("jdbc").options(**jdbc_options).load()
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


# ------------------------------------------------------------------ TSV
def read_survey_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated export with a header and a declared schema."""
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def write_tsv(df: DataFrame, path: str, ts_format: str = "yyyy-MM-dd HH:mm:ss") -> None:
    """TSV with header; lists of text are joined by '|' (``work/school|media``), other nested columns are
    written as JSON text, timestamps with ``ts_format``."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "array<string>":
            c = join_codes(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c, {"timestampFormat": ts_format})
        cols.append(c.alias(f.name))
    (
        df.select(*cols)
        .write.mode("overwrite")
        .option("sep", "\t")
        .option("header", True)
        .option("timestampFormat", ts_format)
        .csv(path)
    )


def load_tsv_nested(
    spark: SparkSession, path: str, schema: T.StructType, ts_format: str = "yyyy-MM-dd HH:mm:ss"
) -> DataFrame:
    """Read a TSV written by :func:`write_tsv` and rebuild the nested columns from their text."""
    flat = T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else f.dataType)
            for f in schema.fields
        ]
    )
    raw = (
        spark.read.option("sep", "\t").option("header", True).option("timestampFormat", ts_format).schema(flat).csv(path)
    )
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "array<string>":
            c = split_codes(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.from_json(c, f.dataType, {"timestampFormat": ts_format})
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def clean_trace(requests: Column) -> Column:
    """Drop requests whose timestamp did not parse."""
    return F.filter(requests, lambda r: r["ts"].isNotNull())


def load_sample(df: DataFrame, trace_col: str = "requests") -> DataFrame:
    """S17 + P12 + P14: random trace sample: clean timestamps, drop empty traces and the ip/ua columns."""
    out = df.withColumn("trace_data", clean_trace(F.col(trace_col)))
    if trace_col != "trace_data":
        out = out.drop(trace_col)
    return out.where(F.size("trace_data") > 0).drop("ip", "ua")


def roundtrip_counts(written: DataFrame, read_back: DataFrame) -> DataFrame:
    """Row counts of what was written and what was read back, side by side."""
    tagged = written.select(F.lit(0).alias("_side")).unionByName(read_back.select(F.lit(1).alias("_side")))
    return tagged.agg(
        F.count_if(F.col("_side") == 0).alias("written"), F.count_if(F.col("_side") == 1).alias("read_back")
    )
