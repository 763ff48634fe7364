"""Driver tables and the adapters over them, as Spark DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.sources import adapters as A

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run one portable adapter SQL over the driver's ``events`` table."""
    sql = A.ADAPTERS[name](A.SPARK)
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def flat_request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "request_log")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log in the nested web-request schema (maps and structs built from flat columns)."""
    flat = flat_request_log(spark, sf_dir)
    return nest_request_log(flat)


def nest_request_log(flat: DataFrame) -> DataFrame:
    return flat.select(
        "req_id",
        "client_ip",
        "user_agent",
        "ts",
        "referer",
        "uri_host",
        "uri_path",
        "uri_query",
        "is_pageview",
        "access_method",
        "referer_class",
        "webrequest_source",
        "agent_type",
        F.when(F.col("is_pageview"), F.create_map(F.lit("page_title"), F.col("page_title")))
        .otherwise(F.create_map(F.lit("page_title"), F.lit(None).cast("string")))
        .alias("pageview_info"),
        F.struct(F.col("project_class"), F.col("project")).alias("normalized_host"),
        F.create_map(F.lit("timezone"), F.col("timezone"), F.lit("country"), F.col("country")).alias(
            "geocoded_data"
        ),
        F.create_map(F.lit("browser_family"), F.col("browser_family")).alias("user_agent_map"),
        "year",
        "month",
        "day",
        "hour",
    )


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "redirects")


def responses_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "responses_log")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "page")


def initiation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "initiation_log")


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "raw_survey")
