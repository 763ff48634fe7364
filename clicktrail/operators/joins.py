"""Join helpers: equi-joins in which NULL equals NULL, and uniqueness filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(cols: Sequence[str], df: DataFrame | None = None) -> Column:
    """The columns as one key. Two keys are equal when all fields are, and a NULL field equals a NULL field.

    As the key itself is never NULL, joins, windows and aggregates on it are
    planned as plain equality on one expression and can share a partitioning.
    """
    return F.struct(*[(df[c] if df is not None else F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(cols)])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the right side's key columns are dropped."""
    keys = list(keys)
    r = right.select(key_of(keys).alias("_rk"), *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    out = left.withColumn("_lk", key_of(keys)).join(r, F.col("_lk") == F.col("_rk"), how)
    return out.drop("_lk", "_rk")


def keep_unique(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Keep rows whose value of ``cols`` occurs exactly once (NULLs count as equal).

    One aggregate: the rows of a value are counted and any one of them is
    carried along, partially in each task, so a value held by a huge number of
    rows is reduced before the shuffle, and the input is read once.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    once = df.groupBy(key_of(cols).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.first(row).alias("_r"))
    return once.where("_n = 1").select("_r.*")
