"""Gap sessionisation (W5), request numbering (W6), session metrics (T4-T6) and session picks.

Sessions are found without a window over each client's rows. Time is cut
into buckets as wide as the gap: two requests in one bucket are less than a
gap apart, so a session can only start at the first request of a bucket.
Whether it does depends on the bucket's first timestamp and the previous
non-empty bucket's last one, so a per-(client, bucket) min/max table - built
with partial aggregation, a few rows per client and day - is all the window
needs. A client holding a third of all requests is spread over its buckets
instead of landing in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.operators.joins import key_of, null_safe_join

SEARCH_REFERER = "external (search engine)"  # fixed value of the request log's referer_class


def _bucket(ts: str, gap_us: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(gap_us)).cast("bigint")


def _session_buckets(
    buckets: DataFrame, client_cols: Sequence[str], gap_us: int, session_col: str
) -> DataFrame:
    """Number sessions on the bucket table (one row per client and non-empty bucket)."""
    w = Window.partitionBy(*client_cols).orderBy("_bucket")
    prev_max = F.lag("_bmax").over(w)
    start = (prev_max.isNull() | ((F.col("_bmin") - prev_max) > F.lit(gap_us))).cast("int")
    return buckets.withColumn("_start", start).withColumn(
        session_col,
        (F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("int"),
    )


def sessionize(
    df: DataFrame,
    client_cols: Sequence[str] = ("client_ip", "user_agent"),
    ts: str = "ts",
    gap_minutes: float = 60,
    session_col: str = "session_id",
) -> DataFrame:
    """Add ``session_id`` (0-based per client): a new session starts after a gap strictly over ``gap_minutes``."""
    client_cols = list(client_cols)
    gap_us = int(round(gap_minutes * 60_000_000))
    keyed = df.withColumn("_bucket", _bucket(ts, gap_us))
    # rows without a timestamp belong to no session (their session_id stays NULL)
    buckets = keyed.where(F.col(ts).isNotNull()).groupBy(*client_cols, "_bucket").agg(
        F.min(F.unix_micros(F.col(ts))).alias("_bmin"), F.max(F.unix_micros(F.col(ts))).alias("_bmax")
    )
    numbered = _session_buckets(buckets, client_cols, gap_us, session_col).select(
        *client_cols, "_bucket", session_col
    )
    return null_safe_join(keyed, numbered, client_cols + ["_bucket"], "left").drop("_bucket")


def session_metrics(
    df: DataFrame,
    client_cols: Sequence[str] = ("client_ip", "user_agent"),
    ts: str = "ts",
    gap_minutes: float = 60,
) -> DataFrame:
    """Per session: requests, page views (T4), length in minutes (T5) and search-referred requests.

    Runs on bucket aggregates only: rows are reduced to one row per (client,
    bucket) before any shuffle, and the session numbering and the per-session
    sums run on that small table. Length uses whole seconds, like the
    reference, and is 0 for single-request sessions.
    """
    client_cols = list(client_cols)
    gap_us = int(round(gap_minutes * 60_000_000))
    us = F.unix_micros(F.col(ts))
    buckets = (
        df.where(F.col(ts).isNotNull())
        .withColumn("_bucket", _bucket(ts, gap_us))
        .groupBy(*client_cols, "_bucket")
        .agg(
            F.min(us).alias("_bmin"),
            F.max(us).alias("_bmax"),
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("is_pageview")).alias("_pv"),
            F.count_if(F.col("referer_class") == SEARCH_REFERER).alias("_search"),
        )
    )
    numbered = _session_buckets(buckets, client_cols, gap_us, "session_id")
    out = numbered.groupBy(*client_cols, "session_id").agg(
        F.sum("_n").alias("n_requests"),
        F.sum("_pv").alias("num_pageviews"),
        F.min("_bmin").alias("_first"),
        F.max("_bmax").alias("_last"),
        F.sum("_search").alias("external_searches"),
    )
    secs = lambda c: F.floor(F.col(c) / F.lit(1_000_000))  # noqa: E731  whole seconds, like mktime(timetuple())
    length = F.when(F.col("n_requests") < 2, F.lit(0.0)).otherwise(
        ((secs("_last") - secs("_first")) / F.lit(60.0)).cast("double")
    )
    return out.select(
        *client_cols,
        "session_id",
        F.col("n_requests").cast("bigint").alias("n_requests"),
        F.col("num_pageviews").cast("bigint").alias("num_pageviews"),
        length.alias("session_length"),
        F.col("external_searches").cast("bigint").alias("external_searches"),
    )


def number_requests(
    df: DataFrame, client_cols: Sequence[str], order_cols: Sequence[str], id_col: str = "id", ts: str = "ts"
) -> DataFrame:
    """0-based position of each request in its client's trace (``order_cols`` begin with ``ts``).

    Rows are numbered within a client's day; the number of rows on earlier days
    comes from a table of one row per client and day. A client with a third of
    all requests is spread over its days.
    """
    slot = F.struct(key_of(client_cols).alias("c"), F.to_date(ts).alias("d"))
    keyed = df.withColumn("_slot", slot)
    per_day = keyed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_slot.c").orderBy("_slot.d").rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.select("_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    in_day = Window.partitionBy("_slot").orderBy(*order_cols)
    numbered = keyed.withColumn("_i", F.row_number().over(in_day)).join(per_day, "_slot")
    return numbered.withColumn(id_col, (F.col("_before") + F.col("_i") - 1).cast("int")).drop("_slot", "_before", "_i")


def session_arrays(
    df: DataFrame,
    client_cols: Sequence[str],
    request_cols: Sequence[str],
    ts: str = "ts",
    gap_minutes: float = 60,
) -> DataFrame:
    """One row per client and session, with the session's requests as an array in time order.

    A client's sessions stay separate rows (``session_id`` gives their order),
    so nothing holds a client's history.
    """
    s = sessionize(df, client_cols, ts, gap_minutes).where(F.col("session_id").isNotNull())
    return s.groupBy(*client_cols, "session_id").agg(F.sort_array(F.collect_list(F.struct(*request_cols))).alias("session"))


def pick_session(sessions: DataFrame, client_cols: Sequence[str], seed: str, session_col: str = "session_id") -> DataFrame:
    """one session per client, chosen by a seeded md5 rank (same choice in any engine).

    ``sessions`` holds one row per (client, session); the pick is a ``min_by``
    aggregate, reduced map-side however many sessions a client has.
    """
    rank = F.struct(F.md5(F.concat(F.col(session_col).cast("string"), F.lit(seed))), F.col(session_col))
    row = F.struct(*[F.col(c) for c in sessions.columns if c not in client_cols])
    picked = sessions.groupBy(*client_cols).agg(F.min_by(row, rank).alias("_r"))
    return picked.select(*client_cols, "_r.*").select(*sessions.columns)


def session_host(first_access_method: Column) -> Column:
    """host of a session from its first request; 'unknown' if missing."""
    return F.coalesce(first_access_method, F.lit("unknown"))


def session_summary(rows: DataFrame, key_cols: Sequence[str], ts: str = "ts") -> DataFrame:
    """T4-T6 (+ F24) over rows that already form one session per key: page views, length in
    minutes (whole seconds, 0 below two requests), search-referred requests, and the host of
    the first request."""
    us = F.unix_micros(F.col(ts))
    first = F.min_by(F.col("access_method"), F.struct(us, F.col("id") if "id" in rows.columns else us))
    out = rows.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(F.col("is_pageview")).alias("num_pageviews"),
        F.floor(F.min(us) / F.lit(1_000_000)).alias("_first"),
        F.floor(F.max(us) / F.lit(1_000_000)).alias("_last"),
        F.count_if(F.col("referer_class") == SEARCH_REFERER).alias("external_searches"),
        first.alias("_first_access"),
    )
    length = F.when(F.col("n_requests") < 2, F.lit(0.0)).otherwise(
        ((F.col("_last") - F.col("_first")) / F.lit(60.0)).cast("double")
    )
    return out.select(
        *key_cols,
        F.col("n_requests").cast("bigint").alias("n_requests"),
        F.col("num_pageviews").cast("bigint").alias("num_pageviews"),
        length.alias("session_length"),
        F.col("external_searches").cast("bigint").alias("external_searches"),
        session_host(F.col("_first_access")).alias("host"),
    )
