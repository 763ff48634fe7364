"""As-of joins: click -> latest earlier request with its title (J6), referer -> latest earlier page view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.functions.keys import seconds_between
from clicktrail.operators.joins import key_of


def asof_click_request(
    rows: DataFrame,
    by: Sequence[str],
    title_col: str = "click_title",
    click_ts_col: str = "click_dt_utc",
    fields: Sequence[str] = ("ts", "title", "referer", "uri_path", "uri_query", "access_method", "referer_class"),
) -> DataFrame:
    """J6 + F22: per click (the columns ``by``), the latest request of its trace with the click's title and ``ts <= click``.

    ``rows`` are trace rows (``id``, ``ts``, ``title``, ...) joined to clicks.
    One aggregate with partial sums, so a trace of any length is reduced where
    its rows are; among equal timestamps the lowest position wins. Adds
    ``click_request`` (struct with ``id``), ``time_to_click`` (seconds), both
    NULL when nothing qualifies, and ``n_requests`` of the trace.
    """
    fits = (F.col("title") == F.col(title_col)) & (F.col("ts") <= F.col(click_ts_col))
    latest = F.max_by(F.struct("id", *fields), F.when(fits, F.struct(F.col("ts"), -F.col("id"))))
    out = rows.groupBy(*by).agg(latest.alias("click_request"), F.count(F.lit(1)).alias("n_requests"))
    return out.withColumn("time_to_click", seconds_between(F.col(click_ts_col), F.col("click_request.ts")))


def assign_parents(
    rows: DataFrame,
    group_cols: Sequence[str],
    node: str = "node",
    ts: str = "ts",
    page_key: str = "page_key",
    referer_key: str = "referer_key",
    ambiguity: str = "reference",
    bucket_minutes: float = 60,
) -> DataFrame:
    """Parent of each request = the latest strictly earlier page view in its group whose
    page key equals the request's referer key; none -> a root.

    One pass over the rows emits each twice, as a "referer" row (key = referer
    key) and as a "page" row (key = page key); a window carries the last page
    view forward, and at equal (ts, node) the referer row sorts first, so a
    request never becomes its own parent. The window runs per (group, key, time
    bucket), so one page viewed a huge number of times in one session is spread
    over its buckets; the last page view of each earlier bucket comes from a
    small table (one row per group, key and bucket) whose own window carries it
    forward. ``ambiguity='intended'`` flags requests whose referer page was seen
    more than once before; the original never updated its counter, so
    ``'reference'`` flags none.
    """
    width = int(round(bucket_minutes * 60_000_000))
    bucket = F.floor(F.unix_micros(F.col(ts)) / F.lit(width)).cast("bigint")
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col(referer_key).alias("key")), F.struct(F.lit(1).alias("kind"), F.col(page_key).alias("key"))
    )
    # the group travels in the slot alone, other columns with the referer rows alone
    own = [c for c in rows.columns if c not in (*group_cols, node, ts)]
    rest = F.when(F.col("_as.kind") == 0, F.struct(*[F.col(f"`{c}`") for c in own])) if own else F.lit(0)
    twice = rows.select("*", F.explode(both).alias("_as")).select(
        node, ts, "_as", rest.alias("_rest"), F.struct(key_of(list(group_cols)).alias("g"), F.col("_as.key").alias("key")).alias("_slot"), bucket.alias("_b")
    )
    group = {c: f"_slot.g.k{i}" for i, c in enumerate(group_cols)}
    columns = [F.col(group[c] if c in group else f"`{c}`" if c in (node, ts) else f"_rest.`{c}`").alias(c) for c in rows.columns]
    w = (
        Window.partitionBy("_slot", "_b")
        .orderBy(ts, node, "_as.kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    is_page = F.col("_as.kind") == 1
    page_hit = F.when(is_page, F.struct(F.col(node).alias("n"), F.col(ts).alias("t")))
    windowed = twice.withColumn("_in", F.last(page_hit, ignorenulls=True).over(w)).withColumn(
        "_seen_in", F.count(page_hit).over(w)
    )
    # one row per (group, key, bucket); its own window runs on that small table
    earlier = Window.partitionBy("_slot").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (
        twice.groupBy("_slot", "_b")
        .agg(F.max_by(page_hit, F.when(is_page, F.struct(ts, node))).alias("_last"), F.count_if(is_page).alias("_n"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
        .withColumn("_carry_n", F.sum("_n").over(earlier))
        .select("_slot", "_b", "_carry", "_carry_n")
    )
    # a NULL key never matches (a missing page key is not a link to other missing keys)
    par = F.when(F.col("_as.key").isNotNull(), F.coalesce(F.col("_in"), F.col("_carry")))
    seen = F.col("_seen_in") + F.coalesce(F.col("_carry_n"), F.lit(0))
    return (
        windowed.where(~is_page)
        .join(per_bucket, ["_slot", "_b"], "left")
        .select(
            *columns,
            par["n"].alias("parent"),
            par["t"].alias("parent_ts"),
            ((seen > 1) if ambiguity == "intended" else F.lit(False)).alias("parent_ambiguous"),
        )
    )
