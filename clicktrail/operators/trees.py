"""Referer forests (T2, T3), the tree holding a click (J9), tree picks (F27) and tree metrics.

A forest is an edge table, one row per request: ``node`` (request id, unique
within its group - a session) and ``parent`` (NULL for a root). A tree is
identified by (group columns, root). Everything that depends on more than a
node's own edge - its root and depth, the size and height of its subtree, its
run of equal timestamps - is found in two levels. A group is cut into blocks of
hours that hold about ``BLOCK_ROWS`` rows together; a usual session is one block. Inside a
block parents are followed within a task (``blocks``); only where a tree enters
a block from another one is its top carried on, by pointer doubling over those
tops alone: two plain equi-joins and one aggregate a round, and as many rounds as the logarithm of
the blocks on a path. No list of nodes is built (``path`` is, when asked for).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktrail.operators import blocks
from clicktrail.operators.asof import assign_parents
from clicktrail.operators.joins import key_of, null_safe_join
from clicktrail.sources.work import stored, work_folder

BLOCK_ROWS = 10_000


def resolve(
    edges: DataFrame,
    group_cols: Sequence[str] = (),
    node: str = "node",
    ts: str = "ts",
    parent: str = "parent",
    parent_ts: str = "parent_ts",
    path: bool = False,
    folder: str | None = None,
    rows: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``root``, ``depth``, ``n_children``, ``subtree`` (nodes, itself included), ``height`` and ``tie_level``.

    ``tie_level`` counts the unbroken run of ancestors with the node's own
    timestamp. ``path=True`` also adds the node ids from the root down to the
    node, whose total length is quadratic in the depth of a chain. ``rows``: a
    written table with the groups and times of ``edges``, if there is one.
    """
    folder = folder or work_folder(edges.sparkSession, "forest")
    if rows is None:
        edges = rows = stored(edges, f"{folder}/edges")
    group = key_of(list(group_cols)) if group_cols else F.struct(F.lit(0).alias("k0"))
    hour = F.coalesce(F.floor(F.unix_micros(F.col(ts)) / F.lit(3_600_000_000)).cast("bigint"), F.lit(-(1 << 62)))
    times = rows.select(group.alias("_g"), hour.alias("_hour"))
    several = not times.groupBy("_g").count().where(F.col("count") > block_rows).isEmpty()
    up = F.col(parent).cast("bigint")
    keyed = edges.withColumns(
        {
            "_g": group,
            "_n": F.col(node).cast("bigint"),
            "_p": up,
            "_tie": up.isNotNull() & F.coalesce(F.col(ts) == F.col(parent_ts), F.lit(False)),
        }
    )
    if several:
        keyed = keyed.withColumn("_hour", hour).join(_cut_groups(times, block_rows), ["_g", "_hour"], "left").drop("_hour")
    else:
        keyed = keyed.withColumn("_b", F.lit(None).cast("bigint"))
    found = stored(_inside(keyed, path), f"{folder}/inside")
    if several:
        found = found.where("_b is null").unionByName(_across(found.where("_b is not null"), path, folder))
    if path:
        lost = F.when(F.col("_out"), F.array("root")).otherwise(F.array().cast("array<bigint>"))  # a parent that is not among the rows
        found = found.withColumn("path", F.concat(lost, F.col("above"))).drop("above")
    return found.drop("_g", "_b", "_n", "_p", "_tie", "_top", "_out")


def _cut_groups(times: DataFrame, block_rows: int) -> DataFrame:
    """``_g, _hour, _b``: the hours of the groups of more than ``block_rows`` rows, in blocks of about as many rows."""
    in_group = Window.partitionBy("_g")
    earlier = in_group.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = times.groupBy("_g", "_hour").agg(F.count(F.lit(1)).alias("_m"))
    hours = hours.select("_g", "_hour", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"), F.sum("_m").over(in_group).alias("_all"))
    return hours.where(F.col("_all") > block_rows).select("_g", "_hour", F.expr(f"_before div {block_rows}").alias("_b"))


def _inside(keyed: DataFrame, path: bool) -> DataFrame:
    """Every block by itself: see ``blocks.solve``."""
    extra = blocks.FOUND + (", above array<bigint>" if path else "")
    schema = T.StructType([f for f in keyed.schema if f.name not in blocks.WEIGHTS] + list(T.StructType.fromDDL(extra)))
    return keyed.repartition("_g", "_b").sortWithinPartitions("_g", "_b", "_n").mapInArrow(lambda it: blocks.solve(it, path), schema)


def _across(found: DataFrame, path: bool, folder: str) -> DataFrame:
    """Joins the blocks of groups that have several.

    Where a tree enters a block its top there has a parent in another one. Only
    these tops take part in the doubling, whose rounds are the logarithm of the
    number of blocks on a path; then what hangs below each row in other blocks
    is known, and the blocks are solved once more with it.
    """
    names = [c.split()[0] for c in blocks.FOUND.split(", ")] + ["above"] * path
    tops = found.where("_out and _n = _top").select("_g", F.col("_n").alias("t"), F.col("_p").alias("p"), F.col("subtree").alias("total"), "height")
    at = found.select(
        "_g", F.col("_n").alias("p"), F.col("_top").alias("p_top"), F.col("_out").alias("p_out"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"),
        *([F.col("above")] if path else []),
    )
    state = tops.join(at, ["_g", "p"], "left").select(
        "_g",
        "t",
        "p",
        F.when(F.col("p_out"), F.col("p_top")).alias("up"),
        F.when(F.col("p_out"), F.lit(None)).otherwise(F.coalesce("p_root", "p")).cast("bigint").alias("root"),
        # to the top of the parent's tree in its block (whose own step outside is counted already), else to the root
        F.coalesce(F.when(F.col("p_out"), F.col("p_depth")).otherwise(F.col("p_depth") + 1), F.lit(1)).alias("depth"),
        "total",
        "height",
        *([F.coalesce("above", F.array("p")).alias("above")] if path else []),
    )
    k, longest = 0, 0
    while True:
        state = stored(state, f"{folder}/across{k}")
        if k == 0:
            longest = state.count().bit_length() + 1  # rounds that a path through all tops would take
        if k > longest:
            raise RuntimeError("parent pointers did not converge: the edge table has a cycle")
        far = state.where("up is not null")
        if far.isEmpty():
            break
        below = far.groupBy("_g", F.col("up").alias("t")).agg(F.sum("total").alias("b_total"), F.max(F.col("height") + F.col("depth")).alias("b_height"))
        top = state.select("_g", F.col("t").alias("up"), F.col("up").alias("t_up"), F.col("root").alias("t_root"), F.col("depth").alias("t_depth"), *([F.col("above").alias("t_above")] if path else []))
        state = (
            state.join(below, ["_g", "t"], "left")
            .join(top, ["_g", "up"], "left")
            .select(
                "_g",
                "t",
                "p",
                F.col("t_up").alias("up"),
                F.coalesce("root", "t_root").alias("root"),
                (F.col("depth") + F.coalesce("t_depth", F.lit(0))).alias("depth"),
                (F.col("total") + F.coalesce("b_total", F.lit(0))).alias("total"),
                F.greatest("height", "b_height").alias("height"),
                *([F.concat(F.coalesce("t_above", F.array().cast("array<bigint>")), F.col("above")).alias("above")] if path else []),
            )
        )
        k += 1
    hung = state.groupBy("_g", F.col("p").alias("_n")).agg(F.sum("total").alias("_w"), (F.max("height") + 1).alias("_h"), F.count(F.lit(1)).alias("_k"))
    again = _inside(found.drop(*names).join(hung, ["_g", "_n"], "left"), path)
    own = state.select("_g", F.col("t").alias("_top"), F.col("root").alias("o_root"), F.col("depth").alias("o_depth"), *([F.col("above").alias("o_above")] if path else []))
    joined = again.join(own, ["_g", "_top"], "left")
    columns = {
        "root": F.coalesce("o_root", "root"),
        "depth": F.when(F.col("o_root").isNull(), F.col("depth")).otherwise(F.col("depth") - 1 + F.col("o_depth")),
        "_out": F.lit(False),
    }
    if path:
        columns["above"] = F.concat(F.coalesce("o_above", F.array().cast("array<bigint>")), F.col("above"))
    return stored(joined.withColumns(columns).select(*found.columns), f"{folder}/joined")


def build_forest(
    rows: DataFrame,
    group_cols: Sequence[str] = ("client_ip", "user_agent", "session_id"),
    node: str = "node",
    ts: str = "ts",
    ambiguity: str = "reference",
    path: bool = False,
    block_rows: int = BLOCK_ROWS,
    drop: Sequence[str] = (),
) -> DataFrame:
    """T2 + T3: referer forest of each group (a session); needs ``page_key`` and ``referer_key`` columns.

    The rows are written first, as finding parents reads them twice. ``drop``: columns
    that are not needed once parents are found, such as the two keys.
    """
    folder = work_folder(rows.sparkSession, "forest")
    rows = stored(rows, f"{folder}/rows")
    with_parents = assign_parents(rows, group_cols, node=node, ts=ts, ambiguity=ambiguity).drop(*drop)
    return resolve(with_parents, group_cols, node=node, ts=ts, path=path, folder=folder, rows=rows, block_rows=block_rows)


def click_tree(
    forest: DataFrame, clicks: DataFrame, group_cols: Sequence[str], node: str = "node", click_node: str = "click_node"
) -> DataFrame:
    """Forest rows of the tree that holds each click's request (clicks outside any tree drop out).

    ``clicks`` has the group columns and ``click_node``.
    """
    g = list(group_cols)
    wanted = clicks.select(*g, F.col(click_node).cast("bigint").alias("_cn"))
    nodes = forest.select(*g, F.col(node).cast("bigint").alias("_cn"), "root")
    roots = null_safe_join(nodes, wanted.distinct(), [*g, "_cn"], "left_semi").select(*g, "root").distinct()
    return null_safe_join(forest, roots, [*g, "root"], "left_semi")


def pick_tree(forest: DataFrame, group_cols: Sequence[str], seed: str) -> DataFrame:
    """one tree per group, chosen by a seeded md5 rank over the roots; returns that tree's nodes."""
    g = list(group_cols)
    roots = forest.where(F.col("parent").isNull()).select(*g, "root")
    rank = F.struct(F.md5(F.concat(F.col("root").cast("string"), F.lit(seed))), F.col("root"))
    chosen = roots.groupBy(*g).agg(F.min_by("root", rank).alias("root"))
    return null_safe_join(forest, chosen, g + ["root"], "left_semi")


def tree_metrics(
    forest: DataFrame,
    group_cols: Sequence[str] = (),
    node: str = "node",
    ts: str = "ts",
    with_dfsness: bool = True,
    more: dict[str, Column] | None = None,
) -> DataFrame:
    """One row of metrics per tree (group columns + ``root``) of a resolved forest.

    size, size_sum (sum of subtree sizes = sum of depth + 1), size_sq_sum,
    num_leafs, depth_max, depth_sum (sum of subtree heights), degree_max,
    degree_sum (edges), timediff_sum over edges, timediff_min/max over the
    root's own children (NULL for a single node), ambiguous_max/sum,
    mean_time_diff = timediff_sum / max(1, degree_sum) and dfsness. All but
    the last are one aggregate over the nodes. Time sums are exact integer
    microseconds, turned into seconds once. ``more``: further aggregates by name.
    """
    g, more = list(group_cols), more or {}
    dt = F.unix_micros(F.col(ts)) - F.unix_micros(F.col("parent_ts"))
    amb = F.col("parent_ambiguous").cast("int")
    seconds = lambda c: c.cast("double") / F.lit(1e6)
    m = forest.groupBy(*g, "root").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.col("depth").cast("bigint") + 1).alias("size_sum"),
        F.sum(F.col("subtree") * F.col("subtree")).alias("size_sq_sum"),
        F.count_if(F.col("n_children") == 0).alias("num_leafs"),
        F.max("depth").cast("bigint").alias("depth_max"),
        F.sum("height").cast("bigint").alias("depth_sum"),
        F.max("n_children").cast("bigint").alias("degree_max"),
        F.count(dt).alias("degree_sum"),
        seconds(F.coalesce(F.sum(dt), F.lit(0))).alias("timediff_sum"),
        seconds(F.min(F.when(F.col("depth") == 1, dt))).alias("timediff_min"),
        seconds(F.max(F.when(F.col("depth") == 1, dt))).alias("timediff_max"),
        F.max(amb).cast("bigint").alias("ambiguous_max"),
        F.sum(amb).cast("bigint").alias("ambiguous_sum"),
        # a choice needs two nodes with children, one of them with two or more
        F.count_if(F.col("n_children") > 0).alias("_inner"),
        *[c.alias(n) for n, c in more.items()],
    )
    m = m.withColumn("mean_time_diff", F.col("timediff_sum") / F.greatest(F.lit(1), F.col("degree_sum")))
    if not with_dfsness:
        return m.drop("_inner")
    # a tree goes by a number from here on; it is read back from the written table, so it does not change
    m = stored(m.withColumn("_tree", F.monotonically_increasing_id()), f"{work_folder(forest.sparkSession, 'tree-metrics')}/m")
    choice = m.where("_inner >= 2 and degree_max >= 2").select(*g, "root", "_tree")
    nodes = forest.select(*g, "root", node, "parent", ts, "tie_level", "n_children")
    scored = dfsness(null_safe_join(nodes, choice, [*g, "root"]).drop(*g, "root").withColumnRenamed("_tree", "root"), node=node, ts=ts)
    scored = scored.withColumnRenamed("root", "_tree")
    return m.drop("_inner").join(scored, "_tree", "left").select(*[c for c in m.columns if c not in ("_inner", "_tree")], "dfsness")


def running(df: DataFrame, keys: Sequence[str], slot: str, order: Sequence[str], sums: dict[str, Column], totals: dict[str, Column] | None = None) -> DataFrame:
    """Adds, per name in ``sums``, the sum of its column over the rows of the same ``keys`` that come earlier in ``order``.

    A prefix sum in two levels: ``slot`` divides a key's rows into consecutive
    blocks, each block is summed by an aggregate, a window over the small table
    of blocks gives what lies before a block, and a window inside the block the
    rest. ``totals`` adds sums over all rows of a key. ``df`` is read twice: it should be a written table.
    """
    keys, totals = list(keys), totals or {}
    in_slot = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    in_key = Window.partitionBy(*keys)
    earlier = in_key.orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    blocks_ = df.groupBy(*keys, slot).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in (sums | totals).items()])
    blocks_ = blocks_.select(
        *keys,
        slot,
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), none).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(in_key).alias(n) for n in totals],
    )
    local = df.withColumns({f"_l_{n}": F.coalesce(F.sum(c).over(in_slot), none) for n, c in sums.items()})
    out = local.join(blocks_, [*keys, slot]).withColumns({n: F.col(f"_b_{n}") + F.col(f"_l_{n}") for n in sums})
    return out.drop(*[f"{x}{n}" for n in sums for x in ("_b_", "_l_")])


def visits(nodes: DataFrame, folder: str) -> DataFrame:
    """Adds to the nodes (``t, n, p, us, tie_level, hour, opens, closes``) their visit position ``s`` in their tree, the sibling
    groups opened before (``number``), those open (``k``) and those of the whole tree (``groups``).

    Nodes are visited in time order. Of several waiting with one timestamp, the
    one goes first whose siblings wait longest, that is, whose parent was
    visited first; siblings go in trace order. A child with its parent's own
    timestamp only starts to wait at its parent's visit, so equal timestamps are
    visited level by level. Everything is one prefix sum over hours. Where
    nodes of different parents tie, the places of their parents decide, then of
    the parents' parents, and so on, last the trace order of the ancestors that
    are siblings. Both are found by doubling: after round k, tied nodes are
    ordered by 2^k ancestors, so a tree needs as many rounds as the logarithm
    of its depth, however many generations tie; only trees with such ties take part.
    """
    sums = {"number": F.col("opens"), "k": F.col("opens") - F.col("closes")}
    sums, totals = {n: c.cast("bigint") for n, c in sums.items()}, {"groups": F.col("opens").cast("bigint")}
    placed = stored(running(nodes, ["t"], "hour", ["us", "tie_level", "n"], {"s": F.lit(1).cast("bigint"), **sums}, totals), f"{folder}/placed")
    tied = placed.groupBy("t", "us", "tie_level").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.min("s").alias("c"))
    doubtful = tied.where("a != b").select("t")
    if doubtful.isEmpty():
        return placed
    doubtful = stored(doubtful.distinct(), f"{folder}/doubtful")
    own = placed.join(doubtful, "t", "left_semi").join(tied.select("t", "us", "tie_level", "c"), ["t", "us", "tie_level"])
    # c: the first place of those that tie so far; q: order by trace positions of 2^k ancestors, the farthest first
    state = stored(own.select("t", "n", "p", "c", F.col("n").alias("q"), F.col("p").alias("up")), f"{folder}/ties")
    k = 0
    while True:
        open_ = state.groupBy("t", "c").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a != b")
        if open_.isEmpty() or state.where("up is not null").isEmpty():
            break
        above = state.select("t", F.col("n").alias("up"), F.col("c").alias("up_c"), F.col("q").alias("up_q"), F.col("up").alias("up_up"))
        tie = Window.partitionBy("t", "c")
        state = state.join(above, ["t", "up"], "left").select(
            "t",
            "n",
            "p",
            (F.col("c") + F.rank().over(tie.orderBy("up_c")) - 1).alias("c"),
            F.rank().over(tie.orderBy("up_q", "q")).cast("bigint").alias("q"),
            F.col("up_up").alias("up"),
        )
        state = stored(state, f"{folder}/ties{k}")
        k += 1
    last = Window.partitionBy("t", "c").orderBy("q")
    refined = state.select("t", "n", (F.col("c") + F.row_number().over(last) - 1).alias("s"))
    again = stored(nodes.join(refined, ["t", "n"]), f"{folder}/refined")
    again = running(again, ["t"], "hour", ["s"], sums, totals)
    return stored(placed.join(doubtful, "t", "left_anti").unionByName(again), f"{folder}/replaced")


def dfsness(forest: DataFrame, group_cols: Sequence[str] = (), node: str = "node", ts: str = "ts") -> DataFrame:
    """(group columns, root, dfsness) of the trees of a resolved forest; NULL where no visit had a choice.

    The children of one node are a sibling group. It opens when its parent is
    visited and closes when its last member is. At the visit of a node, k
    groups are open, and ``rank`` of them opened before the node's own; its
    position is rank / (k - 1) for k > 1, and dfsness is the mean position (0
    breadth first, 1 depth first). In the order of visits,
    k is a running count of groups opened minus groups closed (``running``: a prefix sum over hours). Groups are
    numbered as they open, so rank counts groups with a smaller number than the
    node's own (q) that close no earlier than at its visit. [0, q) is cut into
    blocks of powers of two, one per bit of q; a running count over each block's
    closings, in the order of visits, gives what has closed. That is O(n log n)
    rows; no window holds more of a tree than an hour of it, and there is no list per tree.
    """
    g = list(group_cols)
    folder = work_folder(forest.sparkSession, "dfsness")
    us = F.unix_micros(F.col(ts))
    nodes = forest.select(
        F.struct(*g, "root").alias("t"),
        F.col(node).cast("bigint").alias("n"),
        F.col("parent").cast("bigint").alias("p"),
        us.alias("us"),
        "tie_level",
        F.floor(us / F.lit(3_600_000_000)).cast("bigint").alias("hour"),
        (F.col("n_children") > 0).cast("int").alias("opens"),
    )
    # siblings are visited in order of time and trace whatever else ties, so a group's last member is known before any place
    ends = nodes.where("p is not null").groupBy("t", "p").agg(F.max(F.struct("us", "tie_level", "n"))["n"].alias("n"))
    closed = nodes.join(ends.select("t", "n", F.lit(1).alias("closes")), ["t", "n"], "left")
    nodes = stored(closed.withColumn("closes", F.coalesce("closes", F.lit(0))), f"{folder}/nodes")
    walked = visits(nodes, folder)
    own = walked.where("opens = 1").select("t", F.col("n").alias("p"), F.col("number").alias("q"))
    member = stored(walked.where("p is not null").select("t", "hour", "p", "s", "closes", "k", "groups").join(own, ["t", "p"]), f"{folder}/member")
    bits = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("groups") - 1, F.lit(1)))).cast("int"))
    levels = member.select("t", "hour", "s", "q", "k", "closes", F.explode(bits).alias("bit")).withColumn("at", F.expr("shiftright(q, bit)"))
    asks = levels.where("k > 1 and at % 2 = 1").select("t", "hour", "bit", (F.col("at") - 1).alias("block"), "s", "k", F.lit(0).cast("bigint").alias("closed"))
    ends = levels.where("closes = 1 and at % 2 = 0").select("t", "hour", "bit", F.col("at").alias("block"), "s", "k", F.lit(1).cast("bigint").alias("closed"))
    counted = running(asks.unionByName(ends), ["t", "bit", "block"], "hour", ["s", "closed"], {"gone": F.col("closed")})
    gone = counted.where("closed = 0")
    share = gone.groupBy("t").agg(F.sum(F.expr("(shiftleft(1L, bit) - gone) / (k - 1)")).alias("total"))
    chosen = member.where("k > 1").groupBy("t").agg(F.count(F.lit(1)).alias("visits"))
    score = chosen.join(share, "t", "left").select("t.*", (F.coalesce("total", F.lit(0.0)) / F.col("visits")).cast("double").alias("dfsness"))
    return score
