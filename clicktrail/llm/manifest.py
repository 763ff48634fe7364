"""Merkle manifest of a table: every document gets a proof that leads to one root.

A document's leaf is the SHA-256 of its fields. Within a source the leaves
stand in order of doc_id; every 16 of them become one node, level by level,
until one is left, the subroot. The subroots, in order of source, become the
root in the same way.

A leaf's place in its source is found without sorting the rows. The ids of a
source are a bitmap of 64-bit words, made in each task by a partial aggregate
and merged by ``bit_or``; only words with a bit set exist, so a source of three
scattered ids costs three words. Up to 64 words form a container, and running
counts over containers, blocks of 2^20 containers and blocks of those are the
popcount directory: no window holds more than about a million small rows,
however large a source is. A leaf's rank is the count before its container,
plus that of the earlier words, plus the bits below its own in its word. With
the rank known, leaf i belongs to slot ``i % 16`` of node ``i div 16``: each level is one
aggregate that fills slot arrays of 16. Proofs go back down: a run hands the
runs below it the siblings of their nodes, one join a level, so what is
shuffled shrinks 16-fold with each level.

Defined cases: null fields are ``-`` in a leaf, a null source is a source of
its own, ordered first; null doc_ids stand first in their source. Rows of one
(source, doc_id) are ranked among themselves by the first 60 bits of their
leaf, equal ones by their row number, both through bitmaps of their own, so a
doc_id that a third of all rows share is not sorted in one task either. Equal
rows are leaves of their own. A table of one document has its leaf as root; an
empty table gives no rows. Columns besides the five of a leaf are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicktrail.sources.work import stored, work_folder

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_KEY = -(1 << 62)  # container of null keys: below every shifted 64-bit integer


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, optionally with another ``text``."""
    return F.sha2(F.concat(*[_field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]), 256)


def lowered(text: str = "text") -> Column:
    """``text`` with A-Z in lower case: the tampering that the manifest's own check uses."""
    return F.translate(F.col(text).cast("string"), UPPER, LOWER)


# ---------------------------------------------------------------- ranks


def ranked(rows: DataFrame, group: str, key: Column, folder: str) -> tuple[DataFrame, bool]:
    """Adds ``at`` (rows of the group with a smaller key; null is the smallest), ``same`` (rows with the row's own key)
    and ``n`` (rows of the group); and whether any key occurs twice in a group."""
    key = key.cast("bigint")
    keyed = rows.withColumns(
        {
            "_c": F.coalesce(F.shiftright(key, 12), F.lit(NO_KEY)),
            "_w": F.coalesce(F.shiftright(key, 6).bitwiseAND(63), F.lit(0)).cast("int"),
            "_p": F.coalesce(key.bitwiseAND(63), F.lit(0)).cast("int"),
        }
    )
    words = keyed.groupBy(group, "_c", "_w").agg(F.expr("bit_or(shiftleft(1L, _p))").alias("bits"), F.count("*").alias("n"))
    containers = words.groupBy(group, "_c").agg(F.array_sort(F.collect_list(F.struct("_w", "bits", "n"))).alias("words"), F.sum("n").alias("held"))
    containers = stored(containers, f"{folder}/containers")
    crowded = containers.select(group, "_c", F.explode("words").alias("x")).where("x.n > bit_count(x.bits)")
    ties = not crowded.isEmpty()
    found = keyed.join(_directory(containers, group), [group, "_c"])
    own = F.element_at(F.filter("words", lambda x: x["_w"] == F.col("_w")), 1)
    found = found.withColumn("_own", own).withColumn(
        "_before", F.col("before") + F.aggregate(F.filter("words", lambda x: x["_w"] < F.col("_w")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    )
    lower = F.expr("bit_count(_own.bits & ~shiftleft(-1L, _p))").cast("bigint")
    plain = found.withColumns({"at": F.col("_before") + lower, "same": F.lit(1).cast("bigint")})
    if ties:
        # words in which some id occurs more than once: the rows of each of its 64 ids are counted
        crowded = crowded.select(group, "_c", F.col("x._w").alias("_w"))
        each = keyed.join(crowded, [group, "_c", "_w"], "left_semi").groupBy(group, "_c", "_w", "_p").agg(F.count("*").alias("m"))
        each = each.groupBy(group, "_c", "_w").agg(F.collect_list(F.struct("_p", "m")).alias("each"))
        counted = found.join(each, [group, "_c", "_w"], "left")
        ahead = lambda test: F.aggregate(F.filter("each", test), F.lit(0).cast("bigint"), lambda a, x: a + x["m"])
        plain = counted.withColumns(
            {
                "at": F.col("_before") + F.coalesce(ahead(lambda x: x["_p"] < F.col("_p")), lower),
                "same": F.coalesce(ahead(lambda x: x["_p"] == F.col("_p")), F.lit(1).cast("bigint")),
            }
        )
    return plain.select(*rows.columns, "at", "same", "n"), ties


def _directory(containers: DataFrame, group: str) -> DataFrame:
    """Per container its words, the rows before it in its group (``before``) and the group's rows (``n``)."""
    up = lambda bits: F.shiftright("_c", bits)
    counts = containers.select(group, up(40).alias("_t"), up(20).alias("_m"), "held")
    middle = counts.groupBy(group, "_t", "_m").agg(F.sum("held").alias("held"))
    top = middle.groupBy(group, "_t").agg(F.sum("held").alias("held"))
    earlier = lambda by, order: F.coalesce(F.sum("held").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = top.select(group, "_t", earlier([group], "_t").alias("_top"), F.sum("held").over(W.partitionBy(group)).alias("n"))
    middle = middle.select(group, "_t", "_m", earlier([group, "_t"], "_m").alias("_middle"))
    low = containers.withColumn("_m", up(20)).withColumn("_low", earlier([group, "_m"], "_c"))
    placed = low.join(middle, [group, "_m"]).join(top, [group, "_t"])
    return placed.select(group, "_c", "words", "n", (F.col("_top") + F.col("_middle") + F.col("_low")).alias("before"))


def coordinates(leaves: DataFrame, folder: str) -> DataFrame:
    """Adds ``i``, the leaf's place in its source, and ``n``, the leaves of the source (columns ``k, doc_id, leaf, row``)."""
    found, ties = ranked(leaves, "k", F.col("doc_id"), f"{folder}/ids")
    if not ties:
        return found.withColumnRenamed("at", "i").drop("same")
    found = stored(found.withColumnsRenamed({"at": "i", "n": "total"}), f"{folder}/ranked")
    done = found.where("same = 1").drop("same")
    digest = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("bigint")
    for depth, (key, by) in enumerate(((digest, F.struct("k", "doc_id")), (F.col("row"), F.struct("k", "doc_id", digest.alias("digest"))))):
        tied, more = ranked(found.where("same > 1").drop("same").withColumn("_g", by), "_g", key, f"{folder}/ties{depth}")
        found = stored(tied.withColumn("i", F.col("i") + F.col("at")).drop("_g", "at", "n"), f"{folder}/tied{depth}")
        done = done.unionByName(found.where("same = 1").drop("same"))
        if not more:
            break
    return done.withColumnRenamed("total", "n")


# ---------------------------------------------------------------- trees


def grow(nodes: DataFrame, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of a forest of 16-ary trees and their tops (``k, h``).

    ``nodes``: ``k`` (tree), ``n`` (its leaves), ``i`` (place), ``h`` and ``row`` (anything that goes with a leaf). A level
    holds its runs: ``k, n, node, slots`` (slot, h, at the lowest level also row, in order) and the run's own ``h``.
    """
    levels, tops = [], nodes.where("n = 1").select("k", "h")
    while True:
        rest = [c for c in nodes.columns if c == "row"]
        slot = F.struct((F.col("i") % FAN).cast("int").alias("slot"), "h", *rest)
        runs = nodes.where("n > 1").groupBy("k", "n", F.expr(f"i div {FAN}").alias("node")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
        runs = runs.withColumn("h", F.sha2(F.array_join(F.transform("slots", lambda s: s["h"]), ""), 256))
        runs = stored(runs, f"{folder}/level{len(levels)}")
        most = runs.agg(F.max("n")).first()[0]
        if most is None:
            return levels, tops
        levels.append(runs)
        nodes = runs.select("k", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("node").alias("i"), "h")
        tops = tops.unionByName(nodes.where("n = 1").select("k", "h"))
        if most <= FAN:
            return levels, tops


def _around(slots: Column | str, at: Column) -> Column:
    """The digests before and after slot ``at`` of a run."""
    part = lambda test: F.array_join(F.transform(F.filter(slots, test), lambda s: s["h"]), "")
    return F.struct(part(lambda s: s["slot"] < at).alias("before"), part(lambda s: s["slot"] > at).alias("after"))


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame | None:
    """The lowest runs (``k, slots``) with ``path``, the siblings of the run's node and of the nodes over it, and the other columns of ``above``.

    ``above`` has one row per tree: ``k``, ``path`` (the siblings of its top) and what else its leaves should carry.
    """
    full, carried = None, [c for c in above.columns if c not in ("k", "path")]
    for runs in reversed(levels):
        runs = runs.select("k", "n", "node", "slots")
        here = runs.where(f"n <= {FAN}").join(above, "k").drop("n")
        if full is not None:
            parent = full.select("k", F.col("node").alias("up"), F.col("slots").alias("_over"), "path", *carried)
            low = runs.where(f"n > {FAN}").withColumn("up", F.expr(f"node div {FAN}")).join(parent, ["k", "up"])
            step = _around("_over", (F.col("node") % FAN).cast("int"))
            here = here.unionByName(low.withColumn("path", F.concat(F.array(step), F.col("path"))).drop("n", "up", "_over"))
        full = here
    return full


def opened(levels: list[DataFrame], lone: DataFrame, above: DataFrame) -> DataFrame:
    """Every leaf of a forest: ``h``, ``row``, ``path`` from its own siblings up, and what ``above`` carries. ``lone``: leaves of trees of one."""
    alone = lone.join(above, "k")
    if not levels:
        return alone
    runs = descend(levels, above)
    each = runs.withColumn("x", F.explode("slots"))
    path = F.concat(F.array(_around("slots", F.col("x.slot"))), F.col("path"))
    return each.select("k", F.col("x.h").alias("h"), F.col("x.row").alias("row"), path.alias("path"), *above.columns[2:]).unionByName(alone.select("k", "h", "row", *above.columns[1:]))


def _in_order(tops: DataFrame, folder: str) -> DataFrame:
    """Adds ``i`` and ``n``: a range-partitioned sort, each row's place in its partition, and the rows of the partitions before."""
    ordered = tops.repartitionByRange("k").sortWithinPartitions("k").withColumn("id", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("part", F.shiftright("id", 33)), f"{folder}/ordered")
    parts = ordered.groupBy("part").agg(F.count("*").alias("m"))  # one row per shuffle partition
    before = F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"), F.sum("m").over(W.partitionBy()).alias("n"))
    place = F.col("id").bitwiseAND((1 << 33) - 1) + F.col("before")
    return ordered.join(parts, "part").select(F.lit("").alias("k"), "n", place.alias("i"), "h", F.col("k").alias("row"))


def manifest(docs: DataFrame, tampered: Column | None = None, altered: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, path`` and ``altered``.

    ``path`` lists, from the leaf up, the digests before and after the node at each level. ``altered`` is the leaf of the
    row with ``altered`` as its text where ``tampered`` holds, else null.
    """
    folder = work_folder(docs.sparkSession, "manifest")
    changed = F.when(F.coalesce(tampered, F.lit(False)) & F.col("text").isNotNull(), leaf(altered)) if tampered is not None else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("k"), leaf().alias("leaf"), changed.alias("altered"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), f"{folder}/leaves")
    placed = coordinates(rows, folder)
    nodes = placed.select("k", "n", "i", F.col("leaf").alias("h"), F.struct("doc_id", "altered").alias("row"))
    nodes = stored(nodes, f"{folder}/nodes")
    levels, tops = grow(nodes, f"{folder}/source")
    subroots = stored(_in_order(tops, folder), f"{folder}/subroots")
    upper, root = grow(subroots, f"{folder}/table")
    root = root.first()
    top = docs.sparkSession.range(1).select(F.lit("").alias("k"), F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("path"))
    lone = subroots.where("n = 1").select("k", "h", "row")
    above = opened(upper, lone, top).select(F.col("row").alias("k"), "path", F.col("h").alias("subroot"))
    above = stored(above, f"{folder}/above")
    lone = nodes.where("n = 1").select("k", "h", "row")
    out = opened(levels, lone, above)
    return out.select("row.doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root.h if root else None).cast("string").alias("root"), "path", "row.altered")


def folded(leaf: Column, path: Column) -> Column:
    """The root to which a leaf and its siblings lead."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)
