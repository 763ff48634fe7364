"""Benchmark decontamination: broadcast n-gram windows of the test items, verified in the documents.

The windows of all items go to the executors as sorted hash arrays. A scan of
the documents looks every word window up, verifies the hits against the item's
own words, and marks the words they cover. Item windows are broadcast in
blocks of at most ``block_windows`` windows, so one broadcast has a fixed size
bound; more items mean more blocks (each one more scan), never fewer windows.

Defined cases: null or empty document texts have no words and no hits; null
item ids or item texts without words give no window; an item of fewer than
``n`` words is one window of its own length; repeated items count once;
repeated documents give one row each; other columns of either table are not
read, so clashing names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.textops import ALNUM, Words, chunks

BLOCK_WINDOWS = 1_000_000
OUT = "row_id long, doc_id long, n_words long, hits array<struct<first:int,last:int>>, spans array<struct<start:long,end:long>>, items array<string>"


def _item_windows(items, n: int):
    """(length, hash, window bytes, item id) of each distinct window of each item."""
    for item_id, text in items:
        w = Words([(text or "").encode()], ALNUM)
        size = min(n, len(w.hash))
        if item_id is None or not size:
            continue
        words = [w.buf[s:e].tobytes() for s, e in zip(w.start, w.end)]
        at, hashes = w.windows(size)
        for i, h in zip(at.tolist(), hashes.tolist()):
            yield size, h, b" ".join(words[i : i + size]), str(item_id)


def window_blocks(items, n: int, block_windows: int):
    """Blocks for broadcast: per window length, sorted hashes with the texts and item ids behind each."""
    block, held = {}, 0
    for size, h, text, item in _item_windows(items, n):
        block.setdefault(size, {}).setdefault(h, {}).setdefault(text, set()).add(item)
        held += 1
        if held >= block_windows:
            yield _frozen(block)
            block, held = {}, 0
    if block:
        yield _frozen(block)


def _frozen(block):
    return {size: (np.array(sorted(by), np.uint64), [by[h] for h in sorted(by)]) for size, by in block.items()}


def _scan(batches, block):
    for batch, texts in chunks(batches):
        w = Words(texts, ALNUM)
        cover = np.zeros(len(w.hash) + 1, np.int32)
        items: list[set[str]] = [set() for _ in texts]
        for size, (known, behind) in block.items():
            at, hashes = w.windows(size)
            k = np.searchsorted(known, hashes)
            k[k == len(known)] = 0
            for i, j in zip(at[hit := known[k] == hashes].tolist(), k[hit].tolist()):
                text = b" ".join(w.buf[w.start[x] : w.end[x]].tobytes() for x in range(i, i + size))
                if text in behind[j]:
                    items[w.doc[i]] |= behind[j][text]
                    cover[i] += 1
                    cover[i + size] -= 1
        run = np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]])
        hits, spans = [[] for _ in texts], [[] for _ in texts]
        # a run of hit words ends at its document's last word
        begins = np.flatnonzero((run[1:-1] == 1) & ((run[:-2] == 0) | np.isin(np.arange(len(run) - 2), w.first)))
        for b in begins.tolist():
            d = int(w.doc[b])
            stop = int(w.first[d + 1])
            e = b
            while e < stop and run[e + 1]:
                e += 1
            hits[d].append({"first": b - int(w.first[d]), "last": e - 1 - int(w.first[d])})
            base = int(w.doc_start[d])
            spans[d].append({"start": int(w.start[b]) - base, "end": int(w.end[e - 1]) - base})
        yield pa.RecordBatch.from_pydict(
            {
                "row_id": batch.column("row_id"),
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(w.count, pa.int64()),
                "hits": pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
        )


def find_contamination(docs: DataFrame, items: DataFrame, n: int = 13, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Hit words, byte spans and item ids per document (``doc_id, text``) against ``items`` (``item_id, text``).

    ``hits`` are runs of hit words (first and last word index), ``spans`` the
    same as byte ranges of the text, ``items`` the sorted ids, as strings, of
    the items with a window in the document.
    """
    spark = docs.sparkSession
    source = docs.select(F.lit(0).cast("long").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = ((r[0], r[1]) for r in items.select("item_id", "text").where("text is not null").toLocalIterator())
    blocks = [spark.sparkContext.broadcast(b) for b in window_blocks(rows, n, block_windows)]
    if len(blocks) > 1:  # blocks are combined per row, and doc_id may repeat
        source = source.withColumn("row_id", F.monotonically_increasing_id())
    if not blocks:
        blocks = [spark.sparkContext.broadcast({})]
    parts = [source.mapInArrow(lambda it, b=b: _scan(it, b.value), OUT) for b in blocks]
    if len(parts) == 1:
        return parts[0].drop("row_id")
    return _combine(parts)


def _combine(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("row_id", "doc_id").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    fold = "aggregate({c}, cast(array() as {t}), (a, x) -> if(size(a) > 0 and x.{s} <= element_at(a, -1).{e}{gap}, concat(slice(a, 1, size(a) - 1), array(named_struct('{s}', element_at(a, -1).{s}, '{e}', greatest(element_at(a, -1).{e}, x.{e})))), concat(a, array(x))))"
    return merged.select(
        "doc_id",
        "n_words",
        F.expr(fold.format(c="hits", t="array<struct<first:int,last:int>>", s="first", e="last", gap=" + 1")).alias("hits"),
        F.expr(fold.format(c="spans", t="array<struct<start:long,end:long>>", s="start", e="end", gap="")).alias("spans"),
        "items",
    )


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: some hit, and at least one word in ``share`` hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["last"] - x["first"] + 1))
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with their contaminated spans cut out, for unique ``doc_id``; other columns stay as they are."""
    spans = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_cut_id"), F.col("spans").alias("_cut_spans"))
    joined = docs.join(spans, F.col("doc_id") == F.col("_cut_id"), "left")
    cut = F.expr(
        "decode(aggregate(_cut_spans, named_struct('kept', cast('' as binary), 'at', 0L),"
        " (a, s) -> named_struct('kept', concat(a.kept, substring(cast(text as binary), cast(a.at + 1 as int), cast(s.start - a.at as int))), 'at', s.end),"
        " a -> concat(a.kept, substring(cast(text as binary), cast(a.at + 1 as int)))), 'UTF-8')"
    )
    return joined.withColumn("text", F.when(F.col("_cut_id").isNotNull(), cut).otherwise(F.col("text"))).drop("_cut_id", "_cut_spans")
