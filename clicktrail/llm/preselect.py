"""Choosing few documents in a scan before their texts move: a bitmap of fixed size, made exact by a join after it.

The bitmap has ``2 ** BITS`` bits (2 MB) whatever the corpus, so it may be
broadcast; documents that share a bit with a wanted one pass it too, and the
caller's join on the id removes them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24
_MASK = (1 << BITS) - 1


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """Packed bits of the column ``doc_id``, set by partial aggregation; null ids have none, as their rows always pass."""
    bit = F.expr(f"((doc_id ^ shiftright(doc_id, {BITS})) & {_MASK}) + 1")
    parts = ids.where("doc_id is not null").select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("k"))
    out = np.zeros(1 << BITS, bool)
    for r in parts.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect():
        part = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[(r.k - 1) * len(part) : r.k * len(part)] = part
    return np.packbits(out)


def preselected(batches, bitmap: np.ndarray):
    """The rows of Arrow batches whose ``doc_id`` may be wanted; rows without one always pass."""
    bits = np.unpackbits(bitmap).view(bool)
    for batch in batches:
        ids = batch.column("doc_id")
        key = ids.fill_null(0).to_numpy()
        keep = bits[(key ^ (key >> BITS)) & _MASK] | ids.is_null().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(keep))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents that may be among ``ids`` (``doc_id``): a scan of all, of which few rows come out."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda it: preselected(it, shared.value), "doc_id long, text string")
