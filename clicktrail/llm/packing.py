"""Best-fit packing with swap-based local search.

Documents become token pieces of at most ``capacity`` tokens (only longer
documents are cut; the odd piece comes first). Full pieces are sequences of
their own. The others are dealt by a hash of their row number into groups of about
``group_pieces`` pieces, and each group is packed by itself: best fit in
decreasing size, then a local search over the underfull bins that moves a
document, or exchanges one for one or two for one, whenever that increases the
sum of squared fills, until emptied bins can be dropped. A group wastes less
than one bin over a common packing, so the cost of the split is below one
sequence per group. A group is bounded, whatever the skew of sources or keys.

Defined cases: null or empty texts are one piece that holds the end token;
repeated documents are packed once per row; an empty table packs to no rows;
other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.textops import chunks
from clicktrail.llm.tokens import bpe_encoder

END_ID = 2
CAPACITY = 1024
GROUP_PIECES = 50_000
PASSES = 30
DONORS = 64  # emptiest bins that a pass tries to empty

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches, capacity: int, with_ids: bool, ranks_file):
    encode = bpe_encoder(ranks_file)
    for batch, texts in chunks(batches):
        doc, piece, start, length, crc, out = [], [], [], [], [], []
        for d, t in zip(batch.column("doc_id").to_pylist(), texts):
            ids = np.array([*encode(t.decode()), END_ID], "<u4")
            odd = len(ids) % capacity or min(capacity, len(ids))
            cuts = [0, *range(odd, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                doc.append(d)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
                out.append(ids[a:b].astype(np.int32) if with_ids else None)
        cols = {
            "doc_id": pa.array(doc, pa.int64()),
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
        }
        if with_ids:
            cols["ids"] = pa.array(out, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(cols)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, ranks_file: str | None = None) -> DataFrame:
    """One row per piece of each document (``doc_id, text``): place in the document, length, checksum, optionally the ids."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda it: _pieces(it, capacity, with_ids, ranks_file), PIECE + ", ids array<int>" * with_ids)


def pack_sizes(sizes, capacity: int = CAPACITY, passes: int = PASSES) -> np.ndarray:
    """Bin number of each size: best fit decreasing, then ``improve``."""
    sizes = np.asarray(sizes, np.int64)
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: some bin has a gap of g
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = open_gaps >> s
        if fits:
            gap = s + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_gap[gap - s].append(b)
        if gap > s:
            open_gaps |= 1 << (gap - s)
    improve(bins, sizes.tolist(), capacity, passes)
    out = np.empty(len(sizes), np.int64)
    for k, members in enumerate(b for b in bins if b):
        out[members] = k
    return out


def improve(bins: list[list[int]], sizes: list[int], capacity: int, passes: int = PASSES) -> None:
    """Swap-based local search, in place: bins that it empties stay as empty lists.

    It takes the emptiest underfull bin as donor and looks, over the other
    underfull bins from the fullest down, for an exchange that fills the other
    bin further at the donor's cost: a document moved, two of the donor's for
    one, or one for one. As the receiver is at least as full as the donor,
    every exchange increases the sum of squared fills, so the search ends: when
    a pass over the ``DONORS`` emptiest bins changes nothing, at the lower bound
    ceil(total / capacity), or after ``passes`` passes.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    used = sum(1 for f in fill if f)
    for _ in range(passes):
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        changed = False
        for donor in under[: max(1, min(len(under) // 2, DONORS))]:
            if used <= least:
                return
            if fill[donor] and _drain(donor, under, bins, fill, sizes, capacity):
                changed = True
                used -= not fill[donor]
        if not changed:
            return


def _drain(donor, under, bins, fill, sizes, capacity) -> bool:
    """Exchanges between a donor and the fuller underfull bins, the fullest first; whether there was any."""
    own, changed = bins[donor], False
    for other in reversed(under):
        if other == donor or fill[other] < fill[donor]:
            continue
        while (gap := capacity - fill[other]) > 0 and own and (change := _best(own, bins[other], sizes, gap)):
            give, take = change
            delta = sum(sizes[i] for i in give) - sum(sizes[i] for i in take)
            own[:] = [i for i in own if i not in give] + list(take)
            bins[other][:] = [i for i in bins[other] if i not in take] + list(give)
            fill[donor] -= delta
            fill[other] += delta
            changed = True
        if not own:
            break
    return changed


def _best(own, theirs, sizes, gap):
    """The exchange that fills ``gap`` the most: (given by the donor, taken back), or None."""
    best, found = 0, None
    pairs = [(i, j) for k, i in enumerate(own) for j in own[:k]] if len(own) <= 64 else []
    for give in [(i,) for i in own] + pairs:
        s = sum(sizes[i] for i in give)
        if len(give) == 1 and best < s <= gap:
            best, found = s, (give, ())
        for t in theirs:
            if best < s - sizes[t] <= gap:
                best, found = s - sizes[t], (give, (t,))
    return found


def _pack_group(pdf: pd.DataFrame, capacity: int, passes: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    bins = pack_sizes(pdf["length"].to_numpy(), capacity, passes)
    pdf = pdf.assign(sequence_id=bins + pdf["grp"].astype("int64") * (1 << 32))
    pdf = pdf.sort_values(["sequence_id"], kind="stable")
    ends = pdf.groupby("sequence_id")["length"].cumsum()
    return pdf.assign(offset=ends - pdf["length"]).drop(columns="grp")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, passes: int = PASSES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``token_pieces``; the rows are written to the checkpoint folder first."""
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").checkpoint()
    odd = pieces.where(F.col("length") < capacity)
    groups = max(1, round(odd.count() / group_pieces))
    spark = pieces.sparkSession
    schema = PIECE + ", sequence_id long, offset long"
    packed = (
        # by the number of a written row, so that equal rows and null keys are dealt out like any others
        odd.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
        .groupBy("grp")
        .applyInPandas(lambda pdf: _pack_group(pdf, capacity, passes), schema)
    )
    full = pieces.where(F.col("length") >= capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def sequences(packed: DataFrame, docs: DataFrame, capacity: int = CAPACITY, ranks_file: str | None = None) -> DataFrame:
    """The training rows: ``sequence_id, ids`` with the pieces' ids in order of their offsets (for unique ``doc_id``)."""
    ids = token_pieces(docs, capacity, True, ranks_file).select("doc_id", "piece", "ids")
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    return joined.groupBy("sequence_id").agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids))").alias("ids")
    )
