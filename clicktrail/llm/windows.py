"""Order-preserving packing: documents stay in the order of the table and are cut into windows of at most ``capacity`` tokens.

Where windows end is chosen by dynamic programming over the cut points of the
token stream: ends of documents (free), ends of sentences and, inside sentences
longer than ``longest`` tokens, every ``longest`` tokens (both at a penalty).
The cost of a window is its padding plus the penalty of the cut that ends it;
a window whose length is a power of two is not padded. Between two cut points
up to ``runs`` full windows may stand, which end wherever they do, at the
penalty ``inside`` each. With points ``p``, the least cost of a packing that
ends at point j is

    f(j) = penalty(j) + min over m and i of f(i) + m * inside + (m + 1) * capacity - (p[j] - p[i])

over the points i that m full windows and one more window lead to j from. For
each m these points are a sliding band, and the minimum of ``f(i) + p[i]`` in it
is kept by a monotone queue, so each point enters and leaves a band once. The
at most eleven windows whose length is a power of two are looked up beside it.

Every task packs the documents of its own input split, in their order, and
nothing is shuffled. The stream is solved in blocks of about ``block`` tokens;
the last windows of a block are not kept but solved again with the next block,
so a block's end leaves no padding. In the last ``2 * capacity`` tokens of a
split every token is a cut point, so that the rest can be cut into powers of
two. Memory is one block or one document, whichever is larger; no group, source
or key gathers rows, and a repeated task gives the same rows.

Defined cases: null or empty texts are one end token; repeated rows are packed
once per row; null doc_ids stay null; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.textops import chunks
from clicktrail.llm.tokens import bpe_encoding, bpe_ids

END_ID = 0
CAPACITY = 1024
LONGEST = 128
SENTENCE = 1.0  # tokens of padding that a cut at a sentence's end is worth avoiding
INSIDE = 4.0  # the same for a cut inside a sentence
RUNS = 3  # full windows between two cut points
BLOCK = 1 << 18
INFINITE = float("inf")
KEEP_BACK = 16  # windows of a block that are solved again with the next one

WINDOW = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _marks(ranks_file: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Per token id: whether its bytes end a sentence, and whether they begin with white space."""
    encoding = bpe_encoding(ranks_file)
    size = encoding.max_token_value + 1
    ends, space = np.zeros(size, bool), np.zeros(size, bool)
    stops = tuple(s.encode() for s in ".!?。！？\n")
    for i in range(size):
        try:
            b = encoding.decode_single_token_bytes(i)
        except KeyError:
            continue
        ends[i] = b.rstrip(b" \"')").endswith(stops)
        space[i] = b[:1].isspace()
    return ends, space


def sentence_ends(ids: np.ndarray, ranks_file: str | None = None) -> np.ndarray:
    """Positions after which a sentence is over: a token that ends one, before white space."""
    ends, space = _marks(ranks_file)
    return np.flatnonzero(ends[ids[:-1]] & space[ids[1:]]) + 1


def cut_points(ids: np.ndarray, longest: int = LONGEST, sentence: float = SENTENCE, inside: float = INSIDE, ranks_file: str | None = None):
    """Cut points of one document (its end token included) after its start, and their penalties; the last is its end."""
    n = len(ids)
    at = sentence_ends(ids[:-1], ranks_file) if n > 2 else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], at, [n]])
    gaps = np.diff(bounds)
    if gaps.max() > longest:
        more = [np.arange(a + longest, a + g, longest) for a, g in zip(bounds, gaps) if g > longest]
        inner = np.concatenate(more)
        points = np.concatenate([at, inner])
        cost = np.concatenate([np.full(len(at), sentence), np.full(len(inner), inside)])
        order = np.argsort(points, kind="stable")
        at, cost = points[order], cost[order]
    else:
        cost = np.full(len(at), sentence)
    return np.append(at, n), np.append(cost, 0.0)


def windows(points, penalty, capacity: int = CAPACITY, inside: float = INSIDE, runs: int = RUNS) -> list[int]:
    """Where the windows of the cheapest packing end.

    ``points`` ascend from the stream's start (not listed itself, at 0) in steps of at most ``capacity``; the last is its end.
    """
    p = np.concatenate([[0], np.asarray(points, np.int64)])
    n = len(p)
    # windows whose length is a power of two: pairs of points, found by search
    exact: dict[int, list[int]] = {}
    for k in range(capacity.bit_length()):
        begin = np.searchsorted(p, p - (1 << k))
        hit = np.flatnonzero((p[begin] == p - (1 << k)) & (np.arange(n) > 0))
        for j, i in zip(hit.tolist(), begin[hit].tolist()):
            exact.setdefault(j, []).append(i)
    at, cost = p.tolist(), [0.0, *np.asarray(penalty, float).tolist()]
    best, back, key = [0.0] * n, [(0, 0)] * n, [0.0] * n
    # band m of j: the points from which m full windows and one more lead to j, p[first[j]] up to p[beyond[j]] without it;
    # its queue holds those of them that no later one undercuts
    bands = []
    for m in range(runs + 1):
        first = np.searchsorted(p, p - (m + 1) * capacity).tolist()
        beyond = np.searchsorted(p, p - m * capacity).tolist()
        bands.append((m, first, beyond, m * inside + (m + 1) * capacity, deque()))
    entered = [0] * (runs + 1)
    for j in range(1, n):
        f = INFINITE
        for m, first, beyond, extra, queue in bands:
            stop = beyond[j]
            if not stop:
                break  # the stream's start is too near for this and the later bands
            for i in range(entered[m], stop):
                k = key[i]
                while queue and key[queue[-1]] >= k:
                    queue.pop()
                queue.append(i)
            entered[m] = stop
            low = first[j]
            while queue[0] < low:
                queue.popleft()
            g = key[queue[0]] + extra
            if g < f:
                f, way = g, (queue[0], m)
        f -= at[j]
        if j in exact:
            for e in exact[j]:
                if best[e] < f:
                    f, way = best[e], (e, 0)
        best[j] = f = f + cost[j]
        back[j], key[j] = way, f + at[j]
    ends, j = [], n - 1
    while j:
        ends.append(at[j])
        j, m = back[j]
        ends.extend(at[j] + capacity * k for k in range(m, 0, -1))
    return ends[::-1]


class _Stream:
    """The documents of one split that are not packed yet, and the windows cut from them."""

    def __init__(self, capacity, longest, sentence, inside, block, ranks_file):
        self.capacity, self.block, self.inside = capacity, block, inside
        self.rule = (longest, sentence, inside, ranks_file)
        self.docs = deque()  # (doc_id, ids, tokens already packed)
        self.points, self.cost = deque(), deque()  # per document, relative to its start
        self.waiting = self.sequence = 0

    def add(self, doc_id, ids):
        """The documents' next windows, once enough tokens wait."""
        points, cost = cut_points(ids, *self.rule)
        self.docs.append((doc_id, ids, 0))
        self.points.append(points)
        self.cost.append(cost)
        self.waiting += len(ids)
        return self.solve(False) if self.waiting >= self.block else []

    def solve(self, last: bool):
        if not self.docs:
            return []
        starts, total = [], 0
        for _, ids, done in self.docs:
            starts.append(total - done)  # stream position of the document's first token
            total += len(ids) - done
        points = np.concatenate([p + s for p, s in zip(self.points, starts)])
        cost = np.concatenate(list(self.cost))
        if last:
            tail = np.arange(max(1, total - 2 * self.capacity), total)
            new = np.setdiff1d(tail, points, assume_unique=True)
            points, cost = np.concatenate([points, new]), np.concatenate([cost, np.full(len(new), self.inside)])
            order = np.argsort(points, kind="stable")
            points, cost = points[order], cost[order]
        ends = windows(points, cost, self.capacity, self.inside)
        if not last:
            ends = ends[: max(0, len(ends) - KEEP_BACK)]
            if not ends:
                self.block = 2 * self.waiting
                return []
        return self.cut(ends)

    def cut(self, ends):
        """Takes the windows that end at ``ends`` off the stream: rows of ``WINDOW`` without the sequence's high bits."""
        rows, begin = [], 0
        for end in ends:
            offset = 0
            while begin + offset < end:
                doc_id, ids, done = self.docs[0]
                n = min(len(ids) - done, end - begin - offset)
                rows.append((doc_id, done, n, zlib.crc32(ids[done : done + n].tobytes()), len(ids), self.sequence, offset))
                offset += n
                if done + n == len(ids):
                    self.docs.popleft()
                    self.points.popleft()
                    self.cost.popleft()
                else:
                    self.docs[0] = (doc_id, ids, done + n)
            self.sequence += 1
            self.waiting -= end - begin
            begin = end
        if self.docs and self.docs[0][2]:
            ahead = self.points[0] > self.docs[0][2]
            self.points[0], self.cost[0] = self.points[0][ahead], self.cost[0][ahead]
        return rows


def _packed(batches, stream: _Stream, ranks_file):
    encode, end = bpe_ids(ranks_file), np.array([END_ID], np.uint32)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in WINDOW.split(", ")])
    base = TaskContext.get().partitionId() << 40

    def batch_of(rows):
        cols = list(zip(*rows))
        cols[5] = [base + s for s in cols[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    for batch, texts in chunks(batches):
        rows = []
        for d, t in zip(batch.column("doc_id").to_pylist(), texts):
            rows += stream.add(d, np.concatenate([encode(t.decode()), end]).astype("<u4", copy=False))
        if rows:
            yield batch_of(rows)
    rows = stream.solve(True)
    if rows:
        yield batch_of(rows)


def pack_in_order(
    docs: DataFrame,
    capacity: int = CAPACITY,
    longest: int = LONGEST,
    sentence: float = SENTENCE,
    inside: float = INSIDE,
    block: int = BLOCK,
    ranks_file: str | None = None,
) -> DataFrame:
    """One row per piece of ``docs`` (``doc_id, text``): its place in the document and in its window, checksum, length of the document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    longest = min(longest, capacity)
    return source.mapInArrow(lambda it: _packed(it, _Stream(capacity, longest, sentence, inside, block, ranks_file), ranks_file), WINDOW)
