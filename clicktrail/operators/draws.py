"""Bootstrap weights of many rows at once: md5(prefix || replicate) as array arithmetic, many (row, replicate) pairs a step.

A Poisson(1) weight reads the first 32 bits of a digest, as ``stats.poisson1_from_md5`` does. Here digests are made in
tiles of rows x replicates: what the replicates of a row share (the blocks and words before the number) is done once per
row, and of the last block only the steps that those 32 bits depend on. Every weight is the one that the md5 of the text
gives; the tiles are reduced to sums per group and replicate as they are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

TILE = 32_768  # pairs in a tile: its arrays, 128 KB each, stay in a core's cache
SUMS = 2_097_152  # rows x replicates summed before they are handed on: bounds the sums held, if every row is a group of its own

# arrays without dimensions: numpy takes them faster than numbers
_STEPS = [np.array(int(abs(math.sin(i + 1)) * 2**32), np.uint32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_LEFT = [np.array(_TURNS[i // 16][i % 4], np.uint32) for i in range(64)]
_RIGHT = [np.array(32 - _TURNS[i // 16][i % 4], np.uint32) for i in range(64)]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_FIRST_WORD = 61  # steps that the first 32 bits of a digest take; the last of them sets their register


def _aligned(rows: int, columns: int) -> np.ndarray:
    """An array that begins at a cache line; steps over others take a fifth longer."""
    room = np.empty(4 * rows * columns + 64, np.uint8)
    at = -room.ctypes.data % 64
    return room[at : at + 4 * rows * columns].view(np.uint32).reshape(rows, columns)


def _steps(state: list, words: Sequence, first: int, last: int, spare: list) -> tuple[list, list]:
    """Steps ``first`` to ``last`` of md5 in the arrays of ``state``, which are overwritten; words that are None are zero."""
    a, b, c, d = state
    t, u = spare
    add, xor, both, either, left, right = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.left_shift, np.right_shift
    for i in range(first, last):
        if i < 16:
            xor(c, d, t)
            both(t, b, t)
            xor(t, d, t)
        elif i < 32:
            xor(b, c, t)
            both(t, d, t)
            xor(t, c, t)
        elif i < 48:
            xor(b, c, t)
            xor(t, d, t)
        else:
            np.invert(d, t)
            either(t, b, t)
            xor(t, c, t)
        add(t, a, t)
        word = words[_WORD[i]]
        if word is None:
            add(t, _STEPS[i], t)
        elif word.shape == t.shape:
            add(t, word, t)
            add(t, _STEPS[i], t)
        else:  # one row or one column: the sum with the constant is small
            add(t, word + _STEPS[i], t)
        left(t, _LEFT[i], u)
        right(t, _RIGHT[i], t)
        either(t, u, t)
        add(t, b, t)
        a, b, c, d, t = d, t, b, c, a
    return [a, b, c, d], [t, u]


def _words(text: np.ndarray) -> np.ndarray:
    """Bytes (rows, 64) as the sixteen numbers of a block."""
    return np.ascontiguousarray(text).view("<u4").astype(np.uint32, copy=False)


@lru_cache(maxsize=64)
def _ends(length: int, boot: int) -> list[tuple[int, int, list[np.ndarray]]]:
    """What replicates 1..boot add to a text of ``length`` bytes: first and past-last replicate (from 0), and the words of
    their last one or two blocks, zero where the text itself stands."""
    used, out, lo = length % 64, [], 0
    while lo < boot:
        digits = len(str(lo + 1))
        hi = min(boot, 10**digits - 1)
        blocks = 1 + (used + digits + 9 > 64)
        text = np.zeros((hi - lo, 64 * blocks), np.uint8)
        number = np.arange(lo + 1, hi + 1)
        for k in range(digits):
            text[:, used + k] = ord("0") + number // 10 ** (digits - 1 - k) % 10
        text[:, used + digits] = 0x80
        text[:, -8:] = np.frombuffer((8 * (length + digits)).to_bytes(8, "little"), np.uint8)
        found = [_words(text[:, 64 * k : 64 * k + 64]) for k in range(blocks)]
        if out and len(out[-1][2]) == blocks:
            out[-1] = (out[-1][0], hi, [np.concatenate(x) for x in zip(out[-1][2], found, strict=True)])
        else:
            out.append((lo, hi, found))
        lo = hi
    return out


def _after_whole_blocks(text: np.ndarray) -> tuple[list, np.ndarray]:
    """The state after the whole blocks of texts of one length, as columns, and the words of what is left of them."""
    n, length = text.shape
    state = [np.full((n, 1), x, np.uint32) for x in _START]
    for at in range(0, length - length % 64, 64):
        words = [w.reshape(n, 1) for w in _words(text[:, at : at + 64]).T]
        new, _ = _steps([x.copy() for x in state], words, 0, 64, [np.empty((n, 1), np.uint32) for _ in range(2)])
        state = [x + y for x, y in zip(state, new, strict=True)]
    rest = np.zeros((n, 64), np.uint8)
    rest[:, : length % 64] = text[:, length - length % 64 :]
    return state, _words(rest)


def _first_bits(state: list, rest: np.ndarray, blocks: list[np.ndarray], spare: list) -> np.ndarray:
    """The first register of md5, rows x replicates, of texts with ``rest`` left over and ``blocks`` of replicates behind it."""
    *full, mixed = [x[: len(rest)] for x in spare]
    words: list = []
    for k in range(16):
        mine, theirs = rest[:, k : k + 1], blocks[0][:, k].reshape(1, -1)
        some, more = mine.any(), theirs.any()  # both only in the word where the text ends
        words.append(np.add(mine, theirs, out=mixed) if some and more else mine if some else theirs if more else None)
    # until a replicate's word comes, the steps are the same for all replicates of a row
    alike = next(k for k in range(16) if blocks[0][:, k].any())
    small, _ = _steps([x.copy() for x in state], words, 0, alike, [np.empty_like(state[0]) for _ in range(2)])
    for x, y in zip(full, small, strict=False):
        np.copyto(x, y)
    if len(blocks) == 1:
        (_, final, *_), _ = _steps(full[:4], words, alike, _FIRST_WORD, full[4:])
        return np.add(final, state[0], out=final)
    new, left = _steps(full[:4], words, alike, 64, full[4:])
    middle = [x + y for x, y in zip(new, state, strict=True)]
    theirs = [w.reshape(1, -1) if w.any() else None for w in blocks[1].T]
    (_, final, *_), _ = _steps([x.copy() for x in middle], theirs, 0, _FIRST_WORD, left)
    return np.add(final, middle[0], out=final)


class Weights:
    """Weights of texts of bytes for replicates 1..boot: how many of the ascending ``bits`` lie below a digest's first 32 bits."""

    def __init__(self, bits: Sequence[int], boot: int):
        self.bits, self.boot = np.array(bits, np.uint32), boot
        self.rows = max(1, TILE // boot)
        self.spare: dict[int, list[np.ndarray]] = {}
        # by the first 16 bits as the register holds them; NaN where the others decide
        low = np.arange(65_536, dtype=np.uint32) << 16
        below, above = np.searchsorted(self.bits, low), np.searchsorted(self.bits, low | 0xFFFF)
        self.table = np.where(below == above, below, np.nan)[np.arange(65_536, dtype=np.uint16).byteswap()]

    def _weights(self, first: np.ndarray) -> np.ndarray:
        found = self.table.take(first & np.uint32(0xFFFF))
        near = np.flatnonzero(np.isnan(found))
        if len(near):
            found.flat[near] = np.searchsorted(self.bits, first.flat[near].byteswap())
        return found

    def tiles(self, text: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """For texts of one length, tile by tile: the first row, the first and past-last replicate, and the weights."""
        ends = _ends(text.shape[1], self.boot)
        for at in range(0, len(text), self.rows):
            state, rest = _after_whole_blocks(text[at : at + self.rows])
            for lo, hi, blocks in ends:
                if hi - lo not in self.spare:
                    self.spare[hi - lo] = [_aligned(self.rows, hi - lo) for _ in range(7)]
                yield at, lo, hi, self._weights(_first_bits(state, rest, blocks, self.spare[hi - lo]))


def _codes(keys: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's values, and a row that has each. Values that are written alike are alike."""
    seen: dict[str, int] = {}
    columns = [c.to_pylist() for c in keys.columns]
    code = np.array([seen.setdefault(repr(k), len(seen)) for k in zip(*columns, strict=True)] if columns else [0] * keys.num_rows)
    return code, np.unique(code, return_index=True)[1]


def _summed(batch: pa.RecordBatch, dims: Sequence[str], weights: Weights) -> pa.RecordBatch:
    """One row per group of the batch: its key and, per replicate, the sums of weight x ``_y`` and of weights."""
    boot, n = weights.boot, batch.num_rows
    keys = batch.select(list(dims))
    code, one = _codes(keys)
    y = batch.column("_y")
    known = y.is_valid().to_numpy(zero_copy_only=False)
    # sums over the rows: of the values, and of the rows
    both = np.stack([np.where(known, y.to_numpy(zero_copy_only=False), 0.0), np.ones(n)])
    sums = np.zeros((len(one), 2, boot))
    text = batch.column("_id").cast(pa.large_string())
    where = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    length = np.where(text.is_valid().to_numpy(zero_copy_only=False), np.diff(where), -1)
    order = np.lexsort((code, length))
    for alike in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if length[alike[0]] < 0:  # no text, no digest: past all thresholds
            np.add.at(sums, code[alike], (len(weights.bits) * both[:, alike].T)[:, :, None])
            continue
        body = data[where[alike][:, None] + np.arange(length[alike[0]])]
        for at, lo, hi, w in weights.tiles(body):
            mine = alike[at : at + len(w)]
            cuts = [0, *(np.flatnonzero(np.diff(code[mine])) + 1), len(mine)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                sums[code[mine[s]], :, lo:hi] += both[:, mine[s:e]] @ w[s:e]
    empty = ~np.isin(np.arange(len(one)), code[known])  # a group without a value has no sum
    draws = pa.StructArray.from_arrays(
        [
            pa.array(np.tile(np.arange(1, boot + 1, dtype=np.int32), len(one))),
            pa.array(sums[:, 0].ravel(), mask=np.repeat(empty, boot)),
            pa.array(sums[:, 1].ravel().astype(np.int64)),
        ],
        names=["_b", "_sw", "_w"],
    )
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1) * boot, pa.int32()), draws)
    return pa.RecordBatch.from_arrays([*keys.take(pa.array(one)).columns, lists], names=[*dims, "_d"])


def replicate_sums(batches, dims: Sequence[str], bits: Sequence[int], boot: int) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over rows of ``dims``, ``_y`` (double) and ``_id`` (string): per group and replicate of some rows at a time,
    the sums of weight x ``_y`` and of weights, where the weight is read off md5(_id || replicate)."""
    weights, step = Weights(bits, boot), max(16, SUMS // boot)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield _summed(batch.slice(at, step), dims, weights)
