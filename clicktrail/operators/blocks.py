"""Trees inside blocks of rows: parent pointers followed within a task, many blocks at a time.

A block is some rows of one group (``_g``, ``_b``), at most a bounded number of
them. Rows arrive sorted by block and node, Arrow batch by Arrow batch; the
blocks that are complete are handled together by pointer doubling on arrays, a
number of steps that grows with the logarithm of the greatest depth. A parent
that is not in its child's block is left for the caller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FOUND = "root bigint, depth int, n_children bigint, subtree bigint, height int, tie_level int, _top bigint, _out boolean"
WEIGHTS = ("_w", "_h", "_k")  # what hangs below a row in other blocks: nodes, height, children


def _values(column: pa.Array) -> np.ndarray:
    """A number column as an array, NULL as 0 or false."""
    return pc.fill_null(column, pa.scalar(False if pa.types.is_boolean(column.type) else 0, column.type)).to_numpy(zero_copy_only=False)


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays of one type and length differ, structs and lists by their contents; NULL equals NULL, NaN equals NaN."""
    out = pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    if pa.types.is_struct(a.type):
        for x, y in zip(a.flatten(), b.flatten(), strict=True):
            out = out | _differ(x, y)
    elif pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        long, other = (_values(pc.list_value_length(c)) for c in (a, b))
        out = out | (long != other)
        both = np.flatnonzero(~out & (long > 0))  # rows whose lists are of one length are compared element by element
        if len(both):
            owner = np.repeat(both, long[both])
            out[owner[_differ(a.take(pa.array(both)).flatten(), b.take(pa.array(both)).flatten())]] = True
    elif not pa.types.is_null(a.type):
        unlike = pc.not_equal(a, b)
        if pa.types.is_floating(a.type):
            unlike = pc.and_(unlike, pc.invert(pc.and_(pc.is_nan(a), pc.is_nan(b))))
        out = out | pc.fill_null(unlike, False).to_numpy(zero_copy_only=False)
    return out


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """Rows (but the first) whose block differs from that of the row before."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for name in ("_g", "_b"):
        c = batch.column(name)
        out |= _differ(c[1:], c[:-1])
    return out


def _same_block(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    """Whether the last row of ``a`` and the first of ``b`` are of one block."""
    return not any(_differ(a.column(c)[-1:], b.column(c)[:1])[0] for c in ("_g", "_b"))


def _paths(node: np.ndarray, up: np.ndarray, depth: np.ndarray) -> pa.Array:
    """Node ids from the top of a row's tree in its block down to the row."""
    ends = np.cumsum(depth + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.int64)
    at, row, here = ends - 1, np.arange(len(node)), np.arange(len(node))
    while len(row):
        out[at[row]] = node[here]
        at[row] -= 1
        here = up[here]
        keep = here >= 0
        row, here = row[keep], here[keep]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))


def _solved(table: pa.Table, path: bool) -> pa.RecordBatch:
    """The rows of whole blocks with what ``FOUND`` names."""
    batch = table.combine_chunks().to_batches()[0]
    node, parent = _values(batch.column("_n")), _values(batch.column("_p"))
    linked = batch.column("_p").is_valid().to_numpy(zero_copy_only=False)
    n = len(node)
    block = np.concatenate([[0], np.cumsum(_changes(batch))]).astype(np.int64)
    _, number = np.unique(np.concatenate([node, parent]), return_inverse=True)
    key, wanted = (block << 32) | number[:n], (block << 32) | number[n:]
    place = np.minimum(np.searchsorted(key, wanted), n - 1)
    up = np.where(linked & (key[place] == wanted), place, -1)
    outside = linked & (up < 0)
    extra = {c: _values(batch.column(c)).astype(np.int64) if c in batch.schema.names else None for c in WEIGHTS}
    subtree = np.ones(n, np.int64) if extra["_w"] is None else 1 + extra["_w"]
    height = np.zeros(n, np.int64) if extra["_h"] is None else extra["_h"].copy()
    children = np.bincount(up[up >= 0], minlength=n).astype(np.int64)
    if extra["_k"] is not None:
        children += extra["_k"]
    tied = linked & _values(batch.column("_tie"))
    depth, top, ties, all_tied, far = (up >= 0).astype(np.int64), np.where(up >= 0, up, np.arange(n)), tied.astype(np.int64), tied.copy(), up.copy()
    for k in range(n.bit_length() + 1):
        src = np.flatnonzero(far >= 0)
        if not len(src):
            break
        dst = far[src]
        more, deeper = subtree[src], height[src] + (1 << k)
        depth_to, top_to, ties_to, tied_to, far_to = depth[dst], top[dst], ties[dst], all_tied[dst], far[dst]
        np.add.at(subtree, dst, more)
        np.maximum.at(height, dst, deeper)
        depth[src] += depth_to
        top[src] = top_to
        ties[src] += np.where(all_tied[src], ties_to, 0)
        all_tied[src] &= tied_to
        far[src] = far_to
    else:
        raise RuntimeError("parent pointers did not converge: the edge table has a cycle")
    out = outside[top]
    above = _paths(node, up, depth) if path else None
    kept = [c for c in batch.schema.names if c not in WEIGHTS]
    columns = [batch.column(c) for c in kept] + [
        pa.array(np.where(out, parent[top], node[top])),
        pa.array((depth + out).astype(np.int32)),
        pa.array(children),
        pa.array(subtree),
        pa.array(height.astype(np.int32)),
        pa.array(ties.astype(np.int32)),
        pa.array(node[top]),
        pa.array(out),
    ]
    names = kept + [c.split()[0] for c in FOUND.split(", ")]
    if path:
        columns.append(above)
        names.append("above")
    return pa.RecordBatch.from_arrays(columns, names=names)


def solve(batches, path: bool):
    """For ``mapInArrow`` over rows sorted by ``_g, _b, _n``; holds back only the block that may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not _same_block(held[-1], batch):
            yield _solved(pa.Table.from_batches(held), path)
            held = []
        last = np.flatnonzero(_changes(batch))
        if len(last):
            cut = int(last[-1]) + 1
            yield _solved(pa.Table.from_batches([*held, batch.slice(0, cut)]), path)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield _solved(pa.Table.from_batches(held), path)
