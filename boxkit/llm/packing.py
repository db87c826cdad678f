"""Entries of many documents as packed rows: one row for each bucket and flush of a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common as C


def flush_size(buckets: int) -> int:
    """Entries that a task holds before it sends them: enough for some hundred in each bucket, within a bound of memory."""
    return min(4_000_000, max(250_000, 200 * buckets))


def pack(a: np.ndarray) -> bytes:
    """Whole numbers as a base and the smallest unsigned offsets."""
    if not len(a):
        return b""
    base = int(a.min())
    off = (a.astype(np.int64) - base).astype(np.uint64)
    kind = np.min_scalar_type(int(off.max()))
    return np.int64(base).tobytes() + bytes([kind.itemsize]) + off.astype(kind).tobytes()


def unpack(b: bytes | None) -> np.ndarray:
    if not b:  # nothing, or no row at all
        return np.empty(0, np.int64)
    return np.frombuffer(b, np.dtype(f"u{b[8]}"), offset=9).astype(np.int64) + np.frombuffer(b, np.int64, 1)[0]


def home(rid: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document's states: half as many as for keys, as each of those sends to each of these."""
    return (C.mix(rid.astype(np.uint64)) % np.uint64(max(1, buckets // 2))).astype(np.int64)


def split(part: np.ndarray, keep: np.ndarray):
    at = np.flatnonzero(keep)
    order = at[np.argsort(part[at], kind="stable")]
    cut = np.flatnonzero(np.diff(part[order])) + 1
    for pick in np.split(order, cut) if len(order) else ():
        yield int(part[pick[0]]), pick


def batches_of(rows, names, types):
    """Record batches of at most about 8 MB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if size > 8_000_000:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def rows_to_table(rows, names, types) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, names, types)]) if rows else pa.table({k: pa.array([], t) for k, t in zip(names, types, strict=True)})


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
