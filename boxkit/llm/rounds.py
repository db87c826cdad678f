"""Rounds in which Spark finds out which named stretches of texts stand in more than one place.

A symbol is a stretch of a document with a name, the same wherever the stretch
is equal. A round deals names to buckets; a bucket tells which of its names
stand in one place only and hands back the others, so that the next round,
which joins neighbouring symbols to longer ones, works on these alone. Rows are
packed arrays, one for each bucket and flush of a task; a name that a flush
holds several times is asked for once, so frequent names fill no bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from .packing import batches_of, flush_size, home, pack, rows_to_table, split, unpack

ASKED = "part int, name binary, rid binary, at binary, n binary, many binary"
_ASKED, _TYPES = ["part", "name", "rid", "at", "n", "many"], [pa.int32()] + [pa.binary()] * 5
_BACK, _BACK_TYPES = ["part", "name", "rid", "at", "n"], [pa.int32()] + [pa.binary()] * 4


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return (name >> np.uint64(32)) % np.uint64(buckets)


def _known(low: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A name as it comes back: of the bits that were sent."""
    return low.astype(np.uint64) + (part.astype(np.uint64) << np.uint64(32))


class Asker:
    """Collects symbols of a task and gives packed rows; those of a name met before in the flush go straight home (negative part)."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size, self.flush = buckets, [], 0, flush_size(buckets)

    def add(self, name, rid, at, n):
        if len(name):
            self.held.append((name, rid, at, n))
            self.size += len(name)

    def rows(self, last: bool = False):
        if not self.held or (self.size < self.flush and not last):
            return
        name, rid, at, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        part = _bucket(name, self.buckets).astype(np.int64)
        low = name.astype(np.uint32)
        order = np.lexsort((low, part))
        new = np.ones(len(order), bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (part[order][1:] != part[order][:-1])
        group = np.cumsum(new) - 1
        many, first = np.empty(len(order), np.uint8), np.empty(len(order), bool)
        many[order], first[order] = (np.bincount(group) > 1)[group], new
        for p, pick in split(part, first):
            yield p, low[pick].tobytes(), pack(rid[pick]), pack(at[pick]), pack(n[pick]), many[pick].tobytes()
        for p, pick in split(home(rid, self.buckets), ~first):
            yield -1 - p, _known(low[pick], part[pick]).tobytes(), pack(rid[pick]), pack(at[pick]), pack(n[pick]), b""


def _answer(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rid, at, n = (np.concatenate([unpack(x) for x in table.column(k).to_pylist()]) for k in ("rid", "at", "n"))
        if part < 0:
            name = np.frombuffer(b"".join(table.column("name").to_pylist()), np.uint64)
        else:
            low = np.frombuffer(b"".join(table.column("name").to_pylist()), np.uint32)
            many = np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8)
            _, of, count = np.unique(low, return_inverse=True, return_counts=True)
            stay = (count[of] > 1) | (many > 0)
            name = _known(low[stay], np.full(int(stay.sum()), part))
            rid, at, n = rid[stay], at[stay], n[stay]
        back = home(rid, buckets)
        order = np.lexsort((at, rid, back))
        rid, at, n, name, back = rid[order], at[order], n[order], name[order], back[order]
        rows = [(p, name[x].tobytes(), pack(rid[x]), pack(at[x]), pack(n[x])) for p, x in split(back, np.ones(len(back), bool))]
        return rows_to_table(rows, _BACK, _BACK_TYPES)

    return run


def _per_document(named: bool):
    def run(table: pa.Table) -> pa.Table:
        rid, at, n = (np.concatenate([unpack(x) for x in table.column(k).to_pylist()]) for k in ("rid", "at", "n"))
        name = np.frombuffer(b"".join(table.column("name").to_pylist()), np.uint64)
        order = np.lexsort((at, rid))
        rid, at, n, name = rid[order], at[order], n[order], name[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(rid)) + 1, [len(rid)]))
        rows = [(int(rid[a]), pack(at[a:b]), pack(n[a:b]), name[a:b].tobytes() if named else b"") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] if len(rid) else []
        return rows_to_table(rows, ["srid", "at", "n", "name"], [pa.int64()] + [pa.binary()] * 3)

    return run


def shared(symbols: DataFrame, buckets: int, named: bool) -> DataFrame:
    """srid, at, n (packed) and, if named, name of the symbols (rows of ASKED) that stand in more than one place."""
    return symbols.groupBy("part").applyInArrow(_answer(buckets), ASKED.rsplit(",", 1)[0]).groupBy("part").applyInArrow(_per_document(named), "srid long, at binary, n binary, name binary")


def asked(rows, buckets: int):
    """Batches of ASKED of an iterator of (name, rid, at, n)."""
    asker = Asker(buckets)

    def out():
        for x in rows:
            asker.add(*x)
            yield from asker.rows()
        yield from asker.rows(last=True)

    return batches_of(out(), _ASKED, _TYPES)


def join_neighbours(found: DataFrame, buckets: int, joined, named: bool) -> DataFrame:
    """The next round: joined(at, n, name) -> (name, at, n) of the longer symbols of one document, asked for in their turn."""

    def send(batches):
        def rows():
            for b in batches:
                for rid, at, n, name in zip(*(b.column(k).to_pylist() for k in ("srid", "at", "n", "name")), strict=True):
                    name, at, n = joined(unpack(at), unpack(n), np.frombuffer(name, np.uint64))
                    yield name, np.full(len(name), rid), at, n

        return asked(rows(), buckets)

    return shared(found.mapInArrow(send, ASKED), buckets, named)
