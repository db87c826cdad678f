"""Windows of fixed length that stand in more than one place, found without listing all windows.

First rounds of naming (rounds.py) rule windows out: the symbols that a window
holds by its content alone, and the longer ones that join neighbours of them,
must all stand in another place too. Then every window left picks a head inside
itself by its content alone, so equal windows pick equal heads. Consecutive
windows with the same head form a run; a run has a bucket (what its head is)
and a context (all that its windows cover).

1. Heads: runs meet by bucket. Runs with equal contexts settle each other as
   a whole. A bucket without a second context has no further repeats.
2. Windows: only in buckets with several contexts, one run of each context
   lists its windows, which meet one by one.
3. The settled runs and windows go back to their documents.

Rows of the exchanges are packed arrays, one for each bucket and flush of a
task. Equal keys are settled within a flush before anything is sent, so a
window that a third of all documents share is sent once per flush. Buckets are
dealt by hash, so no task meets all places of a frequent passage. Sizes of
groups follow spark.sql.shuffle.partitions, which must grow with the data.

A Finder says what units are (bytes or words) and how heads are picked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import rounds
from .packing import _batch, batches_of, flush_size, home, pack, rows_to_table, split, unpack

NO_ID = np.iinfo(np.int64).max


class Finder:
    """What a kind of window search must give for a chunk of documents."""

    window: int
    earlier_only: bool  # settled only by a smaller doc_id, else by any other place
    rounds: int = 0  # of naming
    every_window: bool = False  # whether each window holds a symbol of the first round

    def symbols(self, chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, first unit, length) of the symbols of the first round."""
        raise NotImplementedError

    def joined(self, level: int):
        """The function of (at, n, name) of one document that gives the symbols (name, at, n) of a later round."""
        raise NotImplementedError

    def alive(self, chunk, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which windows hold no symbol that stands in one place only; found: (first unit, length) of the others, by round, in order."""
        raise NotImplementedError

    def prepare(self, buf: np.ndarray, offsets: np.ndarray):
        """An object with .first (first unit of each document, one more at the end)."""
        raise NotImplementedError

    def heads(self, chunk, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, context, first window, windows) of all runs of windows left; windows by their first unit."""
        raise NotImplementedError

    def names(self, chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two identifiers (64 and 32 bits) of the windows that start at the given units."""
        raise NotImplementedError

    def kept(self, chunk, covered: np.ndarray, doc: int) -> bytes:
        """What is left of a document."""
        raise NotImplementedError


def among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    return np.searchsorted(of, x, "right") > np.searchsorted(of, x)


def settle(k1, k2, doc, many, earlier_only: bool):
    """Which entries are settled by another one, which of them must stand for their key, and the key's number.

    many: the entry stands for several already.
    """
    order = np.lexsort((doc, k2, k1))
    a, b, d = k1[order], k2[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    done, stands = np.empty(len(order), bool), np.empty(len(order), bool)
    if earlier_only:
        done[order] = d > d[first][group]
        stands = ~done
    else:
        n = np.bincount(group, 1 + many[order])
        done[order] = (n >= 2)[group]
        stands[order] = new
    number = np.empty(len(order), np.int64)
    number[order] = group
    return done, stands, number, a[first]


EXCHANGE = "part int, k1 binary, k2 binary, rid binary, doc binary, at binary, n binary, many binary"
NAMES = ["part", "k1", "k2", "rid", "doc", "at", "n", "many"]
TO_DOCS = "part int, rid binary, at binary, n binary, state binary"
_TO_DOCS = ["part", "rid", "at", "n", "state"]
DONE, OPEN, WITNESS = 1, 2, 3
#: Sent of both keys. A head's bucket is its part and 32 bits more: two that share them by chance only list
#: windows in vain. So it is with single tokens.
KINDS = {"heads": (np.uint32, np.uint64), "windows": (np.uint64, np.uint32), "tokens": (np.uint32, np.uint8), "groups": (np.uint32, np.uint64)}


class Sender:
    """Collects entries of a task and gives packed rows, settled ones apart (negative part)."""

    def __init__(self, buckets: int, earlier_only: bool, kind: str):
        self.buckets, self.earlier_only, self.held, self.size = buckets, earlier_only, [], 0
        self.kind, self.kinds, self.flush = kind, KINDS[kind], flush_size(buckets)

    def add(self, *columns):
        if len(columns[0]):
            self.held.append(columns)
            self.size += len(columns[0])

    def rows(self, last: bool = False):
        """k1, k2, rid, doc, at, n of what is held, as tuples in the order of NAMES."""
        if not self.held or (self.size < self.flush and not last):
            return
        k1, k2, rid, doc, at, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        done, stands, number, _ = settle(k1, k2, doc, np.zeros(len(k1), np.int64), self.earlier_only)
        many = np.zeros(len(k1), np.uint8) if self.earlier_only else (np.bincount(number)[number] > 1).astype(np.uint8)
        part = (k1 >> np.uint64(32)) % np.uint64(self.buckets)
        for p, pick in split(part, stands):
            yield p, k1[pick].astype(self.kinds[0]).tobytes(), k2[pick].astype(self.kinds[1]).tobytes(), pack(rid[pick]), pack(doc[pick] - rid[pick]) if self.earlier_only else b"", pack(at[pick]), pack(n[pick]), many[pick].tobytes()
        back = home(rid, self.buckets)
        # those that stand for their key are told by the reducer
        for p, pick in split(back, done & ~stands) if self.kind != "groups" else ():
            yield -1 - p, b"", b"", pack(rid[pick]), b"", pack(at[pick]), pack(n[pick]), b""


EX_TYPES = [pa.int32()] + [pa.binary()] * 7
_DOC_TYPES = [pa.int32()] + [pa.binary()] * 4


def meet(buckets: int, earlier_only: bool, kind: str):
    """The reducer of an exchange: entries of a bucket to states of documents."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            rid, at, n = (np.concatenate([unpack(x) for x in table.column(k).to_pylist()]) for k in ("rid", "at", "n"))
            state = np.full(len(rid), DONE, np.uint8)
        else:
            k1, k2 = (np.frombuffer(b"".join(table.column(k).to_pylist()), t) for k, t in zip(("k1", "k2"), KINDS[kind], strict=True))
            rid, at, n = (np.concatenate([unpack(x) for x in table.column(k).to_pylist()]) for k in ("rid", "at", "n"))
            many = np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8)
            doc = np.concatenate([unpack(x) for x in table.column("doc").to_pylist()]) + rid if earlier_only else rid
            done, stands, number, key = settle(k1, k2, doc, many, earlier_only)
            state = np.where(done, DONE, 0).astype(np.uint8)
            if kind in ("heads", "groups"):  # key: the bucket of each context, in order
                _, bucket, contexts = np.unique(key, return_inverse=True, return_counts=True)
                mixed = (contexts > 1)[bucket][number]
                state[mixed & stands & ~done] = OPEN
                state[mixed & stands & done] = WITNESS
            keep = state >= (OPEN if kind == "groups" else DONE)
            rid, at, n, state = rid[keep], at[keep], n[keep], state[keep]
        back = home(rid, buckets)
        order = np.lexsort((at, rid, back))
        rid, at, n, state, back = rid[order], at[order], n[order], state[order], back[order]
        rows = [(p, pack(rid[x]), pack(at[x]), pack(n[x]), state[x].tobytes()) for p, x in split(back, np.ones(len(back), bool))]
        return rows_to_table(rows, _TO_DOCS, _DOC_TYPES)

    return run


def _per_document(table: pa.Table) -> pa.Table:
    """One row for each document of a bucket: its states by place."""
    rid, at, n = (np.concatenate([unpack(x) for x in table.column(k).to_pylist()]) for k in ("rid", "at", "n"))
    state = np.frombuffer(b"".join(table.column("state").to_pylist()), np.uint8)
    order = np.lexsort((at, rid))
    rid, at, n, state = rid[order], at[order], n[order], state[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(rid)) + 1, [len(rid)]))
    rows = [(int(rid[a]), pack(at[a:b]), pack(n[a:b]), state[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] if len(rid) else []
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("srid", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("state", pa.binary())))})


def to_documents(met: DataFrame) -> DataFrame:
    return met.groupBy("part").applyInArrow(_per_document, "srid long, at binary, n binary, state binary")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_DDL = "array<struct<start: int, end: int>>"


def remove_repeats(docs: DataFrame, finder: Finder, texts: bool = False) -> DataFrame:
    """doc_id, n_units, n_removed, spans (of units removed), kept_sha256, and with texts also kept (binary).

    docs: doc_id (of any type that can be sorted) and text. Rows are told apart by
    place, so null and repeated ids are safe; a null id counts as larger than all others.
    """
    spark, buckets, w = docs.sparkSession, C.n_buckets(docs.sparkSession), finder.window
    rows, ids_of = C.numbered(C.with_row_id(docs, "doc_id", "text"))
    out_kind = ", kept binary" if texts else ""
    final_ddl = f"doc_id long, n_units long, n_removed long, spans {_DDL}, kept_sha256 string{out_kind}"
    final_names = ["doc_id", "n_units", "n_removed", "spans", "kept_sha256"] + ["kept"] * texts
    final_types = [pa.int64(), pa.int64(), pa.int64(), SPANS, pa.string()] + [pa.binary()] * texts

    def ids(b: pa.RecordBatch):
        doc = b.column("doc_id")
        return b.column("_rid").to_numpy(), pa.compute.fill_null(doc, NO_ID).to_numpy()

    def send_symbols(batches):
        def symbols():
            for b in batches:
                rid, _ = ids(b)
                for lo, hi, buf, offs in C.chunks(b.column("text")):
                    chunk = finder.prepare(buf, offs)
                    name, at, n = finder.symbols(chunk)
                    d = np.searchsorted(chunk.first, at, "right") - 1
                    yield name, rid[lo:hi][d], at - chunk.first[d], n

        return rounds.asked(symbols(), buckets)

    def send_heads(batches):
        sender = Sender(buckets, finder.earlier_only, "heads")

        def rows():
            for b in batches:
                rid, doc = ids(b)
                info = [(b.column(f"at_{k}").to_pylist(), b.column(f"n_{k}").to_pylist()) for k in range(finder.rounds)]
                listed = np.arange(b.num_rows) if not (finder.rounds and finder.every_window) else np.flatnonzero(b.column("at_0").is_valid().to_numpy(zero_copy_only=False))
                for lo, hi, buf, offs in C.chunks(b.column("text").take(pa.array(listed, pa.int64()))):
                    chunk = finder.prepare(buf, offs)
                    of, alive = listed[lo:hi], None
                    if finder.rounds:
                        first = chunk.first.tolist()
                        none = [np.empty(0, np.int64)]
                        found = [(np.concatenate([unpack(at[r]) + first[k] for k, r in enumerate(of.tolist()) if at[r]] or none), np.concatenate([unpack(n[r]) for r in of.tolist() if n[r]] or none)) for at, n in info]
                        alive = finder.alive(chunk, found)
                        if not alive.any():
                            continue
                    bucket, context, at, n = finder.heads(chunk, alive)
                    d = np.searchsorted(chunk.first, at, "right") - 1
                    sender.add(bucket, context, rid[of][d], doc[of][d], at - chunk.first[d], n)
                    yield from sender.rows()
            yield from sender.rows(last=True)

        return batches_of(rows(), NAMES, EX_TYPES)

    def finish(chunk, k: int, doc_id, at, n):
        """The result row of one document, given its settled runs."""
        a, z = int(chunk.first[k]), int(chunk.first[k + 1])
        cover = np.zeros(z - a + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n - 1 + w, -1)
        covered = np.cumsum(cover)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
        kept = finder.kept(chunk, covered, k)
        return (doc_id, z - a, int(covered.sum()), [{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)], hashlib.sha256(kept).hexdigest(), *([kept] * texts))

    def list_windows(batches):
        """The windows of open runs and witnesses."""
        sender = Sender(buckets, finder.earlier_only, "windows")

        def out():
            for b in batches:
                rid, doc = ids(b)
                info = [b.column(k).to_pylist() for k in ("at", "n", "state")]
                text = b.column("text")
                listed = [r for r in range(b.num_rows) if info[2][r] is not None and max(info[2][r]) >= OPEN]
                for lo, hi, buf, offs in C.chunks(text.take(pa.array(listed, pa.int64()))):
                    chunk = finder.prepare(buf, offs)
                    for k in range(hi - lo):
                        r = listed[lo + k]
                        state = np.frombuffer(info[2][r], np.uint8)
                        at, many = unpack(info[0][r])[state >= OPEN], unpack(info[1][r])[state >= OPEN]
                        p = np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())
                        k1, k2 = finder.names(chunk, p + chunk.first[k])
                        sender.add(k1, k2, np.full(len(p), rid[r]), np.full(len(p), doc[r]), p, np.ones(len(p), np.int64))
                    yield from sender.rows()
            yield from sender.rows(last=True)

        return batches_of(out(), NAMES, EX_TYPES)

    def close(batches):
        def out():
            for b in batches:
                doc_id = b.column("doc_id").to_pylist()
                cols = [b.column(k).to_pylist() for k in ("at", "n", "state", "more_at", "more_n")]
                for lo, hi, buf, offs in C.chunks(b.column("text")):
                    chunk = finder.prepare(buf, offs)
                    for k in range(hi - lo):
                        at0, n0, state, at1, n1 = (c[lo + k] for c in cols)
                        at, n = unpack(at1), unpack(n1)
                        if state is not None:
                            settled = np.frombuffer(state, np.uint8) != OPEN
                            at, n = np.concatenate([unpack(at0)[settled], at]), np.concatenate([unpack(n0)[settled], n])
                        yield finish(chunk, k, doc_id[lo + k], at, n)

        return batches_of(out(), final_names, final_types)

    told = rows
    if finder.rounds:
        found = rounds.shared(rows.mapInArrow(send_symbols, rounds.ASKED), buckets, finder.rounds > 1)
        infos = [C.saved(found, "named-symbols")]
        for k in range(1, finder.rounds):
            infos.append(C.saved(rounds.join_neighbours(infos[-1], buckets, finder.joined(k), k + 1 < finder.rounds), "named-symbols"))
        for k, info in enumerate(infos):
            told = told.join(info.select(F.col("srid").alias(f"s_{k}"), F.col("at").alias(f"at_{k}"), F.col("n").alias(f"n_{k}")).hint("shuffle_hash"), F.col("_rid") == F.col(f"s_{k}"), "left").drop(f"s_{k}")
    met = told.mapInArrow(send_heads, EXCHANGE).groupBy("part").applyInArrow(meet(buckets, finder.earlier_only, "heads"), TO_DOCS)
    info = to_documents(met)
    # both uses of this share one exchange of the texts, and the second join needs no further one
    joined = rows.join(info.hint("shuffle_hash"), rows["_rid"] == info["srid"], "left").drop("srid")
    windows = joined.mapInArrow(list_windows, EXCHANGE).groupBy("part").applyInArrow(meet(buckets, finder.earlier_only, "windows"), TO_DOCS)
    more = to_documents(windows).selectExpr("srid", "at AS more_at", "n AS more_n")
    return C.named(joined.join(more.hint("shuffle_hash"), F.col("_rid") == F.col("srid"), "left").drop("srid").mapInArrow(close, final_ddl), ids_of, "doc_id")
