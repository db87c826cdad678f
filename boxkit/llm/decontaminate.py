"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is a batch of whole documents of about ``SHARD`` bytes. Its suffix array
holds, in the order of their words, the suffixes that can begin a match: those
whose first words are all known from the test items. Every test suffix, equal
ones once, is looked up by binary search, which gives the range of training
suffixes that begin like it; matches that run on in a document are joined to the
longest ones. What a document loses and which items it holds is told from those
matches and their places. Nothing is shuffled: each task answers for its own
documents.

Test items go to the tasks in blocks of at most ``block_chars`` characters, so
what is broadcast has a fixed bound; more items mean more passes.

Defined cases: a null or wordless text has no words, hits nothing and is kept;
null or wordless items match nothing; equal items each count, a null item_id as
an item without name; ids of any type; a row whose doc_id repeats is judged by
itself; further columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

WINDOW = 13
BLOCK_CHARS, SHARD = 8_000_000, 4 << 20


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """The items as lists of (item_id, text), each of at most block_chars characters or one item."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if block and held + len(row[1]) > block_chars:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    yield block


class TestSuffixes:
    """The windows of a block of items, coded by the block's vocabulary, by window length."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        hashes, first = [], [0]
        for _, _, buf, offs in C.chunks(texts, 1 << 40):
            low = C.lower(buf)
            s, e, first = C.words(low, offs, blank=False)
            hashes = C.word_hashes(low, s, e)
        self.vocabulary = np.unique(np.asarray(hashes, dtype=np.uint64))
        codes = np.searchsorted(self.vocabulary, hashes).astype(np.uint32) + 1 if len(hashes) else np.empty(0, np.uint32)
        by_length: dict[int, list] = {}
        for k in range(len(items)):
            lo, hi = int(first[k]), int(first[k + 1])
            n = min(window, hi - lo)
            if n:
                by_length.setdefault(n, []).extend((k, p - lo, codes[p : p + n]) for p in range(lo, hi - n + 1))
        self.ids = [i for i, _ in items]
        #: Per length: the distinct windows in order, and the places (item, first word) of each, one list after the other.
        self.windows = {}
        for n, w in by_length.items():
            keys = _keys(np.stack([x[2] for x in w]))
            distinct, of = np.unique(keys, return_inverse=True)
            order = np.argsort(of, kind="stable")
            first = np.searchsorted(of[order], np.arange(len(distinct) + 1))
            self.windows[n] = distinct, first, np.array([x[0] for x in w])[order], np.array([x[1] for x in w])[order]

    def search(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(positions in order, windows, words) of all places of a shard where a window stands; one for each place and length."""
        found = []
        if not len(self.vocabulary) or not len(hashes):
            return found
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)
        known = np.concatenate(([0], np.cumsum(codes > 0)))
        doc_end = np.repeat(first[1:], np.diff(first))
        for n, (keys, *_) in self.windows.items():
            p = np.arange(len(codes) - n + 1)
            if not len(p):
                continue
            p = p[(known[p + n] - known[p] == n) & (p + n <= doc_end[p])]
            if not len(p):
                continue
            suffixes = _keys(codes[p[:, None] + np.arange(n)])
            order = np.argsort(suffixes, kind="stable")
            array = suffixes[order]  # the shard's suffix array, as far down as windows go
            lo, hi = np.searchsorted(array, keys, "left"), np.searchsorted(array, keys, "right")
            many = hi - lo
            if not many.any():
                continue
            window = np.repeat(np.arange(len(keys)), many)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pos = p[order[lo[window] + within]]
            back = np.argsort(pos, kind="stable")
            found.append((pos[back], window[back], n))
        return found

    def places(self, pos: np.ndarray, window: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, items, first words there): each match with all places of its window."""
        _, first, item, start = self.windows[n]
        many = first[window + 1] - first[window]
        at = np.repeat(first[window] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(pos, many), item[at], start[at]

    def items_of(self, found, first: np.ndarray) -> dict[int, set[int]]:
        """The items of each document of a shard; a window that a document holds many times counts once."""
        out: dict[int, set[int]] = {}
        for pos, window, n in found:
            doc = np.searchsorted(first, pos, "right") - 1
            pairs = np.unique(np.stack([doc, window]), axis=1)
            doc, item, _ = self.places(*pairs, n)
            for d, i in np.unique(np.stack([doc, item]), axis=1).T.tolist():
                out.setdefault(d, set()).add(i)
        return out


def longest(found, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of a shard that matches cover, documents apart."""
    n_words = int(first[-1])
    cover = np.zeros(n_words + 1, np.int32)
    for pos, _, n in found:
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + n, -1)
    inside = np.cumsum(cover)[:-1] > 0
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return C.runs(inside, first)


def _keys(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings that sort as the rows do."""
    big = np.ascontiguousarray(codes.astype(">u4"))
    return big.view(f"S{4 * codes.shape[1]}").ravel()


def _joined(pos, item, start, n):
    """Joins matches that run on in document and item alike."""
    order = np.lexsort((pos, pos - start, item))
    pos, item, start = pos[order], item[order], start[order]
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | (pos[1:] - start[1:] != pos[:-1] - start[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(pos)) - 1
    return pos[at], item[at], start[at], pos[last] - pos[at] + n


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int, body, schema: T.StructType) -> list[DataFrame]:
    spark: SparkSession = docs.sparkSession
    out = []
    rows = C.with_row_id(docs, "doc_id", "text")
    for block in item_blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            tests = TestSuffixes(sent.value, window)
            for b in batches:
                for lo, hi, buf, offs in C.chunks(b.column("text"), SHARD):
                    low = C.lower(buf)
                    s, e, first = C.words(low, offs, blank=False)
                    yield from body(b.slice(lo, hi - lo), first, tests, tests.search(C.word_hashes(low, s, e), first))

        out.append(rows.mapInArrow(run, schema))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The longest verbatim matches: document, item, first word in each, words.

    Items shorter than the window match as a whole; longer ones by at least a window.
    """

    def body(rows, first, tests, found):
        sizes = np.diff(first)
        for pos, window, n in found:
            pos, item, start, n = _joined(*tests.places(pos, window, n), n)
            doc = np.searchsorted(first, pos, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(doc)), pa.array(sizes[doc], pa.int64()), _ids(tests, item.tolist(), item_type), pa.array(pos - first[doc], pa.int32()), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                names=["doc_id", "n_words", "item_id", "doc_start", "item_start", "n_matched"],
            )

    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("n_words", T.LongType()), ("item_id", benchmark.schema["item_id"].dataType), ("doc_start", T.IntegerType()), ("item_start", T.IntegerType()), ("n_matched", T.IntegerType())]
    return reduce(DataFrame.unionByName, _passes(docs, benchmark, window, block_chars, body, T.StructType([T.StructField(*k) for k in kinds])))


def _ids(tests: TestSuffixes, items: list[int], kind: pa.DataType) -> pa.Array:
    return pa.array([tests.ids[i] for i in items], kind)


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, the items and contaminated (share * n_hit >= n_words > 0 hits).

    stretches: first word and end of the longest matches.
    """
    stretch = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def body(rows, first, tests, found):
        start, end = longest(found, first)
        doc = np.searchsorted(first, start, "right") - 1
        items = tests.items_of(found, first)
        cut = pa.array(np.searchsorted(doc, np.arange(len(first))), pa.int32())
        spans = pa.StructArray.from_arrays([pa.array(start - first[doc], pa.int32()), pa.array(end - first[doc], pa.int32())], fields=list(stretch))
        held = [sorted(items.get(d, ())) for d in range(rows.num_rows)]
        ends = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [rows.column("_rid"), rows.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(cut, spans), pa.ListArray.from_arrays(ends, _ids(tests, [i for x in held for i in x], item_type))],
            names=["_rid", "doc_id", "n_words", "stretches", "items"],
        )

    kinds = [("_rid", T.LongType()), ("doc_id", docs.schema["doc_id"].dataType), ("n_words", T.LongType()), ("stretches", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), ("items", T.ArrayType(benchmark.schema["item_id"].dataType))]
    schema = T.StructType([T.StructField(*k) for k in kinds])
    parts = _passes(docs, benchmark, window, block_chars, body, schema)
    out = parts[0].drop("_rid")
    if len(parts) > 1:
        every = reduce(DataFrame.unionByName, parts)
        out = every.groupBy("_rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("stretches")).alias("stretches"), F.flatten(F.collect_list("items")).alias("items")).drop("_rid")
    # words in stretches of several passes count once
    hit = "cast(size(array_distinct(flatten(transform(stretches, s -> sequence(s.start, s.end - 1))))) as long)" if len(parts) > 1 else "cast(aggregate(stretches, 0, (n, s) -> n + s.end - s.start) as long)"
    out = out.withColumn("n_hit", F.expr(hit)).withColumn("items", F.array_sort(F.array_distinct(F.transform("items", lambda i: F.coalesce(i.cast("string"), F.lit(""))))))
    out = out.withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that aren't contaminated, with the columns of documents."""
    columns = docs.columns
    blocks = item_blocks(benchmark)
    first, more = next(blocks), next(blocks, None)
    if more is not None:  # several passes: what they hit must be added up before judging
        rows = docs.select(F.struct(*columns).alias("_row"), F.monotonically_increasing_id().alias("_rid"))
        bad = judge(docs, benchmark, window, share).where("contaminated").select("_rid")
        return rows.join(bad, "_rid", "left_anti").select("_row.*")
    sent = docs.sparkSession.sparkContext.broadcast(first)
    place = columns.index("text")

    def run(batches):
        tests = TestSuffixes(sent.value, window)
        for b in batches:
            keep = []
            for _, _, buf, offs in C.chunks(b.column(place), SHARD):
                low = C.lower(buf)
                s, e, at = C.words(low, offs, blank=False)
                start, end = longest(tests.search(C.word_hashes(low, s, e), at), at)
                n_hit = np.bincount(np.searchsorted(at, start, "right") - 1, end - start, len(at) - 1) if len(start) else np.zeros(len(at) - 1)
                keep.append((n_hit == 0) | (share * n_hit < np.diff(at)))
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.empty(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """doc_id -> (n_words, n_hit, items sha256, contaminated), word by word; for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    tests = [(i, split(t)) for i, t in items]
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for i, x in tests:
            n = min(window, len(x))
            for p in range(len(x) - n + 1) if n else ():
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == x[p : p + n]:
                        hit |= set(range(q, q + n))
                        ids.add(str(i))
        out[d] = (len(w), len(hit), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


__all__ = ["matches", "judge", "decontaminate", "op2_decontaminate", "item_blocks"]
