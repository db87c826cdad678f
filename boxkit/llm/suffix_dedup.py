"""Removal of repeated byte strings by bucket-pointer refinement.

Suffixes start in buckets of their first q bytes. To keep them few, only heads
get a bucket: every stretch of ``inner`` bytes picks the q-gram with the
smallest identifier that begins in its reach, so equal stretches have equal
heads at equal places, and a window of 200 bytes holds several that its content
alone decides.

1. A round of Spark finds which buckets hold one suffix only; these are settled.
2. The suffixes left are refined by the bucket of the next head, a later offset:
   the pair of both is their new bucket, and a round settles the single ones.
3. The new buckets are used in the same way: a suffix is refined by the new
   bucket of the next head, which reaches one head further, and so on.

Windows over a suffix that a round has settled can't repeat. Of the windows
left, neighbours with the same head meet as one run by all that they cover;
equal runs settle each other, and only where a bucket still holds different
ones do they meet window by window, by the q-gram identifiers at offsets 0 and
half a window and 96 bits in all.

Identifiers are hashes, equal in all tasks, so that a frequent bucket needs no
task that numbers all its places.

Defined cases: a null text has no bytes and loses none; windows never cross
documents; equal rows repeat each other and lose all that windows cover; texts
shorter than a window lose nothing; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .repeats import Finder, among, remove_repeats

WINDOW, Q, INNER, INNER_Q, ROUNDS = 200, 100, 131, 32, 3


class _Chunk:
    __slots__ = ("buf", "first", "sums", "grams")


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i that has w elements."""
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class ByteFinder(Finder):
    earlier_only = False
    every_window = True

    def __init__(self, window: int = WINDOW, q: int = Q, inner: int = INNER, inner_q: int = INNER_Q, rounds: int = ROUNDS):
        self.window, self.q, self.inner, self.inner_q, self.rounds = window, q, inner, inner_q, rounds
        if window % q or not 0 < inner_q <= inner <= window:
            raise ValueError("the window must be a multiple of q and hold the inner stretches")
        if rounds > 3:
            raise ValueError("at most three rounds: a window holds few heads more")

    def prepare(self, buf, offsets):
        c = _Chunk()
        c.buf, c.first, c.sums, c.grams = buf, offsets, None, None
        return c

    def _grams(self, c):
        if c.grams is None:
            c.sums = C.prefix_sums(C.BYTE_CODES[c.buf]) if c.sums is None else c.sums
            at = np.arange(max(0, len(c.buf) - self.q + 1))
            c.grams = C.span_hash(c.sums, at, at + self.q)
        return c.grams

    def _chosen(self, c, grams: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of a width within documents, and the place of the smallest identifier in their reach, the leftmost of equals."""
        n = len(c.buf)
        if n < width:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = np.uint64((1 << 34) - 1)  # places in a chunk; so many bits in every task, so that all choose alike
        head = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), reach) & low).astype(np.int64)
        size = np.diff(c.first)
        ok = np.zeros(n + 1, np.int32)
        has = size >= width
        np.add.at(ok, c.first[:-1][has], 1)
        np.add.at(ok, c.first[1:][has] - width + 1, -1)
        return np.flatnonzero(np.cumsum(ok)[: len(head)] > 0), head

    def symbols(self, c):
        if c.sums is None:
            c.sums = C.prefix_sums(C.BYTE_CODES[c.buf])
        at = np.arange(max(0, len(c.buf) - self.inner_q + 1))
        grams = C.span_hash(c.sums, at, at + self.inner_q)
        at, head = self._chosen(c, grams, self.inner, self.inner - self.inner_q + 1)
        if not len(at):
            return np.empty(0, np.uint64), at, at
        h = head[at]
        new = np.ones(len(at), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        return grams[h[begin]], at[begin], np.diff(np.append(begin, len(at)))

    def joined(self, level: int):
        """A suffix with the bucket of the next head: at its last stretch, so far before the last stretch of the next."""

        def run(at, n, name):
            next_ = np.flatnonzero(at[1:] == at[:-1] + n[:-1])
            return C.mix(name[next_] * np.uint64(0xC2B2AE3D27D4EB4F) + name[next_ + 1]), (at + n - 1)[next_] if level == 1 else at[next_], n[next_ + 1] if level == 1 else n[next_]

        return run

    def alive(self, c, found):
        """Windows from p hold the stretches p to p + room: one of a single suffix, or both ends of one that was refined, rule them out."""
        room = self.window - self.inner
        at, n = self.symbols(c)[1:]
        dead = np.zeros(len(c.buf) + 1, np.int32)

        def kill(first, last):
            """The windows from first to last of each symbol, within its document."""
            first = np.maximum(first, c.first[np.searchsorted(c.first, last, "right") - 1])
            some = first <= last
            np.add.at(dead, first[some], 1)
            np.add.at(dead, last[some] + 1, -1)

        gone = ~among(at, found[0][0])
        kill(at[gone] - room, (at + n - 1)[gone])
        for k in range(1, len(found)):
            at, n = found[k - 1]
            next_ = np.flatnonzero(at[1:] == at[:-1] + n[:-1])
            first = (at + n - 1)[next_] if k == 1 else at[next_]
            last = first + 1 if k == 1 else at[next_ + 1] + 1
            gone = ~among(first, found[k][0])
            kill(last[gone] - room, first[gone])
        return np.cumsum(dead)[:-1] == 0

    def heads(self, c, alive=None):
        w = self.window
        none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(c.buf) < w:
            return none
        grams = self._grams(c)
        at, head = self._chosen(c, grams, w, w - self.q + 1)
        if alive is not None:
            at = at[alive[at]]
        if not len(at):
            return none
        h = head[at]
        new = np.ones(len(at), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(at)))
        start, h = at[begin], h[begin]
        context = C.span_hash(c.sums, start, start + many - 1 + w)
        context = C.mix(context ^ C.mix((many * 1_000_003 + (h - start)).astype(np.uint64)))
        return grams[h], context, start, many

    def names(self, c, at):
        grams = self._grams(c)
        one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k in range(self.window // self.q):
            g = grams[at + k * self.q]
            one = C.mix(one + g)
            two = (two ^ g) * np.uint64(0xC2B2AE3D27D4EB4F)
        return one, two >> np.uint64(32)

    def kept(self, c, covered, doc):
        own = c.buf[c.first[doc] : c.first[doc + 1]]
        return own.tobytes() if not covered.any() else own[~covered].tobytes()


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, q: int = Q, texts: bool = True, **how) -> DataFrame:
    return remove_repeats(docs, ByteFinder(window, q, **how), texts)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(C.read(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
