"""Removal of word windows that an earlier document has, by recompression.

Each text is parsed in rounds: equal neighbours become a run symbol, then in
each pair round every symbol is left or right by a bit of its name, and a left
one followed by a right one becomes a pair symbol. A symbol's name is a hash of
what it stands for, the same in all tasks, and equal texts get equal symbols
except next to their ends: a first symbol may belong to a run or pair that
begins outside, a last one to one that ends outside. Within a window the
symbols that can't depend on what is outside are its interior ones.

1. The first pair rounds are parsed where the text is. A round of Spark then
   names the symbols of three words and more for all texts: those that stand in
   one place only come back without a name, and end there.
2. Named neighbours are paired again, and a further round names the pairs. So
   what is left on high levels are symbols that several places share.
3. A window with an interior symbol without a name can't repeat. Each window
   left takes as head the interior symbol with the smallest name on the highest
   level that has any, among those with ``reach`` words of the window from
   their first one on; equal windows have equal heads. Windows meet by that
   symbol and those words, and repeats are verified by all words of the windows.

Defined cases: a null text has no words and loses none; equal doc_ids never
repeat each other, a null one counts as larger than all others; texts of fewer
words than a window lose nothing; equal rows keep their ids' rule; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .repeats import Finder, among, remove_repeats

WINDOW, PAIR_ROUNDS, ROUNDS, REACH, NAMED_WORDS = 13, 2, 2, 5, 3


class _Chunk:
    __slots__ = ("buf", "first", "starts", "ends", "words", "sums", "doc", "at", "top", "levels")


class WordFinder(Finder):
    earlier_only = True

    def __init__(self, window: int = WINDOW, pair_rounds: int = PAIR_ROUNDS, rounds: int = ROUNDS, reach: int = REACH):
        self.window, self.pair_rounds, self.rounds, self.reach = window, pair_rounds, rounds, reach

    def prepare(self, buf, offsets):
        c = _Chunk()
        c.buf = buf
        c.starts, c.ends, c.first = C.words(buf, offsets, blank=True)
        c.words = C.word_hashes(buf, c.starts, c.ends)
        c.sums = C.prefix_sums(c.words)
        size = np.diff(c.first)
        c.doc = np.repeat(np.arange(len(size)), size)
        at = np.arange(max(0, len(c.words) - self.window + 1))
        c.at = at[at + self.window <= c.first[c.doc[at] + 1]] if len(at) else at  # first words of windows
        c.top = c.levels = None
        return c

    def _levels(self, c):
        """names, first words, symbol of each word, and the interior symbols lo to hi of each window, level by level."""
        w, n, at = self.window, len(c.words), c.at
        # runs of equal words; the ones at both ends of a window may go on outside
        new = np.ones(n, bool)
        new[1:] = (c.words[1:] != c.words[:-1]) | (c.doc[1:] != c.doc[:-1])
        begin = np.flatnonzero(new)
        of_word = np.cumsum(new) - 1
        run = np.diff(np.append(begin, n)).astype(np.uint64)
        names = np.where(run > 1, C.mix(c.words[begin] + run * np.uint64(0x9E3779B97F4A7C15)), c.words[begin])
        lo, hi = of_word[at] + 1, of_word[at + w - 1]
        yield names, begin, of_word, lo, hi
        for k in range(1, self.pair_rounds + 1):
            right = (C.mix(names + np.uint64(k)) >> np.uint64(63)).astype(bool)
            owner = c.doc[begin]
            second = np.zeros(len(names), bool)
            second[1:] = ~right[:-1] & right[1:] & (owner[1:] == owner[:-1])
            to = np.cumsum(~second) - 1
            live = lo < hi
            a, b = np.where(live, lo, 0), np.where(live, hi - 1, 0)
            lo = np.where(live, to[a] + right[a], 0)
            hi = np.where(live, to[b] + right[b], 0)
            first = np.flatnonzero(~second)
            paired = np.append(second[1:], False)[first]
            after = names[np.minimum(first + 1, len(names) - 1)]
            names = np.where(paired, C.mix(names[first] * np.uint64(0xC2B2AE3D27D4EB4F) + after), names[first])
            begin, of_word = begin[first], to[of_word]
            yield names, begin, of_word, lo, hi

    def _top(self, c):
        """names, first words, words, lo and hi on the highest level that is parsed where the text is."""
        if c.top is None:
            c.levels = list(self._levels(c))
            names, begin, _, lo, hi = c.levels[-1]
            c.top = names, begin, np.diff(np.append(begin, len(c.words))), lo, np.maximum(lo, hi)
        return c.top

    def symbols(self, c):
        if not len(c.words):
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        names, begin, n, _, _ = self._top(c)
        named = n >= NAMED_WORDS
        return names[named], begin[named], n[named]

    def joined(self, level: int):
        def run(at, n, name):
            left = _pairs(at, n, name)
            return C.mix(name[left] * np.uint64(0xC2B2AE3D27D4EB4F) + name[left + 1]), at[left], n[left] + n[left + 1]

        return run

    def alive(self, c, found):
        out = np.zeros(len(c.words), bool)
        if not len(c.at):
            return out
        names, begin, n, lo, hi = self._top(c)
        live = lo < hi
        named = among(begin, found[0][0])
        gone = np.concatenate(([0], np.cumsum((n >= NAMED_WORDS) & ~named)))
        ok = ~live | (gone[hi] == gone[lo])
        if self.rounds > 1:
            places = np.flatnonzero(named)
            left = _pairs(begin[places], n[places], names[places])
            left = left[c.doc[begin[places[left]]] == c.doc[begin[places[left + 1]]]]
            single = left[~among(begin[places][left], found[1][0])]
            gone = np.zeros(len(begin) + 1, np.int64)
            gone[places[single] + 1] = 1
            gone = np.cumsum(gone)
            ok &= ~live | (gone[np.maximum(hi - 1, lo)] == gone[lo])  # both of a pair are interior
        out[c.at[ok]] = True
        return out

    def heads(self, c, alive=None):
        w, n = self.window, len(c.words)
        none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        at = c.at
        if not len(at):
            return none
        last = at + w - self.reach
        # windows without an interior symbol that reaches far enough fall back on their words
        level, head = np.zeros(len(at), np.int64), self._smallest(c.words, at, last + 1)
        symbol = c.words[head]
        for k, (names, begin, of_word, lo, hi) in enumerate(c.levels or self._levels(c)):
            far = np.minimum(hi, of_word[last] + 1)
            live = np.flatnonzero(lo < far)
            level[live] = k + 1
            best = self._smallest(names, lo[live], far[live])
            head[live], symbol[live] = begin[best], names[best]
        if alive is not None:
            at, level, head, symbol = (x[alive[at]] for x in (at, level, head, symbol))
            if not len(at):
                return none
        key = level * (n + 1) + head
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(at)))
        start, level, head, symbol = at[begin], level[begin], head[begin], symbol[begin]
        bucket = C.mix(C.span_hash(c.sums, head, head + self.reach) + C.mix(symbol + level.astype(np.uint64)))
        context = C.span_hash(c.sums, start, start + many - 1 + w) ^ C.mix((many * 1_000_003 + head - start).astype(np.uint64))
        return bucket, C.mix(context), start, many

    @staticmethod
    def _smallest(names, lo, hi):
        """The place of the smallest name in names[lo:hi], the leftmost of equals."""
        best, value = lo.copy(), names[lo]
        for k in range(1, int((hi - lo).max()) if len(lo) else 0):
            p = np.minimum(lo + k, len(names) - 1)
            less = (lo + k < hi) & (names[p] < value)
            best, value = np.where(less, p, best), np.where(less, names[p], value)
        return best

    def names(self, c, at):
        one = C.span_hash(c.sums, at, at + self.window)
        two = np.zeros(len(at), np.uint64)
        for k in range(self.window):
            two = (two ^ c.words[at + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
            two ^= two >> np.uint64(29)
        return one, two >> np.uint64(32)

    def kept(self, c, covered, doc):
        a, z = c.first[doc], c.first[doc + 1]
        s, e = c.starts[a:z][~covered], c.ends[a:z][~covered]
        if not len(s):
            return b""
        size = e - s + 1  # a blank after each word
        end = np.cumsum(size)
        at = np.repeat(s - end + size, size) + np.arange(end[-1])
        at[end - 1] = 0
        out = c.buf[at]
        out[end - 1] = 0x20
        return out[:-1].tobytes()


def _pairs(at: np.ndarray, n: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The left ones of neighbouring named symbols that are paired: left and right are told by the last bit of the name."""
    right = (name & np.uint64(1)).astype(bool)
    return np.flatnonzero((at[1:] == at[:-1] + n[:-1]) & ~right[:-1] & right[1:])


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, texts: bool = True, **how) -> DataFrame:
    return remove_repeats(docs, WordFinder(window, **how), texts)


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(C.read(spark, sf_dir, "documents"), texts=False)
    return out.selectExpr("doc_id", "n_units AS n_words", "n_removed", "kept_sha256")
