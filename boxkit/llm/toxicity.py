"""Toxicity scores from Levenshtein automata over a lexicon trie, and context windows.

The lexicon starts from a short list of insults and learns further words and
word stems from labelled rows: those that stand in toxic texts far more often
than chance allows. Its terms form a trie; a word is looked up by running a
Levenshtein automaton along the trie, so that misspelled terms are found at the
cost of the branches that stay within reach: one edit for terms and stems of five
letters and more, two for those of nine and more. Each hit counts by the weight of
its term, less for each edit; windows around hits weigh in whether the passage
quotes or speaks about the term, or turns it at a reader. A small logistic
model over these figures gives the score.

Bounds: at most ``sample_toxic`` toxic and ``sample_clean`` other labelled rows,
those of the smallest hashed ids, are fitted on; the lexicon keeps at most
``lexicon_size`` terms. What is collected from them is what these bounds allow;
scoring is one pass over all texts.

Defined cases: null and empty texts are scored like texts without any hit; a
null doc_id is in no held-out fold and joins no label; conflicting labels of an
id count as toxic; null labels are left out; no labels at all leave the model
with its prior weights; repeated rows score alike; further columns of either
table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SEEDS = "idiot moron scum worthless pathetic loser disgusting stupid trash clown imbecile dumb fool jerk filthy vermin cretin degenerate subhuman scumbag".split()
QUOTE = set("said says quote quoted quotes called term word words wrote sagte dit dijo".split())
ADDRESS = set("you your youre du dich tu toi vous usted eres".split())
SAMPLE_TOXIC, SAMPLE_CLEAN, LEXICON_SIZE = 4_000, 8_000, 400
STEMS = (4, 5, 6, 7)
WINDOW = 12
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PRIOR = np.array([-4.0, 2.5, 0.5, 1.0, -1.0, 0.5, 0.5])


def held_out(doc_id) -> F.Column:
    """Whether an id belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_labels(labels: DataFrame, most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN) -> DataFrame:
    """doc_id and toxic of at most so many labelled rows outside the held-out fold."""
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = one.withColumn("_order", F.xxhash64("doc_id"))
    return one.where("toxic = 1").orderBy("_order").limit(most_toxic).unionByName(one.where("toxic = 0").orderBy("_order").limit(most_clean)).drop("_order")


def learn_lexicon(train: DataFrame, size: int = LEXICON_SIZE) -> list[tuple[str, bool, float]]:
    """(term, is a stem, weight) of the terms that mark toxic texts; train: doc_id, text, toxic."""
    one = train.where("text IS NOT NULL").groupBy("text").agg(F.max("toxic").alias("toxic"))
    n = one.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    toxic, clean = int(n[0] or 0), int(n[1] or 0)
    if not toxic or not clean:
        return [(w, False, 3.0) for w in SEEDS]
    words = one.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(WORD), F.lit(0)))).alias("w"))
    stems = words.select("toxic", "w", F.explode(F.filter(F.array(*(F.lit(k) for k in STEMS)), lambda k: k < F.length("w"))).alias("k"))
    base = toxic / (toxic + clean)
    # a stem counts once for each word that it begins: words of many endings still add up
    terms = words.select("toxic", "w", F.lit(False).alias("stem")).unionByName(stems.select("toxic", F.expr("substring(w, 1, k)").alias("w"), F.lit(True).alias("stem")))
    counts = terms.where(F.length("w") >= 3).groupBy("w", "stem").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    p = F.col("a") / F.col("n")
    gain = F.col("a") * F.log(p / base) + F.when(p < 1, (F.col("n") - F.col("a")) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    # so much evidence that chance gives none of millions of terms
    found = counts.where(p > 0.9).withColumn("gain", gain).where(F.col("gain") >= 12).orderBy(F.desc("gain"), "w", "stem").limit(4 * size).collect()
    kept: dict[tuple[str, bool], float] = {}
    for r in sorted(found, key=lambda r: (len(r.w), not r.stem)):
        if any((r.w[:k], True) in kept for k in range(1, len(r.w))):
            continue  # a shorter stem has it
        weight = float(np.log((r.a + 0.5) / (toxic + 1)) - np.log((r.n - r.a + 0.5) / (clean + 1)))
        if r.stem and any(s.startswith(r.w) for s in SEEDS):
            continue  # stated as a word
        kept[(r.w, r.stem)] = min(6.0, max(0.5, weight))
    best = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:size])
    seen = {r.w: (r.a, r.n) for r in counts.where(~F.col("stem") & F.col("w").isin(SEEDS)).collect()}
    for w in SEEDS:
        a, m = seen.get(w, (0, 0))
        prior = 3.0 if m < 5 else float(np.log((a + 1) / (toxic + 2)) - np.log((m - a + 1) / (clean + 2)))
        if prior > 0.5:
            best[(w, False)] = min(6.0, max(prior, best.get((w, False), 0)))
    return sorted((w, stem, x) for (w, stem), x in best.items())


class Lexicon:
    """A trie of terms, exact look-up by hashes, and automata for misspelled words."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.trie: dict = {}
        for k, (w, stem, _) in enumerate(terms):
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = (k, stem)
        self.weights = np.array([x for _, _, x in terms] or [0.0])
        self.by_length: dict[int | None, tuple[np.ndarray, np.ndarray]] = {}
        groups: dict[int | None, list[int]] = {}
        for k, (w, stem, _) in enumerate(terms):
            groups.setdefault(len(w.encode()) if stem else None, []).append(k)
        for n, ks in groups.items():
            codes = np.array([_hash(terms[k][0]) for k in ks], dtype=np.uint64)
            order = np.argsort(codes)
            self.by_length[n] = (codes[order], np.array(ks)[order])
        #: Terms of five letters and more may be misspelled once, those of nine and more twice.
        self.fuzzy = [k for k, (w, _, _) in enumerate(terms) if len(w) >= 5]
        mine = [terms[k] for k in self.fuzzy]
        self.masks = np.array([_mask(w) for w, _, _ in mine], dtype=np.uint32)
        self.sizes = np.array([len(w) for w, _, _ in mine], dtype=np.int64)
        self.stems = np.array([stem for _, stem, _ in mine], dtype=bool)
        self.reach = np.array([_reach(w) for w, _, _ in mine], dtype=np.int64)
        self.longest = max((len(w) for w, _, _ in mine), default=0)
        self.letters = _letters([w for w, _, _ in mine], self.longest)
        keys: dict[tuple[bool, int, int], set] = {}
        for k, (w, stem, _) in enumerate(mine):
            for front, at, piece in _pieces(w, stem):
                keys.setdefault((front, at, len(piece)), set()).add((int(_hash(piece.decode())), k))
        self.keys = []
        for key, pairs in sorted(keys.items()):
            codes, ks = zip(*sorted(pairs), strict=True)
            self.keys.append((*key, np.array(codes, dtype=np.uint64), np.array(ks, dtype=np.int64)))
        #: Each node has the terms that end there and, under None, the most edits that a term below it allows.
        self.near_trie: dict = {None: 0}
        for k in self.fuzzy:
            w, stem, _ = terms[k]
            node = self.near_trie
            for c in w:
                node[None] = max(node[None], _reach(w))
                node = node.setdefault(c, {None: 0})
            node[None] = max(node[None], _reach(w))
            node.setdefault("", []).append((k, stem, _reach(w)))
        self.known: dict[str, tuple[int, int]] = {}

    def exact(self, sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The term of each word, -1 for none."""
        out = np.full(len(s), -1, dtype=np.int64)
        for n, (codes, ks) in self.by_length.items():
            pick = np.flatnonzero(e - s > n) if n else np.arange(len(s))
            if not len(pick):
                continue
            h = C.span_hash(sums, s[pick], s[pick] + n if n else e[pick])
            at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
            hit = codes[at] == h
            out[pick[hit]] = ks[at[hit]]
        return out

    def near(self, word: str) -> tuple[int, int]:
        """(term, edits) of the nearest term within reach of a word, (-1, 0) for none."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()  # a cache; what is forgotten is found again
            got = self.known[word] = self._intersect(word)
        return got

    def cut(self, data: bytes) -> str:
        """What near() needs of a word: no term tells words apart by what follows."""
        return data[: 4 * (self.longest + 3)].decode("utf-8", "replace")[: self.longest + 3]

    def _intersect(self, word: str) -> tuple[int, int]:
        """The automaton's state is a row of edit costs; a branch ends where none is within reach.

        A stem is met by the beginning of a word that goes on after it.
        """
        best, found = 3, -1
        work = [(self.near_trie, list(range(len(word) + 1)), None, "", 0)]
        while work:
            node, row, above, last, depth = work.pop()
            for k, stem, reach in node.get("", ()):
                cost = row[-1] if not stem else min(row[:-1], default=3) if row[-1] else 3
                if cost < best and cost <= reach:
                    best, found = cost, k
            for c, child in node.items():
                if not c:
                    continue
                step = [depth + 1] + [9] * len(word)
                for i in range(max(0, depth - 2), min(len(word), depth + 3)):  # others cost more than two edits
                    x = word[i]
                    cost = min(step[i] + 1, row[i + 1] + 1, row[i] + (x != c))
                    if above is not None and i and x == last and word[i - 1] == c:
                        cost = min(cost, above[i - 1] + 1)  # two letters changed places
                    step[i + 1] = cost
                if min(step) <= child[None] and min(step) < best:
                    work.append((child, step, row, c, depth + 1))
        return (found, best) if found >= 0 else (-1, 0)

    def candidates(self, low: np.ndarray, sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Places of the words that are within reach of a term: pairs that share a piece and enough letters, then run letter by letter."""
        n_terms, pairs = len(self.fuzzy), [np.empty(0, np.int64)]
        for front, at, n, codes, ks in self.keys:
            pick = np.flatnonzero(e - s >= at + n)
            h = C.span_hash(sums, s[pick] + at, s[pick] + at + n) if front else C.span_hash(sums, e[pick] - n, e[pick])
            lo = np.searchsorted(codes, h)
            met = np.flatnonzero(codes[np.minimum(lo, len(codes) - 1)] == h)
            pick, lo, many = pick[met], lo[met], np.searchsorted(codes, h[met], "right") - lo[met]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.repeat(pick, many) * n_terms + ks[np.repeat(lo, many) + nth])
        pairs = np.unique(np.concatenate(pairs))
        if not len(pairs):
            return pairs
        at, word = np.unique(pairs // n_terms, return_inverse=True)
        term = pairs % n_terms
        sizes = np.minimum(e[at] - s[at], 4 * (self.longest + 3))
        begins = np.cumsum(sizes) - sizes
        flat = np.repeat(s[at] - begins, sizes) + np.arange(sizes.sum())
        masks = np.bitwise_or.reduceat(_BIT[low[flat]], begins)[word]
        letters = np.add.reduceat(((low[flat] & 0xC0) != 0x80).astype(np.int64), begins)[word]
        m, n, stem, reach = self.masks[term], self.sizes[term], self.stems[term], self.reach[term]
        ok = (letters >= n - reach) & (np.bitwise_count(m & ~masks) <= reach)
        ok &= stem | ((letters <= n + reach) & (np.bitwise_count(masks & ~m) <= reach))
        word, term = word[ok], term[ok]
        used, word = np.unique(word, return_inverse=True)
        texts = [self.cut(low[i:j].tobytes()) for i, j in zip(s[at[used]].tolist(), e[at[used]].tolist(), strict=True)]
        return at[used[np.unique(word[self._within(texts, word, term)])]]

    def _within(self, texts: list[str], word: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether each pair of a text and a term is within reach: rows of edit costs of all pairs at a time, two places to both sides."""
        pad, far = 2, 9
        chars = _letters(texts, self.longest + 3 + pad, pad)
        sizes = np.array([len(w) for w in texts], dtype=np.int64)[word]
        n, stem, reach = self.sizes[term], self.stems[term], self.reach[term]
        # row i: costs of i letters of the term against i - 2 .. i + 2 letters of the word
        row, above = np.tile(np.array([far, far, 0, 1, 2], dtype=np.int8), (len(word), 1)), None
        out = np.zeros(len(word), bool)
        live = np.arange(len(word))
        for i in range(1, self.longest + 1):
            c, step = self.letters[term[live], i - 1], np.full((len(live), 5), far, dtype=np.int8)
            x = chars[word[live], i - 3 + pad : i + 2 + pad]  # the word's letters i - 2 .. i + 2
            before = chars[word[live], i - 4 + pad : i + 1 + pad] if i > 1 else None
            for d in range(5):
                j = i + d - 2
                if j < 0:
                    continue
                cost = row[:, d + 1] + 1 if d < 4 else np.full(len(live), far, np.int8)
                if j:
                    cost = np.minimum(cost, row[:, d] + (x[:, d] != c))
                    if d:
                        cost = np.minimum(cost, step[:, d - 1] + 1)
                    if i > 1 and j > 1:
                        swap = (x[:, d] == self.letters[term[live], i - 2]) & (before[:, d] == c)
                        cost = np.where(swap, np.minimum(cost, above[:, d] + 1), cost)
                step[:, d] = np.where(j <= sizes[live], cost, far)
            done = n[live] == i
            if done.any():
                mine, rest = live[done], sizes[live[done]] - i
                place = np.arange(-2, 3)
                costs = np.where(np.where(stem[mine, None], place < rest[:, None], place == rest[:, None]), step[done], far)
                same = (rest == 0) & (step[done][:, 2] == 0)
                out[mine] = (costs.min(axis=1) <= reach[mine]) & ~(stem[mine] & same)
            on = ~done & (step.min(axis=1) <= reach[live])
            above, row, live = row[on], step[on], live[on]
            if not len(live):
                break
        return out


def _letters(words: list[str], width: int, pad: int = 0) -> np.ndarray:
    """Code points, a row for each word, 0 around it."""
    text = "".join("\0" * pad + w.ljust(width, "\0") for w in words)
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(words), pad + width)


def _reach(w: str) -> int:
    return 1 if len(w) < 9 else 2


def _pieces(w: str, stem: bool) -> set[tuple[bool, int, bytes]]:
    """(from the front, first byte or 0, bytes) of pieces of which each word within reach has one whole.

    k edits leave one of k + 1 pieces whole, but for two letters that change places across a cut: there
    the pieces of the swapped term are taken. The first piece stands at the front of the word and the last
    one at its end; others, and the last one of a stem, are shifted by one edit, of a letter of four bytes
    at most. (Where a shifted piece is the only whole one, one edit stands before it.)
    """
    n = _reach(w) + 1
    cuts = [len(w) * i // n for i in range(n + 1)]
    out = set()
    for swap in (0, *cuts[1:-1]):
        v = w if not swap else w[: swap - 1] + w[swap] + w[swap - 1] + w[swap + 1 :]
        for i in range(n):
            piece, at = v[cuts[i] : cuts[i + 1]].encode(), len(v[: cuts[i]].encode())
            if not i:
                out.add((True, 0, piece))
            elif i == n - 1 and not stem:
                out.add((False, 0, piece))
            elif not swap or stem:
                out |= {(True, at + d, piece) for d in range(-4, 5) if at + d >= 0}
    return out


def _hash(w: str) -> np.uint64:
    b = np.frombuffer(w.encode(), dtype=np.uint8)
    return C.word_hashes(b, np.array([0]), np.array([len(b)]))[0]


_BIT = np.array([1 << (b - 97) if 97 <= b <= 122 else 1 << 26 if b >= 128 else 1 << (27 + b % 5) for b in range(256)], dtype=np.uint32)


def _mask(w: str) -> int:
    return int(np.bitwise_or.reduce(_BIT[np.frombuffer(w.encode(), dtype=np.uint8)]))


def figures(lexicon: Lexicon, low: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of model inputs for each document of a chunk."""
    s, e, first = C.words(low, offs, blank=False)
    n = np.diff(first)
    x = np.zeros((len(n), len(PRIOR)))
    x[:, 0] = 1
    x[:, 5] = 0.2 * np.log1p(n) - 1
    if not len(s):
        return x
    sums = C.prefix_sums(C.BYTE_CODES[low])
    term, edits = lexicon.exact(sums, s, e), np.zeros(len(s), np.int8)
    rest = np.flatnonzero((term < 0) & (e - s >= 4))
    data = low.tobytes()
    # each word of a chunk is looked at once
    _, one, same = np.unique(C.span_hash(sums, s[rest], e[rest]), return_index=True, return_inverse=True)
    got = np.full((len(one), 2), (-1, 0), dtype=np.int64)
    one = rest[one]
    for i in lexicon.candidates(low, sums, s[one], e[one]).tolist():
        got[i] = lexicon.near(lexicon.cut(data[s[one[i]] : e[one[i]]]))
    term[rest], edits[rest] = got[same, 0], got[same, 1]
    hits = np.flatnonzero(term >= 0)
    doc = np.searchsorted(first, hits, "right") - 1
    weight = lexicon.weights[term[hits]]
    plain = edits[hits] == 0
    exact = np.bincount(doc[plain], weight[plain], len(n))
    near = np.bincount(doc[~plain], weight[~plain] * 0.5 ** edits[hits][~plain], len(n))
    # context windows around hits: how dense the passage is, and whether it quotes or addresses
    dense, quoted, address = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    total = np.concatenate(([0], np.cumsum(weight * 0.5 ** edits[hits])))
    upto = np.searchsorted(hits, np.minimum(hits + 2 * WINDOW, first[doc + 1]))
    np.maximum.at(dense, doc, total[upto] - total[: len(hits)])
    for i, d, w in zip(hits.tolist(), doc.tolist(), weight.tolist(), strict=True):
        lo, hi = max(int(first[d]), i - WINDOW), min(int(first[d + 1]), i + WINDOW + 1)
        near_words = {data[s[j] : e[j]].decode("utf-8", "replace") for j in range(max(lo, i - 4), min(hi, i + 5))}
        before, after = data[max(int(offs[d]), int(s[i]) - 2) : s[i]], data[e[i] : min(int(offs[d + 1]), int(e[i]) + 2)]
        inside = any(q in before for q in (b'"', b"'", b"\xab", b"\x9c")) and any(q in after for q in (b'"', b"'", b"\xbb", b"\x9d"))
        quoted[d] += w * bool(inside or near_words & QUOTE)
        address[d] += w * bool(near_words & ADDRESS)
    x[:, 1] = np.log1p(exact)
    x[:, 2] = np.log1p(near)
    x[:, 3] = np.log1p(dense)
    x[:, 4] = np.log1p(quoted)
    x[:, 6] = np.log1p(address)
    return x


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to the prior ones; a step is halved until it lowers the loss."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + penalty / 2 * ((w - PRIOR) ** 2).sum()

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * (w - PRIOR))
        share = 1.0
        while share > 1e-6 and loss(w - share * step) > now:
            share /= 2
        w = w - share * step
        now = loss(w)
        if np.abs(share * step).max() < 1e-8 or share <= 1e-6:
            break
    return w


class Model:
    """What score() and reject() send to the tasks."""

    def __init__(self, terms: list[tuple[str, bool, float]], weights: np.ndarray):
        self.terms, self.weights = terms, weights

    def scores(self, lexicon: Lexicon, column) -> np.ndarray:
        out = [np.empty(0)]
        for _, _, buf, offs in C.chunks(column):
            out.append(1 / (1 + np.exp(-np.clip(figures(lexicon, C.lower(buf), offs) @ self.weights, -30, 30))))
        return np.concatenate(out)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights from the labelled rows outside the held-out fold."""
    picked = F.broadcast(sample_labels(labels))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    train = C.saved(docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")
    terms = learn_lexicon(train)

    def run(batches):
        lexicon = Lexicon(terms)
        for b in batches:
            rows = [figures(lexicon, C.lower(buf), offs) for _, _, buf, offs in C.chunks(b.column("text"))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).tolist(), pa.list_(pa.float64())), b.column("toxic").cast(pa.int32())], names=["x", "y"])

    got = train.select("text", "toxic").mapInArrow(run, "x array<double>, y int").toPandas()
    return Model(terms, fit(np.array(got.x.tolist()).reshape(-1, len(PRIOR)), got.y.to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        lexicon = Lexicon(model.terms)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(lexicon, b.column("text")))], names=["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents below score 0.5, with all their columns."""
    place = docs.columns.index("text")

    def run(batches):
        lexicon = Lexicon(model.terms)
        for b in batches:
            yield b.filter(pa.array(model.scores(lexicon, b.column(place)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, C.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
