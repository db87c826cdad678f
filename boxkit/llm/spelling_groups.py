"""Groups of spelling variants by asymmetric q-chunks.

A word of length n contributes two disjoint chunks, its first n // 2 letters and
the rest. One edit leaves one of them whole: if it falls into the rest, the first
chunk stands where it stood; if it falls into the first chunk, the rest has moved
by as much as the word has grown. The other word of a pair contributes all
positional grams that such a chunk can meet: for each length that a neighbour can
have, those of the lengths of its chunks at the places that lie within shift one
and that one edit can bring the chunk to. Chunks and grams are joined on content,
length and place, and pairs are verified as they meet, so that only pairs one edit
apart leave the join; a pair that both chunks find counts for the first.

Counting, the join and the forms are built-in expressions. Words are counted
before anything is joined, so that a frequent word is one row. Forms lead to
words of at least twice the count, so chains are short: roots are found by
doubling pointers, over the words with a form only.

Defined cases: a null text has no words; a null doc_id counts as an empty one in
the checksum; a run of one letter that loses it is no word; repeated rows count
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RUN, SHORTEST, LEAST, DAMAGE = r"[A-Za-zÀ-ÿ]+", 5, 3, 97
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, damage: int = DAMAGE, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all texts, of every damage-th by checksum one letter less."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("w"))
    h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    runs = runs.select("w", h.alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    word = F.when(F.col("h") % damage == 0, F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))).otherwise(F.col("w"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def chunks(word: Column) -> Column:
    """The two chunks of a word: (place of the chunk: 0 first or 1 last, length of the word, content)."""
    n = F.length(word)
    cut = (n / 2).cast("int")
    return F.array(F.struct(F.lit(0).alias("side"), n.alias("n"), F.substring(word, F.lit(1), cut).alias("gram")), F.struct(F.lit(1).alias("side"), n.alias("n"), F.substring(word, cut + 1, n - cut).alias("gram")))


def grams(word: Column) -> Column:
    """The positional grams of a word that chunks of words of lengths within one can meet."""
    out = []
    for shift in (-1, 0, 1):  # this word is longer by shift than the one with the chunk
        n = F.length(word) - shift
        cut = (n / 2).cast("int")
        out += [F.struct(F.lit(0).alias("side"), n.alias("n"), F.substring(word, F.lit(1), cut).alias("gram")), F.struct(F.lit(1).alias("side"), n.alias("n"), F.substring(word, cut + 1 + shift, n - cut).alias("gram"))]
    return F.array(*out)


def near(counted: DataFrame) -> DataFrame:
    """(word, other, other_n) of all pairs of words exactly one edit apart, in both directions."""
    a = counted.select("word", F.inline(chunks(F.col("word"))))
    b = counted.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.inline(grams(F.col("word"))).alias("side", "n", "gram"))
    cut = (F.length("word") / 2).cast("int")
    seen = (F.col("a.side") == 1) & (F.substring(F.col("word"), F.lit(1), cut) == F.substring(F.col("other"), F.lit(1), cut))
    meet = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.side") == F.col("b.side"))
    return a.alias("a").join(b.alias("b"), meet & ~seen & (F.levenshtein("word", "other", 1) == 1)).select("word", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: forms followed to the last, each round twice as far."""
    at = C.saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = C.saved(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        C.drop(at)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at, place = new.select("word", "root"), new.saved_at
        at.saved_at = place


def groups(docs: DataFrame, damage: int = DAMAGE, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of (doc_id, text)."""
    counted = C.saved(words(docs, damage, shortest, least), "words")
    found = near(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("best"))).alias("b"))
    found = counted.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.m") >= 2 * F.col("n"), F.struct(F.col("b.best").alias("form"), (-F.col("b.m")).alias("form_n"))).alias("f"))
    found = C.saved(found.select("word", F.col("f.form").alias("form"), "n", "n_near", F.col("f.form_n").alias("form_n")), "forms")
    out = found.join(roots(found.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(C.read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH RECURSIVE o AS MATERIALIZED (SELECT w, k, count(*) AS m FROM (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)) GROUP BY ALL),
h AS (SELECT w, m, xor(4294967295, list_reduce(flatten(list_transform(string_split(k, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), 0, 0, 0, 0, 0, 0, 0] ELSE [192 + (unicode(c) >> 6), 0, 0, 0, 0, 0, 0, 0, 128 + (unicode(c) & 63), 0, 0, 0, 0, 0, 0, 0] END::BIGINT[])), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT)) AS h FROM o),
w AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n, len(word) AS l FROM (SELECT m, CASE WHEN h % 97 = 0 THEN left(w, (h % len(w))::INT) || substr(w, (h % len(w))::INT + 2) ELSE w END AS word FROM h) GROUP BY word HAVING len(word) >= 5 AND sum(m) >= 3),
d AS MATERIALIZED (SELECT word, n, l, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.less = b.word),
s AS MATERIALIZED (SELECT word, count(*) AS n_near, min({'m': -m, 'o': encode(other)}) AS b FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * n THEN decode(b.o) END AS form, CASE WHEN -b.m >= 2 * n THEN -b.m END AS form_n FROM w LEFT JOIN s USING (word)),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, r.next, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM r WHERE next IS NULL) USING (word)"""
