"""Near-duplicate documents by an exact n-gram Jaccard join over a token-group matrix.

1. A document's set holds its word shingles, hashed. If two sets reach the
   threshold, the smallest hashes of each share so many that most documents are
   ruled out by how few of theirs occur anywhere else. Only counts come back.
2. The remaining sets are partitioned into groups of similar ones: of the sets
   that share a minimum hash, the one with the largest share of tokens known
   elsewhere leads, and those that link to it (verified exactly) are its group.
   A group is connected, so no further pair within it matters, however large it is.
3. The matrix holds each group's token union, and which tokens its leader has. A
   set can only link to a group whose union has four fifths of its tokens, so
   sets are bound first against all other groups together, then group by group.
   Where the tokens shared with the leader don't give a link to it already, the
   group is opened: its members are compared exactly, as far as the tokens that
   they and the set share with the leader and outside of it can suffice.

So links between texts are lost nowhere, and no list of all pairs of a group is
made. Equal sets are compared once.

Defined cases: null, empty and blank texts have no shingles and link with
nothing; texts of fewer words than a shingle are one shingle as a whole; equal
rows share a component; null doc_ids are rows of their own that never name a
component unless no id is known (then null); further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .components import components
from .repeats import EX_TYPES, EXCHANGE, NAMES, TO_DOCS, Sender, batches_of, meet, to_documents

WORDS, PERCENT, SEEDS, VOTES = 5, 80, 4, 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each document's distinct shingles in ascending order of their hashes."""
    low = C.lower(buf)
    s, e, first = C.words(low, offsets, blank=True)
    sums = C.prefix_sums(C.word_hashes(low, s, e))
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(s))
    full = at + size <= first[doc + 1]
    short = ~full & (at == first[doc])  # the whole text of fewer words
    at, end = at[full | short], np.where(full, at + size, first[doc + 1])[full | short]
    h, doc = C.span_hash(sums, at, end), doc[full | short]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _least(n, percent: int):
    """The fewest common tokens that a set of n must have with a linked one."""
    return -(-n * percent // 100)


def _more(n):
    """How many tokens beyond the first a prefix is lengthened by, and that two linked ones then share."""
    return n // 8


def links(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """_rid, doc_id, n_shingles and component_id of every document, linked where 100 * common >= percent * union."""
    spark, buckets = docs.sparkSession, C.n_buckets(docs.sparkSession)
    rows, ids_of = C.numbered(C.with_row_id(docs, "doc_id", "text"))

    def send_prefixes(batches):
        sender = Sender(buckets, False, "tokens")

        def out():
            for b in batches:
                rid = b.column("_rid").to_numpy()
                for lo, hi, buf, offs in C.chunks(b.column("text")):
                    h, first = shingle_sets(buf, offs, size)
                    n = np.diff(first)
                    many = np.minimum(n, n - _least(n, percent) + 1 + _more(n))
                    at = np.repeat(first[:-1] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    one = np.ones(len(at), np.int64)
                    sender.add(h[at], np.zeros(len(at), np.uint64), np.repeat(rid[lo:hi], many), one, one, one)
                    yield from sender.rows()
            yield from sender.rows(last=True)

        return batches_of(out(), NAMES, EX_TYPES)

    met = rows.mapInArrow(send_prefixes, EXCHANGE).groupBy("part").applyInArrow(meet(buckets, False, "tokens"), TO_DOCS)
    shared = to_documents(met).select("srid", F.octet_length("state").alias("shared"))

    def sets(batches):
        for b in batches:
            shared = b.column("shared").fill_null(0).to_numpy()
            for lo, hi, buf, offs in C.chunks(C.unsqueezed(b.column("text"))):
                h, first = shingle_sets(buf, offs, size)
                n = np.diff(first)
                stay = (n > 0) & (shared[lo:hi] >= 1 + _more(_least(n, percent)))
                known = shared[lo:hi] / np.maximum(1, np.minimum(n, n - _least(n, percent) + 1 + _more(n)))
                tokens, marks, prints = [None] * (hi - lo), [None] * (hi - lo), [None] * (hi - lo)
                for k in np.flatnonzero(stay).tolist():
                    t = h[first[k] : first[k + 1]]
                    tokens[k] = t.view(np.int64)
                    marks[k] = np.array([C.mix(t ^ np.uint64(0x5851F42D4C957F2D * (j + 1) % (1 << 64))).min() for j in range(VOTES)]).view(np.int64)
                    prints[k] = np.array([t.sum(), C.mix(t).sum()]).view(np.int64)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_rid").slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(tokens, longs), pa.array(marks, longs), pa.array(prints, longs), pa.array(known, pa.float64())], names=["_rid", "doc_id", "n", "tokens", "marks", "prints", "known"])

    joined = C.squeezed(rows).join(shared.hint("shuffle_hash"), F.col("_rid") == F.col("srid"), "left").drop("srid")
    # the one table with the sets; all that follows joins it by _rid
    every = C.saved_by(joined.mapInArrow(sets, "_rid long, doc_id long, n long, tokens array<long>, marks array<long>, prints array<long>, known double"), "_rid", "shingle-sets")
    left = every.where("tokens IS NOT NULL")
    same = ["n", F.col("prints")[0].alias("p0"), F.col("prints")[1].alias("p1")]
    reps = left.select("_rid", "doc_id", "marks", "known", *same).groupBy("n", "p0", "p1").agg(F.min("_rid").alias("rep"), F.min("doc_id").alias("doc_id"), F.min_by("marks", "_rid").alias("marks"), F.min("known").alias("known"))
    reps = C.saved(reps, "distinct-sets")
    tokens = left.select(F.col("_rid").alias("rep"), F.col("n").alias("size"), "tokens")

    star = C.saved(_verified(tokens, _stars(reps, percent), percent), "star-links")
    classes = components(star)
    # each set goes to one leader, the one that shares most; a leader that goes to another one leads no more
    joins = star.groupBy("b").agg(F.max(F.struct(F.col("common") / F.col("na"), "a", "common")).alias("m")).select("b", F.col("m.a").alias("a"), F.col("m.common").alias("common"))
    joins = joins.join(star.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    grouped = reps.join(joins, F.col("rep") == F.col("b"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    grouped = grouped.select("rep", "n", "doc_id", F.coalesce("a", "rep").alias("grp"), F.coalesce("common", "n").alias("with_lead"), F.coalesce("root", "rep").alias("class"))
    grouped = C.saved(grouped, "token-groups")
    merged = _across(grouped.drop("doc_id"), tokens, percent, buckets)
    # a class may hold a third of all rows: names are joined where Spark can split them
    named = C.saved(grouped.join(merged, F.col("class") == F.col("node"), "left").select("rep", "doc_id", F.coalesce("root", "class").alias("root")), "named-sets")
    names = C.saved(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "class-names")
    named = C.saved(named.drop("doc_id").join(names, "root"), "named-sets")
    of_key = C.saved(reps.select("rep", "n", "p0", "p1").join(named, "rep").drop("rep"), "set-names")
    # documents without a set that could link are their own class
    rows = every.select("_rid", "doc_id", "n", *(F.col("prints")[k].alias(f"p{k}") for k in (0, 1)))
    out = rows.join(of_key, ["n", "p0", "p1"], "left").select("_rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", -1 - F.col("_rid")).alias("root"))
    out = C.saved(C.named(out, ids_of, "doc_id", "component_id"), "linked-documents")
    C.drop(every, reps, star, classes, grouped, merged, named, names, of_key)
    return out


def _stars(reps: DataFrame, percent: int) -> DataFrame:
    """Each set with the leader of those that share a minimum hash, for each of the first seeds, if their sizes allow a link.

    The text that others were changed from shares most minimum hashes with them, so it leads; they may be less like each other.
    """
    marks = reps.select("rep", "n", "known", F.posexplode("marks").alias("seed", "mark"))
    shared = C.saved(marks.groupBy("seed", "mark").agg(F.count("*").alias("sets")).where("sets > 1"), "shared-marks")
    votes = marks.select("rep", "seed", "mark").join(shared, ["seed", "mark"]).groupBy("rep").agg(F.sum("sets").alias("votes"))
    marks = C.saved(marks.where(F.col("seed") < SEEDS).join(votes, "rep"), "marks")
    leads = marks.groupBy("seed", "mark").agg(F.max(F.struct("votes", "known", (-F.col("rep")).alias("order"), "n")).alias("lead"))
    leads = leads.select("seed", "mark", (-F.col("lead.order")).alias("a"), F.col("lead.n").alias("na"))
    pairs = marks.join(leads, ["seed", "mark"]).where("rep <> a").where(100 * F.least("n", "na") >= percent * F.greatest("n", "na"))
    return pairs.select("a", F.col("rep").alias("b")).distinct()


def _common(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with na, nb and common. A set may be a of very many pairs, so b's tokens go to where a's are and not the reverse."""
    pairs = C.saved(pairs, "pairs")
    with_b = pairs.join(tokens.selectExpr("rep AS b", "size AS nb", "tokens AS tb"), "b")
    with_a = pairs.select("a").distinct().join(tokens.selectExpr("rep AS a", "size AS na", "tokens AS ta"), "a")
    return with_b.join(with_a, "a").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("common"))


def _verified(tokens: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    return _common(tokens, pairs).where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))


def _shared_classes(grouped: DataFrame, tokens: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Classes that could hold a set with enough tokens in the unions of other classes: the matrix' rows, bound all at once."""

    def send(batches):
        sender = Sender(buckets, False, "groups")

        def out():
            for b in batches:
                of = b.column("class").to_numpy()
                t = b.column("tokens")
                of = np.repeat(of, pa.compute.list_value_length(t).to_numpy())
                one = np.ones(len(of), np.int64)
                sender.add(t.flatten().to_numpy().view(np.uint64), of.astype(np.uint64), of, one, one, one)
                yield from sender.rows()
            yield from sender.rows(last=True)

        return batches_of(out(), NAMES, EX_TYPES)

    rows = tokens.join(grouped.select("rep", "class"), "rep").select("class", "tokens")
    met = rows.mapInArrow(send, EXCHANGE).groupBy("part").applyInArrow(meet(buckets, False, "groups"), TO_DOCS)
    mixed = to_documents(met).select("srid", F.octet_length("state").alias("mixed"))
    small = grouped.groupBy("class").agg(F.min("n").alias("smallest"))
    return mixed.join(small, F.col("srid") == F.col("class")).where(100 * F.col("mixed") >= percent * F.col("smallest")).select("class")


def _across(grouped: DataFrame, sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """node and root of the classes that links between their groups unite."""
    some = C.saved(_shared_classes(grouped, sets, percent, buckets), "shared-classes")
    grouped = C.saved(grouped.join(some, "class"), "open-groups")
    least = F.ceil(F.col("n") * percent / 100)
    tokens = C.saved(sets.join(grouped, "rep").select("rep", "grp", "class", "n", F.explode("tokens").alias("t")), "open-tokens")
    # the matrix without the tokens of a single class, which bound nothing
    matrix = tokens.groupBy("t", "grp", "class").agg(F.max(F.col("rep") == F.col("grp")).alias("lead"))
    shared = matrix.groupBy("t").agg(F.count("*").alias("groups"), F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 < c1").select("t", "groups")
    sizes = grouped.groupBy("grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("sets"), F.max(F.col("n") - F.col("with_lead")).alias("extra"))
    matrix = C.saved(matrix.join(shared, "t").join(sizes, "grp"), "token-group-matrix")
    cells = C.saved(tokens.join(matrix.select("t", "grp", "lead", "groups", "sets"), ["t", "grp"]), "shared-tokens")
    bound = cells.groupBy("rep", "n").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("rep", "c")
    query = C.saved(cells.join(bound, "rep"), "bounded-sets")
    # of the tokens a linked group may lack, one more than it can: the rarest first
    rarest = Window.partitionBy("rep").orderBy("groups", "t")
    probe = query.withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= F.col("c") - least + 1)
    rows = matrix.select("t", F.col("grp").alias("other"), F.col("class").alias("other_class"), F.col("lead").alias("in_lead"), "lo", "hi", "extra", F.col("sets").alias("more"))
    # a link is found from either side: the sets of the smaller group are asked for
    turn = (F.col("more") > F.col("sets")) | ((F.col("more") == F.col("sets")) & (F.col("other") < F.col("grp")))
    sized = (percent * F.col("lo") <= 100 * F.col("n")) & (percent * F.col("n") <= 100 * F.col("hi"))
    # the tokens from this one on must suffice for the group's smallest set
    enough = (100 + percent) * (F.col("c") - F.col("nth") + 1) >= percent * (F.col("n") + F.col("lo"))
    pairs = probe.select("rep", "grp", "class", "n", "t", "c", "nth", "sets").join(rows, "t").where((F.col("class") != F.col("other_class")) & turn & sized & enough).select("rep", "n", "class", "other", "other_class", "lo", "extra").distinct()
    pairs = C.saved(pairs, "candidate-groups")
    # the leader itself first: what links to it unites the classes, and what shares too little with it can't link to its group
    x = _common(sets, pairs.select(F.col("other").alias("a"), F.col("rep").alias("b")))
    led = pairs.join(x.select(F.col("a").alias("other"), F.col("b").alias("rep"), F.col("na").alias("lead_n"), F.col("common").alias("x")), ["rep", "other"])
    led = C.saved(led.withColumn("linked", 100 * F.col("x") >= percent * (F.col("n") + F.col("lead_n") - F.col("x"))), "leader-overlaps")
    direct = led.where("linked").selectExpr("class AS a", "other_class AS b").distinct()
    united = components(direct)
    most = F.col("x") + F.least(F.col("n") - F.col("x"), F.col("extra"))
    rest = C.saved(_apart(led.where("NOT linked").where((100 + percent) * most >= percent * (F.col("n") + F.col("lo"))), united), "unlinked-groups")
    full = query.select("rep", "t").join(rest.drop("lo", "extra", "linked", "lead_n"), "rep").join(rows.select("t", "other"), ["t", "other"])
    fit = C.saved(full.groupBy("rep", "n", "class", "other", "other_class", "x").agg(F.count("*").alias("c")).where(F.col("c") >= least), "qualified-groups")
    # tokens of a member that its leader lacks but another class has
    own = cells.where("NOT lead").groupBy("rep").agg(F.count("*").alias("own"))
    members = grouped.where("rep <> grp").join(own, "rep", "left").select(F.col("rep").alias("member"), F.col("n").alias("m"), F.col("grp").alias("other"), "with_lead", F.coalesce("own", F.lit(0)).alias("own"))
    most = F.least("x", "with_lead") + F.least(F.col("c") - F.col("x"), F.col("own"))
    can = 100 * most >= percent * (F.col("n") + F.col("m") - most)
    opened = fit.join(members, "other").where(can & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    opened = C.saved(opened.select("rep", "member", "class", "other_class").distinct(), "opened-groups")
    # a member may be asked for by very many sets
    both = _verified(sets, opened.select(F.col("member").alias("a"), F.col("rep").alias("b")).distinct(), percent).selectExpr("a AS member", "b AS rep")
    out = components(direct.unionByName(opened.join(both, ["rep", "member"]).selectExpr("class AS a", "other_class AS b")))
    C.drop(some, grouped, tokens, matrix, cells, query, pairs, led, united, rest, fit, opened)
    return out


def _apart(pairs: DataFrame, united: DataFrame) -> DataFrame:
    """The pairs whose classes are still two."""
    root = lambda c: F.coalesce("root", c)
    out = pairs.join(united, F.col("class") == F.col("node"), "left").withColumn("class", root("class")).drop("node", "root")
    out = out.join(united, F.col("other_class") == F.col("node"), "left").withColumn("other_class", root("other_class")).drop("node", "root")
    return out.where("class <> other_class")


def keep_first(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that a component has a smaller doc_id (or earlier row) for."""
    linked = links(docs, size, percent).where("root >= 0")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_rid")).getField("_rid").alias("first"))
    gone = linked.join(first, "root").where("_rid <> first").select("_rid")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_rid"))
    return rows.join(gone, "_rid", "left_anti").select("_row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(C.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
