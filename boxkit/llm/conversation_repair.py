"""Repair of the role order of conversations at the least cost, by secondary-sorted streams.

The roles of a repaired conversation are one optional system turn and then pairs
of user and assistant. An automaton of four states reads them, and the cheapest
edits (keep, give another role, delete, insert) are a shortest path through rows
and states.

1. Rows go to tasks by conversation and are sorted by turn, last row first, with
   a few flags in place of their texts. ``mapInPandas`` carries the cost from
   each state to the end across Arrow batches; what it keeps of a row is one
   number of two bytes, which stands for the best edit from each of the four
   states. Of a giant conversation these backpointers are put away in compressed
   blocks. At the first row of a conversation they are read forwards, and since
   the cost to the end is known everywhere, the first letter that lies on a
   cheapest path gives the least of all cheapest edit strings.
2. The edit strings, one row each, come before the rows of their conversation in a
   second stream, sorted by turn, which applies them and hashes the outcome row
   by row; no more than the edit string and one batch of texts is held.

A conversation is never gathered: both streams work in one pass, and the sorts
spill. Which rows repeat an earlier one is told by a window over equal rows of a
conversation, on the exchange of the first stream.

Defined cases: null roles and texts count as one space, and so do null ids and
turns in the checksum; rows with a null id are one conversation; null turns come
first and are no turns for gaps; rows of the same turn go by a hash of role and
text, equal ones beside each other; roles are told by their first letter, and one
without any is never legal; a
conversation without rows left has zeros, no edits and the hash of nothing; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. Where an added or changed role leads, and its role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Where a kept row leads, by the first letter of its role.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Costs from each state after the last row: pairs have to be completed.
_LAST = (0, 2 * INSERT, INSERT, 0)
BLOCK = 1 << 20


def _cast(df: DataFrame, c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, lost) as damaged; the lost ones stay, marked, so that every id is known."""
    kind = F.pmod(F.crc32(F.concat(_cast(conversations, "conv_id"), F.lit(":"), _cast(conversations, "turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("_kind"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("lost"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with columns without nulls for pandas, where a null would turn whole numbers into floating ones."""
    hashed = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2")]
    return rows.select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"), F.col("conv_id").isNotNull().alias("known"), F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).cast("long").alias("time"), *hashed)


class _Costs:
    """Steps of the costs to the end over one more row in front; steps seen before are looked up."""

    def __init__(self):
        self.steps: dict[tuple, tuple] = {}
        self.codes: dict[tuple, int] = {}
        self.edits: list[tuple] = []

    def step(self, costs: tuple, row: tuple) -> tuple:
        """(costs less the smallest, the smallest, code of the edits) before a row (first letter, has to go, truncated)."""
        known = self.steps.get((costs, row))
        if known is None:
            known = self.steps[costs, row] = self._step(costs, *row)
        return known

    def _step(self, costs, letter, gone, truncated):
        more = TRUNCATED if truncated else 0
        ways = []
        for s in range(4):
            way = {"D": (DELETE + costs[s], s)}
            if not gone:
                if letter in _KEPT[s]:
                    way["K"] = (more + costs[_KEPT[s][letter]], _KEPT[s][letter])
                way["R"] = (REROLE + more + costs[_NEXT[s]], _NEXT[s])
            ways.append(way)
        best = [min(c for c, _ in w.values()) for w in ways]
        for _ in range(2):  # two rows may be added in front of this one
            best = [min(b, INSERT + best[_NEXT[s]]) for s, b in enumerate(best)]
        for s in range(4):
            ways[s]["I"] = (INSERT + best[_NEXT[s]], _NEXT[s])
        edits = tuple(next((e, ways[s][e][1]) for e in "DIKR" if e in ways[s] and ways[s][e][0] == best[s]) for s in range(4))
        code = self.codes.setdefault(edits, len(self.edits))
        if code == len(self.edits):
            self.edits.append(edits)
        low = min(best)
        return tuple(b - low for b in best), low, code


class _Backpointers:
    """Codes of two bytes, last row first; full blocks are compressed."""

    def __init__(self):
        self.full, self.open = [], []

    def add(self, code: int) -> None:
        self.open.append(code)
        if len(self.open) == BLOCK:
            self.full.append(zlib.compress(np.array(self.open, np.uint16).tobytes(), 1))
            self.open = []

    def forwards(self):
        yield from reversed(self.open)
        for block in reversed(self.full):
            yield from np.frombuffer(zlib.decompress(block), np.uint16)[::-1].tolist()


class _Conversation:
    """What is carried of one conversation from its last row to its first."""

    def __init__(self, steps: _Costs):
        self.steps, self.costs, self.base, self.back = steps, _LAST, 0, _Backpointers()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = 0
        self.next = self.first = self.last = None

    def add(self, letter, blank, duplicate, truncated, timed, time) -> None:
        self.rows += 1
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated and not (blank or duplicate)
        if self.next is not None:
            self.illegal += letter + self.next not in ("su", "ua", "au")
        self.next = letter
        if timed:
            self.turns += time != self.first
            self.last = time if self.last is None else self.last
            self.first = time
        self.costs, low, code = self.steps.step(self.costs, (letter, blank or duplicate, truncated))
        self.base += low
        self.back.add(code)

    def edits(self) -> str:
        state, out = 0, []
        for code in self.back.forwards():
            while True:
                letter, state = self.steps.edits[code][state]
                out.append(letter)
                if letter != "I":
                    break
        out.append("I" * (_LAST[state] // INSERT))
        return "".join(out)

    def row(self, key) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost = self.base + self.costs[0]
        return (*key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.edits())


_FOUND = ["id", "known", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_FOUND_TYPES = "id string, known boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _decide(batches):
    """One row for each conversation of batches of rows that are sorted by conversation, last row first."""
    steps, key, now = _Costs(), None, None
    for b in batches:
        out = []
        columns = (b[c].tolist() for c in ("id", "known", "lost", "letter", "blank", "again", "cut", "timed", "time"))
        for id_, known, lost, *row in zip(*columns, strict=True):
            if key != (id_, known):
                if key is not None:
                    out.append(now.row(key))
                key, now = (id_, known), _Conversation(steps)
            if not lost:
                now.add(*row)
        if out:
            yield pd.DataFrame(out, columns=_FOUND)
    if key is not None:
        yield pd.DataFrame([now.row(key)], columns=_FOUND)


class _Repair:
    """The edits of one conversation and the hash of what they have made so far."""

    def __init__(self, found: tuple):
        self.found, self.edits, self.at, self.state = found, found[-1], 0, 0
        self.hash, self.some = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.some else b"") + f"{role}:{text}".encode())
        self.some = True

    def insert(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self._put(_ROLE[self.state], "")
            self.state = _NEXT[self.state]
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text)
            self.state = _KEPT[self.state][role[:1]]
        elif edit == "R":
            self._put(_ROLE[self.state], text)
            self.state = _NEXT[self.state]

    def row(self) -> tuple:
        self.insert()
        return (*self.found, self.hash.hexdigest())


def _apply(batches):
    """Rows of conversations, each after the row with its edits, to one row each with the hash of the repaired one."""
    now = None
    for b in batches:
        out = []
        for body, role, text, *found in zip(*(b[c].tolist() for c in ("body", "role", "text", *_FOUND)), strict=True):
            if body:
                now.add(role, text)
            else:
                if now is not None:
                    out.append(now.row())
                now = _Repair(tuple(found))
        if out:
            yield pd.DataFrame(out, columns=[*_FOUND, "repaired_sha256"])
    if now is not None:
        yield pd.DataFrame([now.row()], columns=[*_FOUND, "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, lost): its faults, the cheapest edits and the hash of what they give.

    Rows marked as lost take no part; a conversation of such rows only is an empty one.
    """
    as_id = rows.schema["conv_id"].dataType
    keyed = _keyed(rows)
    blank, cut = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
    flags = keyed.select("id", "known", "lost", F.substring("role", 1, 1).alias("letter"), (~F.col("text").rlike(blank)).alias("blank"), (~F.col("text").rlike(cut)).alias("cut"), "timed", "time", "h1", "h2")
    same = W.partitionBy("id", "known", "lost", "h1", "h2").orderBy("timed", "time")
    flags = flags.repartition("id", "known").withColumn("again", F.row_number().over(same) > 1)
    flags = flags.sortWithinPartitions("id", "known", F.desc("timed"), F.desc("time"), F.desc("h1"), F.desc("h2"), F.desc("again"))
    found = C.saved(flags.mapInPandas(_decide, _FOUND_TYPES), "edits")
    heads = found.select(F.lit(False).alias("body"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("timed"), F.lit(0).cast("long").alias("time"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), *_FOUND)
    none = [F.lit(0).cast("long").alias(c) for c in _FOUND[2:-1]]
    bodies = keyed.where(~F.col("lost")).select(F.lit(True).alias("body"), "role", "text", "timed", "time", "h1", "h2", "id", "known", *none, F.lit("").alias("audit"))
    stream = heads.unionByName(bodies).repartition("id", "known").sortWithinPartitions("id", "known", "body", "timed", "time", "h1", "h2")
    out = stream.mapInPandas(_apply, f"{_FOUND_TYPES}, repaired_sha256 string")
    return out.select(F.when(F.col("known"), F.col("id").cast(as_id)).alias("conv_id"), *_FOUND[2:], "repaired_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(C.read(spark, sf_dir, "conversations")))


_ROWS = """
WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
ks AS (SELECT k, list_reduce(flatten(list_transform(string_split(k, ''), lambda c: [unicode(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[])), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT) AS c FROM (SELECT DISTINCT k FROM c0)),
c1 AS (SELECT conv_id, turn, role, text, xor(c, 4294967295) % 20 AS h FROM c0 JOIN ks USING (k)),
c2 AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c1 WHERE h <> 0),
"""
ORACLE = (
    _ROWS
    + r"""
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS l,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS dup, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM c2),
b AS (SELECT conv_id, n AS i, 0 AS g0, 6 AS g1, 3 AS g2, 0 AS g3, NULL::VARCHAR AS l, false AS gone, 0 AS t, 0 AS p0, 6 AS p1, 3 AS p2, 0 AS p3 FROM r WHERE i = 0
  UNION ALL SELECT conv_id, i, least(h0, 3 + least(h2, 3 + h3)), least(h1, 3 + least(h2, 3 + h3)), least(h2, 3 + h3), least(h3, 3 + h2), l, gone, t, p0, p1, p2, p3 FROM (
    SELECT r.conv_id, r.i, r.l, blank OR dup AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS t, g0 AS p0, g1 AS p1, g2 AS p2, g3 AS p3,
      least(4 + g0, CASE WHEN blank OR dup THEN 9e8 ELSE r.t + least(CASE r.l WHEN 's' THEN g1 WHEN 'u' THEN g2 ELSE 9e8 END, 3 + g2) END)::INT AS h0,
      least(4 + g1, CASE WHEN blank OR dup THEN 9e8 ELSE r.t + least(CASE r.l WHEN 'u' THEN g2 ELSE 9e8 END, 3 + g2) END)::INT AS h1,
      least(4 + g2, CASE WHEN blank OR dup THEN 9e8 ELSE r.t + least(CASE r.l WHEN 'a' THEN g3 ELSE 9e8 END, 3 + g3) END)::INT AS h2,
      least(4 + g3, CASE WHEN blank OR dup THEN 9e8 ELSE r.t + least(CASE r.l WHEN 'u' THEN g2 ELSE 9e8 END, 3 + g2) END)::INT AS h3
    FROM b JOIN (SELECT *, CASE WHEN cut THEN 3 ELSE 0 END AS t FROM r) r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
g AS MATERIALIZED (SELECT *, [g0, g1, g2, g3] AS g, [p0, p1, p2, p3] AS p FROM b),
f AS (SELECT conv_id, 0 AS i, 0 AS s, 0 AS step, ''::VARCHAR AS e, NULL::BIGINT AS at, NULL::VARCHAR AS made FROM r WHERE i = 0
  UNION ALL SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN CASE l WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN s = 2 THEN 3 ELSE 2 END END,
    step + 1, e, CASE WHEN e IN ('K', 'R') THEN i END, CASE WHEN e IN ('I', 'R') THEN CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END END
  FROM (SELECT f.conv_id, f.i, f.s, f.step, g.l, CASE WHEN g.l IS NULL AND n IS NULL THEN 'I'
      WHEN 4 + p[s + 1] = g.g[s + 1] THEN 'D' WHEN 3 + g.g[CASE WHEN s = 2 THEN 4 ELSE 3 END] = g.g[s + 1] THEN 'I'
      WHEN NOT gone AND ((l = 's' AND s = 0 AND t + p[2] = g.g[1]) OR (l = 'u' AND s <> 2 AND t + p[3] = g.g[s + 1]) OR (l = 'a' AND s = 2 AND t + p[4] = g.g[3])) THEN 'K' ELSE 'R' END AS e
    FROM f JOIN (SELECT g.*, r.n FROM g LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i) g ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.i = f.i WHERE g.n IS NOT NULL OR s IN (1, 2))),
o AS (SELECT f.conv_id, string_agg(e, '' ORDER BY step) AS audit, string_agg(CASE WHEN e IN ('K', 'R', 'I') THEN coalesce(made, role) || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END, chr(10) ORDER BY step) AS fixed
  FROM f LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.at WHERE step > 0 GROUP BY f.conv_id),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT dup AND NOT blank) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(l) OVER (PARTITION BY conv_id ORDER BY i) || l AS pair FROM r) GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(g0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(fixed, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id AND g.i = 0"""
)
