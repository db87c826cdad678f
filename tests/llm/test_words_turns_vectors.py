"""Spelling groups, conversation repair and vector search against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxkit.llm import conversation_repair as R
from boxkit.llm import reshard
from boxkit.llm import spelling_groups as S
from boxkit.llm import vector_search as V

CLASH = ", n long, word string, form string, h long, k1 long, cell long, id string, audit string, _rid long, score double, rank int"


def clash(rows):
    return [(*r, 1, "x", "y", 2, 3, 4, "z", "K", 5, 1.0, 6) for r in rows]


# --- spelling groups


def plain_groups(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in count.items():
        found = sorted((-m, o) for o, m in count.items() if o != w and near(w, o))
        form[w] = found[0][1] if found and -found[0][0] >= 2 * n else None
        out[w] = (n, len(found), -found[0][0] if form[w] else None)
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        n, n_near, form_n = out[w]
        out[w] = (w, form[w], root, n, n_near, form_n)
    return sorted(out.values())


def test_spelling_groups(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abé", k=rng.randint(4, 8))) for _ in range(60)] + ["Señorita", "ÀÉÎõü", "colour", "color", "colours", "x" * 400]
    rows = []
    for d in range(120):
        ws = rng.choices(base, [2 ** -(i % 7) for i in range(len(base))], k=60)
        rows.append((d, " ".join(w if rng.random() < 0.8 else w[: (i := rng.randrange(len(w)))] + rng.choice(["", "z", "zz"]) + w[i + 1 :] for w in ws)))
    rows += [(None, "Colour colour, colour!"), (7, None), (8, ""), (9, "a b c d 1 2 3 日本語"), rows[0], rows[0]]
    df = spark.createDataFrame(clash(rows), "doc_id long, text string" + CLASH).repartition(3)
    got = S.groups(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_groups(rows)
    assert any(w[1] and w[2] != w[1] for w in want)  # a chain of forms
    assert sorted(map(tuple, got.collect())) == want
    assert S.groups(df.limit(0)).collect() == []


def test_chunks_find_every_edit(spark):
    words = ["abcde", "abcdef", "aaaaa", "aaaaaa"]
    variants = {v for w in words for i in range(len(w) + 1) for c in ["", "a", "q"] for v in (w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]) if len(v) >= 5}
    counted = spark.createDataFrame([(w, 3) for w in variants], "word string, n long")
    got = Counter((r.word, r.other) for r in S.near(counted).collect())
    assert set(got.values()) == {1}

    def one(a, b):
        return a != b and ((len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or any(x[:i] + x[i + 1 :] == y for x, y in ((a, b), (b, a)) if len(x) == len(y) + 1 for i in range(len(x))))

    assert set(got) == {(a, b) for a in variants for b in variants if one(a, b)}


# --- conversation repair


def cheapest(rows):
    """(cost, edits, repaired rows) by trying all edits of a few rows: shortest first, then the least string."""
    rule, best = re.compile("(s?(ua)+)?"), None

    def go(i, cost, edits, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if rule.fullmatch("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, edits) < best[:2]):
                best = (cost, edits, list(out))
        else:
            role, text, gone, cut = rows[i]
            go(i + 1, cost + 4, edits + "D", out)
            if not gone:
                go(i + 1, cost + 3 * cut, edits + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + 3 + 3 * cut, edits + "R", [*out, (r, text)])
        if len(edits) - edits.rstrip("I").__len__() < 2:
            for r in ("user", "assistant"):
                go(i, cost + 3, edits + "I", [*out, (r, "")])

    go(0, 0, "", [])
    return best


def plain_repair(rows):
    turns = sorted((t for t, *_ in rows if t is not None))
    seen, flagged, n = set(), [], Counter()
    for t, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        n[fault] += 1
        seen.add((role, text))
        flagged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, edits, fixed = cheapest(flagged)
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()
    return (turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, sha)


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out[c] += [] if kind == 0 else [(t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def test_conversation_repair(spark):
    rng = random.Random(9)
    texts = ["Yes.", "No?", "cut off", " \t", "", None, "Done!\n", "Über.", "a "]
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 5)):
            rows.append((c if c else None, t * rng.choice([1, 1, 2]) + 10 * t if t or c % 5 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    rows += [(900, t, r, "Fine.") for t, r in enumerate(["system"])] + [(901, None, "user", "Only.")]
    lost = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    want = sorted([(c is not None, c or 0, *plain_repair(r)) for c, r in damaged(rows).items()])
    df = spark.createDataFrame(clash(rows), "conv_id long, turn long, role string, text string" + CLASH).repartition(5)
    got = R.repair(R.damage(df))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted([(r[0] is not None, r[0] or 0, *r[1:]) for r in got.collect()]) == want
    assert [r for r in want if r[1] == lost][0][2:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert R.repair(R.damage(df.limit(0))).collect() == []


def test_repair_of_a_giant_conversation(spark, monkeypatch):
    """Batches and blocks of backpointers that are smaller than a conversation, and large ids of another type."""
    n, big = 4000, 2**53 + 1
    df = spark.range(n).select(F.concat(F.lit("c"), F.lit(str(big))).alias("conv_id"), (F.col("id") + big).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id"), F.lit(".")).alias("text"))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        (r,) = R.repair(df.withColumn("lost", F.lit(False))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    text = "\n".join(f"{'assistant' if i % 2 else 'user'}:{i}." for i in range(n))
    assert r[:] == (f"c{big}", 0, 0, 0, 0, 0, 0, "K" * n, hashlib.sha256(text.encode()).hexdigest())


def test_backpointers_in_blocks(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    b, codes = R._Backpointers(), [random.Random(1).randrange(60000) for _ in range(50)]
    for c in codes:
        b.add(c)
    assert list(b.forwards()) == codes[::-1] and len(b.full) == 7


def test_edits_over_all_short_conversations():
    """The carried costs and edits against trying all edits, for all rows of up to three turns."""
    kinds = [(r, g, c) for r in ("s", "u", "a", "t") for g, c in ((False, False), (False, True), (True, False))]
    steps = R._Costs()
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            conv = R._Conversation(steps)
            for letter, gone, cut in reversed(rows):
                conv.add(letter, gone, False, cut, False, 0)
            cost, edits, _ = cheapest([(r, "", g, c) for r, g, c in rows])
            assert conv.row(())[5:] == (cost, edits)


# --- vector search


def plain_search(rows, k=5, every=50):
    ok = [(i, v, np.array(e, dtype=float)) for i, (v, e) in enumerate(rows) if v is not None and e and all(c is not None and np.isfinite(c) for c in e) and any(e)]
    out = []
    for i, v, x in ok:
        if v % every == 0:
            near = sorted((-(x @ y) / np.sqrt(x @ x) / np.sqrt(y @ y), w) for j, w, y in ok if j != i and len(y) == len(x))[:k]
            out += [(v, n + 1, w, -s) for n, (s, w) in enumerate(near)]
    return out


def awkward():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(5000 + i, rows[100][1]) for i in range(12)]  # copies of a query's vector
    rows += [(6000 + 50 * i, rows[3][1]) for i in range(4)] + [rows[50], (7000, [2 * c for c in rows[3][1]])]
    rows += [(8000, None), (8050, []), (8100, [0.0] * 16), (8150, [float("nan")] * 16), (8200, [None] + [1.0] * 15), (8250, [1.0, 2.0]), (8300, [2.0, 4.5]), (None, [1.0] * 16), (8350, [3.0]), (8400, [1e30] * 16)]
    return rows


def test_vector_search(spark):
    rows = awkward()
    df = spark.createDataFrame(clash(rows), "vec_id long, embedding array<double>" + CLASH).repartition(4)
    want = plain_search(rows)
    for asked, block in ((F.expr("vec_id % 50 = 0"), V.BLOCK), (F.expr("vec_id % 50 = 0"), 64)):
        got = V.nearest(df, asked, block=block, target=1.0)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        got = sorted(map(tuple, got.collect()))
        per = lambda rs: Counter((q, round(s, 9)) for q, _, _, s in rs)
        found = sum((per(got) & per(want)).values()) / len(want)
        assert found >= 0.98 and len(got) == len(want)
        assert {q for q, *_ in got} == {q for q, *_ in want}
        for q in (100, 8300, 8250):  # copies: ties by id; only vectors of the same length
            assert [r[:3] for r in got if r[0] == q] == [r[:3] for r in want if r[0] == q]
    assert V.nearest(df.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize("spread", [0.2, 5.0])
def test_recall_with_defaults(spark, spread):
    """Clusters, and vectors without any structure, where no index can open few cells."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] + spread * rng.standard_normal(32)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(v, np.array(e, np.float32).tolist()) for v, e in rows]
    want = {(q, v) for q, _, v, _ in plain_search(rows, every=200)}
    got = {(r.query_id, r.vec_id) for r in V.nearest(df, F.expr("vec_id % 200 = 0")).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_heap_gives_cells_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    held = rng.integers(0, 3, 63)
    order = [c for c in np.argsort((a[:, None] + b[None]).ravel(), kind="stable").tolist() if held[c]]
    assert V.traverse(a, b, held.tolist(), held.sum()) == order
    part = V.traverse(a, b, held.tolist(), 20)
    assert part == order[: len(part)] and held[part[:-1]].sum() < 20 <= held[part].sum()


# --- resharding onto files that are there


def shard_files(spark, path):
    rows = spark.read.parquet(path).select("doc_id", "text", "new_shard", "new_slot").collect()
    assert sorted(r.doc_id for r in rows) == sorted({r.doc_id for r in rows})
    per = defaultdict(list)
    for r in rows:
        per[r.new_shard].append(r.new_slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    return {r.doc_id: (r.text, r.new_shard) for r in rows}


@pytest.mark.parametrize("before, after", [(8, 4), (4, 8), (8, 8)])
def test_rewrite_over_existing_files(spark, tmp_path, before, after):
    """The files of shards are read, moved by a transfer and read again: every row once, in its new shard."""
    path = str(tmp_path / "shards")
    rows = [(i, f"text {i} " + "x" * (i % 50), i * 7919 % before) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, new_shard int").withColumn("new_slot", F.expr("row_number() over (partition by new_shard order by doc_id) - 1")).write.partitionBy("new_shard").parquet(path)
    docs = spark.read.parquet(path)
    assigned = reshard.assign(docs, after, before, old="new_shard")
    want = {r.doc_id: r.shard for r in assigned.collect()}
    touched = reshard.rewrite(docs, assigned, path)
    got = shard_files(spark, path)
    assert {k: v[0] for k, v in got.items()} == {r[0]: r[1] for r in rows}
    assert {k: v[1] for k, v in got.items() if v[1] in touched} == {k: s for k, s in want.items() if s in touched}
    assert {v[1] for v in got.values()} == set(range(after)) and not [p for p in (tmp_path / "shards").iterdir() if p.name.startswith("_staged") or p.name.startswith("_away")]


@pytest.mark.parametrize("pairs, rows", [(10, 40), (25, 100), (3, 1000)])
def test_equal_texts_stay_together_in_small_tables(spark, tmp_path, pairs, rows):
    texts = [f"pair {i % pairs}" if i < 2 * pairs else f"own {i}" for i in range(rows)]
    at = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(at)
    got = reshard.assign(spark.read.parquet(at)).collect()
    of = {r.doc_id: r.shard for r in got}
    assert all(of[i] == of[i + pairs] for i in range(pairs))
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) - min(size.get(k, 0) for k in range(8)) <= 2 * max(len(t) + 1 for t in texts)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_a_text_that_no_shard_can_hold_is_dealt(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(i, "the same text" if i % 3 == 0 else f"own text {i:04d}") for i in range(1200)], "doc_id long, text string").write.parquet(at)
    got = reshard.assign(spark.read.parquet(at)).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) > 1 and max(size.values()) < 1.1 * min(size.values())
