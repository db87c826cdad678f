"""Search by codes and matrices, and models with hard negatives, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxkit.operators import hashing, search


def codes(rng, n, bits=64, centres=40, flips=4):
    base = rng.integers(0, 2, (centres, bits))
    x = base[rng.integers(0, centres, n)]
    for row in x:
        row[rng.choice(bits, rng.integers(0, flips + 1), replace=False)] ^= 1
    word = lambda r: int("".join(map(str, r[::-1])), 2)
    return [w - (1 << 64) if w >= 1 << 63 else w for w in map(word, x)]


def plain_nearest(have, q, n):
    d = sorted((((c ^ q) & ((1 << 64) - 1)).bit_count(), c) for c in set(have))
    return d[:n]


@pytest.mark.parametrize("flips", [3, 40])
def test_nearest_codes(spark, flips):
    """Codes in clusters, found by lookups of parts, and scattered ones, where the plain comparison takes over."""
    rng = np.random.default_rng(3)
    have = codes(rng, 1500, flips=flips)
    asked = have[:10] + codes(rng, 10)
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(have)], "uid string, code long")
    queries = spark.createDataFrame([(i, c) for i, c in enumerate(asked)], "query_id long, qcode long")
    cut = hashing.parts(64, len(set(have)))
    assert sum(w for _, w in cut) == 64 and [f for f, _ in cut] == [sum(w for _, w in cut[:i]) for i in range(len(cut))]
    counted = []
    got = {}
    for r in hashing.nearest_codes(hashing.sub_codes(df, cut), cut, queries, 15, counted, few_pairs=0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.code))
    for i, q in enumerate(asked):
        assert [(d, c) for _, d, c in sorted(got[i])] == plain_nearest(have, q, 15)
    if flips == 3:
        assert max(counted[:-1] or counted) < 0.3 * len(set(have)) * len(asked)
    outright = hashing.nearest_codes(hashing.sub_codes(df, cut), cut, queries, 15).collect()
    assert sorted(map(str, outright)) == sorted(map(str, hashing.nearest_codes(hashing.sub_codes(df, cut), cut, queries, 15, few_pairs=0).collect()))
    few = hashing.nearest_codes(hashing.sub_codes(df.limit(3), cut), cut, queries, 15)
    assert few.groupBy("query_id").count().select("count").distinct().collect()[0][0] == df.limit(3).select("code").distinct().count()
    assert hashing.nearest_codes(hashing.sub_codes(df.limit(0), cut), cut, queries, 5).collect() == []


def test_stored_index_grows(spark, tmp_path):
    rng = np.random.default_rng(5)
    have = codes(rng, 600)
    df = spark.createDataFrame([(f"u{i}", c) for i, c in enumerate(have)], "uid string, code long")
    path = str(tmp_path / "index")
    hashing.write_index(df.where("uid < 'u3'"), path)
    for _ in range(2):  # again adds nothing
        hashing.add_to_index(df, path)
    queries = spark.createDataFrame([(i, c) for i, c in enumerate(have[:5])], "query_id long, qcode long")
    got = {(r.query_id, r.uid, r.distance) for r in hashing.search_index(spark, path, queries, 4).collect()}
    want = {(i, f"u{k}", d) for i in range(5) for d, c in plain_nearest(have, have[i], 4) for k, h in enumerate(have) if h == c}
    assert got == want
    assert spark.read.parquet(f"{path}/codes").count() == 600
    assert {(r.uid, r.distance) for r in search.hamming_topn(df, queries.limit(1), 4).collect()} == {(u, d) for i, u, d in want if i == 0}


@pytest.mark.parametrize("distance", ["euclidean", "cosine", "intersection", "farthest"])
def test_knn_in_blocks_of_a_matrix(spark, distance):
    rng = np.random.default_rng(8)
    x = np.abs(np.round(rng.standard_normal((300, 6)), 1))  # many ties
    x[7] = 0
    rows = [(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("short", [1.0, 2.0])]
    v = spark.createDataFrame(rows, "uid string, vec array<double>").repartition(5)
    q = v.where("uid < 'v012' AND uid LIKE 'v%'").selectExpr("uid AS query_id", "vec AS qvec")
    exact = search.ranked(v.where("size(vec) = 6").crossJoin(q).select("query_id", "uid", search.DISTANCES[distance](F.col("vec"), F.col("qvec")).alias("distance")), "query_id", 9)
    key = lambda d: sorted((r.query_id, r["rank"], r.uid, r.distance) for r in d.collect())
    assert key(search.knn(v, q, 9, distance)) == key(exact)


def plain_models(rows, most_pos, most_neg, only):
    """Labels one after the other, with loops over all rows."""
    unit = {u: np.array(v) / np.sqrt(np.array(v) @ np.array(v)) for u, _, v, _ in rows}
    label, h = {u: lab for u, lab, _, _ in rows}, {u: k for u, _, _, k in rows}
    out = {}
    for name in sorted(set(label.values()) - {"background"}):
        by_hash = sorted(label, key=lambda u: (h[u], u))
        pos = [u for u in by_hash if label[u] == name][:most_pos]
        seeds, most = max(2, most_neg // most_pos * (2 if only else 1)), most_neg if only else most_neg // 2
        cand = set()
        for p in pos:
            cand |= set(sorted(unit, key=lambda u: (round(float(np.linalg.norm(unit[u] - unit[p])), 12), u))[:seeds])
        cand = sorted(u for u in cand if label[u] != name)
        mean = np.mean([unit[p] for p in sorted(pos)], axis=0)
        hard = sorted(cand, key=lambda u: -(unit[u] @ mean))[:most]
        fit = lambda neg: search._squared_hinge(np.array([[*unit[u], 1.0] for u in sorted(pos) + neg]), np.r_[np.ones(len(pos)), -np.ones(len(neg))])
        if hard:
            w = fit(hard)
            hard = sorted(cand, key=lambda u: -(unit[u] @ w[:-1] + w[-1]))[:most]
        rest = [] if only else [u for u in by_hash if label[u] != name and u not in hard][: most_neg // 2]
        out[name] = fit(hard + rest)
    return out


@pytest.mark.parametrize("only", [False, True])
def test_category_models_with_hard_negatives(spark, only):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((5, 12))
    rows = [(f"u{i}", "background" if i % 6 == 5 else f"c{i % 6}", (centres[i % 5] + 0.8 * rng.standard_normal(12)).tolist()) for i in range(420)]
    v = spark.createDataFrame(rows, "uid string, label string, vec array<double>").repartition(4)
    hashes = {r.uid: r.h for r in v.select("uid", F.xxhash64("uid").cast("double").alias("h")).collect()}
    want = plain_models([(*r, hashes[r[0]]) for r in rows], 15, 60, only)
    got = {r.model: np.r_[r.weights, r.bias] for r in search.category_models(v, most_pos=15, most_neg=60, neighbours_only=only).collect()}
    assert sorted(got) == sorted(want) == [f"c{k}" for k in range(5)]
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-6), k
    some = search.category_models(v, labels=["c1"], most_pos=15, most_neg=60, neighbours_only=only).collect()
    assert [r.model for r in some] == ["c1"] and np.allclose(some[0].weights, got["c1"][:-1], atol=1e-9)


def test_top_rows(spark):
    rows = [(f"k{i % 3}", f"u{i:04d}", float(i * 7919 % 101)) for i in range(2000)]
    got = sorted(map(tuple, search.top_rows(spark.createDataFrame(rows, "key string, uid string, s double").repartition(7), "key", 20, "s").collect()))
    assert got == sorted(r for k in ("k0", "k1", "k2") for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:20])
