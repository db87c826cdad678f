"""More queries than one broadcast takes give the rows that they give at once."""

from pyspark.sql import functions as F

from boxkit.operators import search


def test_knn_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(str(i), [float(i % 17), float(i % 23)]) for i in range(60)], "uid string, vec array<double>")
    queries = vectors.where("CAST(uid AS LONG) % 3 = 0").selectExpr("uid AS query_id", "vec AS qvec")
    rows = lambda: sorted(tuple(r) for r in search.knn(vectors, queries, 3).collect())
    whole = rows()
    monkeypatch.setattr(search, "MOST_QUERIES", 8)
    assert len(whole) == 60 and rows() == whole


def test_no_part_of_short_codes_is_empty(spark, monkeypatch):
    """Codes of 16 bits are cut as such: a part that is 0 in all codes would meet every code at every look."""
    from boxkit.operators import hashing, search

    cuts, real = [], hashing.sub_codes
    monkeypatch.setattr(search.hashing, "sub_codes", lambda codes, cut: cuts.append(cut) or real(codes, cut))
    codes = spark.range(3000).selectExpr("CAST(id AS STRING) AS uid", "(id * 7919) % 65536 AS code")
    queries = codes.where("CAST(uid AS LONG) % 500 = 0").selectExpr("uid AS query_id", "code AS qcode")
    got = search.hamming_topn(codes, queries, 5).collect()
    assert sum(w for _, w in cuts[0]) == 16
    long = search.hamming_topn(codes, queries, 5, 64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, long)) and len(got) == 30
    assert [search._width(x) for x in (0, 1, 5, -1)] == [1, 1, 3, 64]


def test_similarity_to_many_positives_makes_no_pairs(spark):
    """Sums of intersections by component are those of all pairs; null vectors and ones of other lengths count as before."""
    v = spark.range(60).selectExpr("CAST(id AS STRING) AS uid", "transform(sequence(0, 7), j -> ((id * 31 + j * 17) % 23) / 23D) AS vec")
    odd = v.unionByName(spark.sql("SELECT 'null' AS uid, CAST(NULL AS ARRAY<DOUBLE>) AS vec UNION ALL SELECT 'short', array(0.5D, CAST(NULL AS DOUBLE))"))
    d = search.DISTANCES["intersection"](F.col("vec"), F.col("qvec"))
    for chosen in (["0", "10", "20", "30"], ["0", "10", "short", "null"]):
        p = odd.where(F.col("uid").isin(chosen))
        want = {r.uid: 1.0 if r.uid in chosen else r.s for r in odd.join(p.selectExpr("vec AS qvec")).groupBy("uid").agg((F.sum(1 - d) / F.count("*")).alias("s")).collect()}
        got = {r.uid: r.score for r in search.rank_by_similarity(odd, p).collect()}
        assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in got)
    s = search._intersection_sums(v, v.where("uid < '2'").selectExpr("vec AS qvec"))
    assert "Join" not in s._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_many_queries_keep_are_held_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"uid": ["a", "b"], "vec": [[1.0], [2.0]]})
    part = (np.array([0, 0, 1, 1]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]), rows)
    of, d, at, kept = search._merged([part, (np.array([0]), np.array([0.05]), np.array([1]), rows)], 2, np.full(2, np.inf))
    got = sorted((int(q), float(x), kept.column("uid")[int(i)].as_py()) for q, x, i in zip(of, d, at))
    assert got == [(0, 0.05, "b"), (0, 0.1, "a"), (1, 0.3, "a"), (1, 0.4, "b")] and kept.num_rows == 3
    # long lists are asked for in smaller blocks, with the same answer
    v = spark.range(60).selectExpr("CAST(id AS STRING) AS uid", "transform(sequence(1, 4), i -> pmod(xxhash64(id, i), 100) / 100D) AS vec")
    q = v.selectExpr("uid AS query_id", "vec AS qvec").where("query_id % 3 = 0")
    one = sorted(search.knn(v, q, 5, "farthest").collect())
    monkeypatch.setattr(search, "KEPT", 40)
    assert sorted(search.knn(v, q, 5, "farthest").collect()) == one and len(one) == 100
