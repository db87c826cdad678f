"""The pipeline against its stages' decisions, on a copy of the smallest tables."""

import __spark_entry__
import corpus_pipeline
from boxkit.llm import decontaminate, jaccard_join, toxicity
from boxkit.llm import common as C


def test_pipeline(spark, sf):
    docs = C.read(spark, sf, "documents")
    n = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = C.saved(stage(spark, docs, sf), name.replace(" ", "-"))
        n[name] = docs.count()
        if name != "sharding":
            assert docs.columns == C.read(spark, sf, "documents").columns
        if name == "toxicity":
            model = toxicity.learn(before, C.read(spark, sf, "labels"))
            assert n[name] == toxicity.score(before, model).where("score < 0.5").count()
        if name == "jaccard join":
            assert n[name] == jaccard_join.links(before).select("component_id").distinct().count()
        if name == "decontamination":
            assert n[name] == before.count() - decontaminate.judge(before, C.read(spark, sf, "benchmark")).where("contaminated").count()
    assert 0 < n["decontamination"] <= n["jaccard join"] <= n["toxicity"] <= 200
    assert n["sharding"] == n["mixing"]
    assert sorted(docs.columns)[:2] == ["doc_id", "grown_shard"]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{k}_") for q in names) for k in range(1, 11))


NAMES = "doc_id long, text string, lang string, source string, n_chars long, _rid long, size long, score double, shard int, root long, part int, taken long"


def run(spark, tmp_path, name, rows, labels=(), items=()):
    at = str(tmp_path / name)
    spark.createDataFrame(rows, NAMES).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return corpus_pipeline.run(spark, at).collect()


def row(i, text, source="a"):
    return (i, text, "en", source, 1, 7, 7, 7.0, 7, 7, 7, 7)


def test_awkward_tables(spark, tmp_path):
    assert run(spark, tmp_path, "none", []) == []
    assert run(spark, tmp_path, "blank", [row(1, None), row(2, ""), row(None, "  "), row(1, None)]) == []  # no words, nothing to mix
    clean = " ".join(f"word{i}" for i in range(40))
    item = " ".join(f"test{i}" for i in range(20))
    rows = [row(1, clean), row(2, clean + " more"), row(2, clean + " more"), row(None, clean.replace("word", "other"), None), row(4, item, "b"), row(5, None, "b"), row(6, "short one", "c")]
    got = run(spark, tmp_path, "some", rows, [(1, 1, 0), (None, 1, 1)], [(1, item), (2, None)])
    # one of the near copies stays, the contaminated one goes, and each of the others is in the mix
    assert {r.doc_id for r in got} == {1, None, 6}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
