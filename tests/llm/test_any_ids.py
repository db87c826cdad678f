"""Ids that aren't whole numbers: the same results as with numbers of the same order."""

import pytest
from pyspark.sql import functions as F

from boxkit.llm import jaccard_join, license_scan, recompression_dedup, secret_scan, suffix_dedup

TEXT = " ".join(f"w{k}" for k in range(80))
TEXTS = [TEXT, TEXT + " more", "short", None, "", "MIT License " + TEXT[::-1], "x " + TEXT, "password=hunter22", TEXT[::-1]]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """Documents with numbers and with strings, which sort alike; one id is null and one stands twice."""
    rows = [(k if k != 6 else None, t) for k, t in enumerate(TEXTS)] + [(1, TEXT + " again")]
    out = []
    for name, id_of, kind in (("numbers", lambda k: k, "long"), ("strings", lambda k: None if k is None else f"é{k:03}", "string")):
        at = str(tmp_path_factory.mktemp(name) / "documents.parquet")
        spark.createDataFrame([(id_of(k), t) for k, t in rows], f"doc_id {kind}, text string").repartition(3).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


OPERATORS = {
    "secrets": lambda d: secret_scan.scan(d).select("doc_id", F.size("spans").alias("n")),
    "licenses": lambda d: license_scan.scan(d).select("doc_id", "n_words", F.size("base").alias("n")),
    "bytes": lambda d: suffix_dedup.remove_repeated_bytes(d, texts=False).select("doc_id", "n_removed", "kept_sha256"),
    "words": lambda d: recompression_dedup.remove_repeated_windows(d, texts=False).select("doc_id", "n_removed", "kept_sha256"),
    "links": lambda d: jaccard_join.links(d).select("doc_id", "n_shingles", "component_id"),
    "first": lambda d: jaccard_join.keep_first(d).select("doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_of_any_type(both, name):
    numbers, strings = (OPERATORS[name](d) for d in both)
    assert strings.schema["doc_id"].dataType.simpleString() == "string"
    ids = [c for c in numbers.columns if c.endswith("_id")]
    want = sorted(str(tuple(f"é{v:03}" if c in ids and v is not None else v for c, v in r.asDict().items())) for r in numbers.collect())
    assert sorted(str(tuple(r)) for r in strings.collect()) == want
