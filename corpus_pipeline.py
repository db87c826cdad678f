"""A training-data pipeline of the numbered operators.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

Defined cases: an empty table, and one without any words, give an empty result;
documents without words are clean, link with nothing and aren't contaminated, but
the mix takes no words of them, so they end there; rows are told apart by their
place, so null and repeated ids are safe; of equal and near-equal rows the first
stays; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxkit.llm import common as C
from boxkit.llm import decontaminate, jaccard_join, mixing, reshard, toxicity as tox


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more; the model learns from the labels of the rest of the folds."""
    return tox.keep_clean(docs, tox.learn(docs, C.read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of the n-gram Jaccard join."""
    return jaccard_join.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark."""
    return decontaminate.decontaminate(docs, C.read(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, once for each pass over them."""
    return mixing.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    return reshard.digest(reshard.assign(docs))


STAGES = [
    ("toxicity", toxicity),
    ("jaccard join", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("mixing", mixing_weights),
    ("sharding", sharding),
]
#: The learned model of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
