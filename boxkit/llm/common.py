"""Helpers shared by the training-data operators.

Texts are handled a chunk of whole documents at a time, as one byte array with
document offsets, so that tokenising and hashing are a few numpy passes and a
task needs memory for one chunk only (a single longer document is its own
chunk; texts are never cut).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shared import shared_dir

CHUNK = 1 << 18
_BLANK = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_LETTER = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the multiplier or its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, CHUNK * 2), _MULT if kind == "up" else _INV, dtype=np.uint64)
        base[0] = 1
        have = _powers[kind] = np.cumprod(base, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Sums with which span_hash() hashes any run of units in constant time."""
    out = np.empty(len(units) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(units * _power("up", len(units)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of units[lo:hi]; equal runs get equal hashes wherever they stand."""
    return mix((sums[hi] - sums[lo]) * _power("down", len(sums))[lo])


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, last row + 1, bytes, offsets) over whole rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of marked bytes within each document."""
    full = offsets[1:] > offsets[:-1]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    before[offsets[:-1][full]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    after[offsets[1:][full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(buf: np.ndarray, offsets: np.ndarray, blank: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and the first word of each document (one more at the end).

    blank: words are runs without ASCII blanks; else of lower-case ASCII
    letters, digits and non-ASCII characters (lower-case the bytes first).
    """
    starts, ends = runs(~_BLANK[buf] if blank else _LETTER[buf], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def lower(buf: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case; the length stays."""
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(BYTE_CODES[buf]), starts, ends)


def with_row_id(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and a unique _rid, so that null or repeated ids can't mix rows up.

    The ids are those of the scan's partitions: read documents from files, or
    checkpoint() them before, so that a recomputed task gives the same ones.
    """
    return docs.select(*columns, F.monotonically_increasing_id().alias("_rid"))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows with whole numbers for doc_id, in the order of the ids, and the table that named() gives them back with.

    Ids that are whole numbers stay and need no table; others, of any type that can be sorted, are numbered once.
    """
    if isinstance(rows.schema["doc_id"].dataType, IntegralType):
        return rows.withColumn("doc_id", F.col("doc_id").cast("long")), None
    ids = rows.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct().orderBy("_id")
    # numbers of sorted rows rise from one partition to the next
    ids = saved(ids.select("_id", F.monotonically_increasing_id().alias("_number")), "id-numbers")
    others = [c for c in rows.columns if c != "doc_id"]
    return rows.join(ids, F.col("doc_id") == F.col("_id"), "left").select(F.col("_number").alias("doc_id"), *others), ids


def named(out: DataFrame, ids: DataFrame | None, *columns: str) -> DataFrame:
    """out with the ids for the numbers in these columns."""
    for c in columns if ids is not None else ():
        of = ids.select(F.col("_number").alias(f"_number_{c}"), F.col("_id").alias(f"_id_{c}"))
        out = out.join(of, F.col(c) == F.col(f"_number_{c}"), "left").withColumn(c, F.col(f"_id_{c}")).drop(f"_number_{c}", f"_id_{c}")
    return out


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path, None
    return out


def saved_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like saved(), in buckets of a key: later joins on it move only the other side."""
    spark = df.sparkSession
    table = f"boxkit_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{table}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.saved_at = path, table
    return out


def drop(*tables: DataFrame) -> None:
    """Removes what saved() or saved_by() wrote, once nothing reads it any more."""
    for df in tables:
        spark, (path, table) = df.sparkSession, df.saved_at
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def squeezed(rows: DataFrame) -> DataFrame:
    """rows with text as zstd, for an exchange of whole texts; unsqueezed() gives them back in a task."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            at = b.schema.get_field_index("text")
            z = [None if t is None else pack.compress(t.encode()) for t in b.column(at).to_pylist()]
            yield b.set_column(at, "text", pa.array(z, pa.binary()))

    schema = ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema)


def unsqueezed(column: pa.Array) -> pa.Array:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return pa.array([None if z is None else unpack.decompress(z) for z in column.to_pylist()], pa.large_binary())


def n_buckets(spark: SparkSession) -> int:
    """Buckets of an exchange of packed rows: two for each shuffle partition, as hashing deals them unevenly."""
    return 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
