"""Helpers that several corpus operators share."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes of one Arrow batch. Texts are long, so the row bound is far below Spark's own.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20

WORD_SPACE = b" \t\n\r\x0b\x0c"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Document id and whole text, null read as empty; every other column stays behind, whatever its name."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def row_key() -> list[Column]:
    """What tells rows apart: the id and a hash of the text as it is; either may be the same or missing in other rows."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def same_row(docs: DataFrame, keys: DataFrame) -> Column:
    """Join condition of ``docs`` with rows of ``row_key``."""
    return docs["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs["text"]) == keys["text_hash"])


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == remainder, F.lit(False))


def is_held_out(doc_id: int | None, mod: int, remainder: int) -> bool:
    return doc_id is not None and zlib.crc32(b"%d" % doc_id) % mod == remainder


def raw_texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8, null as empty."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow fields of a flat schema such as ``doc_id long, text string``; needs no session, so tasks can use it."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def arrow_table(ddl: str, columns: dict) -> pa.Table:
    schema = arrow_schema(ddl)
    arrays = [x if isinstance(x := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type) for f in schema]
    return pa.Table.from_arrays(arrays, schema=schema)


def map_batches(df: DataFrame, fn, ddl: str, end: Callable[[], None] | None = None) -> DataFrame:
    """``fn(batch) -> dict of columns`` over every Arrow batch; a narrow step without a shuffle.

    Workers outlive their tasks: ``end`` is called behind a task's last batch, to let go of what only this step needs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from arrow_table(ddl, fn(batch)).to_batches()
        finally:
            if end:
                end()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, ddl)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and text bytes, counted over the whole table: two numbers, reduced on the executors."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def planes(values: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane: in a sorted array the high planes are runs, which shuffle compression removes."""
    size = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def seeded(label: str, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers derived from a label."""
    digest = b"".join(hashlib.blake2b(f"{label}/{i}".encode(), digest_size=8).digest() for i in range(n))
    return np.frombuffer(digest, dtype="<u8").astype(np.uint64) | np.uint64(1)


def stir(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))
