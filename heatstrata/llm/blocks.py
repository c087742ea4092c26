"""Documents dealt into blocks of bounded bytes, and packed number lists that blocks send each other.

A block is all documents of one hash value of the id. It sends, for each part of a key range, one
packed list of its distinct keys; so a part gets each key once per block, however often it occurs,
and no frequent key gathers in one task. Answers go back to the block that asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block, about.
BLOCK_BYTES = 16 << 20
#: Bytes of a batch that Spark hands to Python, about (a larger row is a batch of its own).
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's batches hold BATCH_BYTES at most, unless it has a limit of its own.

    Spark's default limit is 10,000 rows, however long: a task then holds its whole split several times
    over, in Arrow vectors outside the heap and in its Python worker, and neither gives all of it back.
    """
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def gathered(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``most`` bytes or a batch more, as far as there are rows."""
    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def pack(numbers: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(numbers).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(packed: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", dtype)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences of the least width."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    top = int(steps.max()) if len(steps) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + pack(steps.astype(f"u{width}"))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed[1:], f"u{packed[0]}").astype(np.uint64), dtype=np.uint64)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """First place of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1. Most keys that are absent are told apart by a bit map first."""
    place = np.full(len(keys), -1, np.int64)
    if not len(table) or not len(keys):
        return place
    bits = max(10, min(24, int(len(table)).bit_length() + 4))
    shift = np.uint64(64 - bits)
    scatter = np.uint64(0x9E3779B97F4A7C15)
    seen = np.zeros(1 << bits, bool)
    seen[(table * scatter) >> shift] = True
    maybe = np.flatnonzero(seen[(keys * scatter) >> shift])
    order = maybe[np.argsort(keys[maybe])]
    at = np.searchsorted(table, keys[order])
    at[at == len(table)] = 0
    found = table[at] == keys[order]
    place[order[found]] = at[found]
    return place


def count_blocks(docs: DataFrame, text: str, least: int = 0) -> int:
    """Blocks of about BLOCK_BYTES; not fewer than the shuffle partitions of the session, unless they would have under ``least`` bytes."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(total / BLOCK_BYTES), min(tasks, math.ceil(total / least)) if least else tasks)


def in_blocks(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(block, doc_id, text), dealt by block. Used more than once in a plan, Spark shuffles it once."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.octet_length(F.col(text))), F.lit(n)).cast("int").alias("block"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    ).repartition(n, "block")


def per_block(frame: DataFrame, docs: DataFrame, fn, schema: str) -> DataFrame:
    """fn(block, what was answered, documents) for each block that has documents."""

    def call(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(key[0].as_py(), left, right)

    return frame.groupBy("block").cogroup(docs.groupBy("block")).applyInArrow(call, schema)


def per_part(frame: DataFrame, fn, schema: str) -> DataFrame:
    """fn(what the blocks sent) for each part."""

    def call(sent: pa.Table) -> pa.Table:
        return fn(sent)

    return frame.groupBy("part").applyInArrow(call, schema)
