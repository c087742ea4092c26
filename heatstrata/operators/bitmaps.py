"""Bitmaps over numbers: exact distinct counts and key filters, both kept as mergeable sums.

A number is a bit of a bucket of 32,768 bits (4 KB). Rows are combined to one bitmap per bucket before
any shuffle, so what is sent is as large as the numbers' range, not as the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 15


def _bucket(number: Column) -> Column:
    return F.floor(number / F.lit(BITS)).cast("long")


def distinct_bitmaps(table: DataFrame, codes: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, name, bucket, bits): which numbers each code takes. ``codes`` are whole numbers, one per distinct value.

    All codes are counted in one pass with one partial aggregation. Null is no value. Numbers up to 2**52
    in size are exact; they should lie close together, since every bucket that is touched is a row.
    """
    named = [F.struct(F.lit(n).alias("name"), c.cast("long").alias("number")) for n, c in codes.items()]
    rows = table.select(*by, F.inline(F.array(*named))).where("number IS NOT NULL")
    placed = rows.select(*by, "name", _bucket(F.col("number")).alias("bucket"), F.pmod("number", F.lit(BITS)).alias("bit"))
    return placed.groupBy(*by, "name", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def add_bitmaps(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bitmaps of several parts (periods, batches) as one; ``by`` keeps groups apart."""
    return bitmaps.groupBy(*by, "name", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, name, n): the exact number of distinct values, over all parts of the bitmaps. A code without values has no row."""
    merged = add_bitmaps(bitmaps, by)
    return merged.groupBy(*by, "name").agg(F.sum(F.bitmap_count("bits")).cast("long").alias("n"))


# A key is hashed to HASHES bits of a filter of fixed size.
HASHES = 3


def _places(columns: Sequence[Column], buckets: int) -> list[tuple[Column, Column]]:
    """Bucket and bit of a key for each hash."""
    places = []
    for seed in range(HASHES):
        place = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(buckets * BITS))
        places.append(((place / BITS).cast("int"), (place % BITS).cast("int")))
    return places


def key_filter(table: DataFrame, keys: Sequence[str], buckets: int = 256) -> DataFrame:
    """(bucket, bits) of the keys of a table, a Bloom filter of at most ``buckets`` rows of 4 KB.

    Filters of several tables with the same ``buckets`` are merged by ``merge_filters``. With n distinct
    keys about (3 n / (32768 buckets))**3 of the other keys pass by chance; 256 buckets (1 MB) suit half a million.
    """
    entries = [F.struct(b.alias("bucket"), p.cast("long").alias("bit")) for b, p in _places([F.col(k) for k in keys], buckets)]
    known = table.na.drop(subset=list(keys)).select(F.inline(F.array(*entries)))
    return known.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge_filters(filters: DataFrame) -> DataFrame:
    return filters.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def may_have_key(table: DataFrame, filter_: DataFrame, keys: Sequence[str], buckets: int = 256) -> DataFrame:
    """Rows whose key is in the filter, and a few others by chance; rows with a null in the key go.

    The filter has at most ``buckets`` rows of 4 KB, whatever the tables' sizes, so it is broadcast and no row
    of the table is shuffled.
    """
    tested = table.na.drop(subset=list(keys))
    for bucket, bit in _places([F.col(k) for k in keys], buckets):
        named = F.broadcast(filter_.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
        tested = tested.withColumns({"_at": bucket, "_bit": bit}).join(named, F.col("_at") == F.col("_bucket"))
        byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        on = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("_bit") % 8)) != 0
        tested = tested.where(on).drop("_at", "_bit", "_bucket", "_bits")
    return tested
