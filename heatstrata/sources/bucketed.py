"""Tables stored in buckets of a key, so that joins and windows by the key need no shuffle.

A bucketed table is an external table of the session's catalog over a path. Its buckets are noted next
to the path, so that another session can open it again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_NOTE = "key string, buckets int, sort array<string>, partition_by array<string>, schema string"


def _table_name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"


def default_buckets(spark: SparkSession) -> int:
    """As many as the session shuffles into, which is set to fit the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, sort: Sequence[str] = (), partition_by: Sequence[str] = ()) -> DataFrame:
    """Store a table in buckets of ``key`` and open it.

    Rows are dealt as the buckets are, so each bucket is one file (per value of ``partition_by``). A
    plan that is already dealt by ``repartition(buckets, key)`` is not shuffled again.
    """
    spark, name = df.sparkSession, _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, key).write.format("parquet").mode("overwrite").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.bucketBy(buckets, key).sortBy(key, *sort).saveAsTable(name)
    note = [(key, buckets, list(sort), list(partition_by), df.select(*[c for c in df.columns if c not in partition_by], *partition_by).schema.json())]
    spark.createDataFrame(note, _NOTE).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.buckets")
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_bucketed``, with its buckets, in this session or a later one."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        noted = spark.read.schema(_NOTE).json(f"{path.rstrip('/')}.buckets").first()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(noted.schema)).fields)
        parts = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in noted.partition_by)})" if noted.partition_by else ""
        order = ", ".join(f"`{c}`" for c in (noted.key, *noted.sort))
        buckets = f"CLUSTERED BY (`{noted.key}`) SORTED BY ({order}) INTO {noted.buckets} BUCKETS"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} {buckets} LOCATION '{path}'")
        if noted.partition_by:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


@contextmanager
def joined_by_bucket(spark: SparkSession) -> Iterator[None]:
    """While this holds, tables in buckets of one join key are joined as they lie, also where the join has more keys."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
