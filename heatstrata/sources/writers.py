"""Sinks. Each is one write; Spark commits it as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, the form for tables that other jobs read."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)


def write_by_period(df: DataFrame, path: str, period: str = "year_period", sort: Sequence[str] = (), files: int | None = None) -> None:
    """One folder per period; readers that want one period open only its folder.

    With ``sort`` the rows are dealt by ranges of (period, sort) first. A period then has few files,
    not one per task, and each file holds its own range of the sorted columns, so a reader that wants
    some of their values skips files and row groups by their statistics. There are ``files`` ranges in
    all, by default as many as shuffle partitions, which adaptive execution joins where they are small;
    a period that is large gets more of them than others. A null period has a folder of its own.
    """
    if sort:
        keys = [period, *sort]
        dealt = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
        df = dealt.sortWithinPartitions(*keys)
    df.write.mode("overwrite").partitionBy(period).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Add files to a CSV folder; every file carries its own header. Run twice, it adds twice: see ``replace_batches``."""
    write_csv(df, path, mode="append")


def replace_batches(df: DataFrame, path: str, batch: str = "batch", kind: str = "parquet") -> None:
    """Add the batches that the rows name, or replace them where they are there already; others stay.

    The rows are staged and moved when all tasks are done, and only the folders of their batches are
    exchanged. So a load that is repeated, or was stopped half-way and starts again, is there once. A
    batch that has become empty must be removed by its folder: no row names it.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch)
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)


def count_written(df: DataFrame, path: str) -> int:
    """Rows found when a table is read back."""
    return df.sparkSession.read.parquet(path).count()


def counts_by_batch(df: DataFrame, batch: str = "batch") -> DataFrame:
    """Rows of each batch, to compare what was sent with what is read back."""
    return df.groupBy(batch).agg(F.count("*").alias("n_rows"))


def unequal_batches(sent: DataFrame, stored: DataFrame, batch: str = "batch") -> DataFrame:
    """Batches whose number of rows differs between two tables; empty when a load is whole."""
    left, right = counts_by_batch(sent, batch), counts_by_batch(stored, batch).withColumnRenamed("n_rows", "n_stored")
    both = left.join(right, batch, "full")
    return both.where("NOT (n_rows <=> n_stored)")
