"""A corpus pipeline of five stages; each stage is stored, and the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatstrata.llm.decontaminate import without_leaks
from heatstrata.llm.line_dedup import without_repeated_lines
from heatstrata.llm.mixing import mix_sources
from heatstrata.llm.ngram_join import similar_documents
from heatstrata.llm.perplexity_rules import quality
from heatstrata.llm.rows import ROW, with_row_ids
from heatstrata.llm.stored import Stored
from heatstrata.sources.work_folder import work_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Judged row by row: of several rows with one doc_id, or without one, each goes or stays for its own text.
    """
    rows = with_row_ids(docs)
    rejected = quality(rows, doc_id=ROW).filter(~F.col("kept")).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(rejected, ROW, "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs, single lines included; n_chars follows the text.

    A document all of whose lines are later copies has no text left and goes; one that had no words
    stays as it is.
    """
    kept = without_repeated_lines(docs, min_words=1).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents: the one with the smallest id, a null id being the largest.

    A group is made of rows: rows with one doc_id but unlike texts are in groups of their own, and of rows
    that are equal one stays. Rows without words are similar to none; of equal ones among them one stays, too.
    """
    rows = with_row_ids(docs)
    ids = rows.groupBy(ROW).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    groups = similar_documents(rows, doc_id=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("of")).distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    kept = groups.join(ids, ROW).groupBy("of").agg(F.min_by(F.struct(ROW, "copies"), order).alias("first"))
    kept = Stored(spark)(kept.select("first.*"))
    alone = rows.join(kept.where("copies = 1").select(ROW), ROW, "left_semi")
    equal = rows.join(kept.where("copies > 1").select(ROW), ROW, "left_semi").dropDuplicates([ROW])
    return alone.unionByName(equal).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item, judged row by row, with or without a doc_id."""
    rows = with_row_ids(docs)
    return without_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=ROW).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]

#: The quality model and the component search have no equivalent in one SQL text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
