import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
)


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) or (id, text, lang, source) rows."""

    def make(*rows):
        return spark.createDataFrame([(*r, "en", "a")[:4] if len(r) == 2 else r for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    """Documents and labels of the smallest tables, as lists too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, {r.doc_id: r for r in docs.collect()}
