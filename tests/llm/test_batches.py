"""What Spark hands to Python at a time is bounded in bytes, not in rows, and changes no result."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heatstrata.llm import blocks

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unlimited(spark):
    """The session without a limit, which an earlier query may have set."""
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT) if before is None else spark.conf.set(LIMIT, before)


def sizes(docs):
    def measure(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    return [tuple(r) for r in docs.mapInArrow(measure, "n long, bytes long").collect()]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_each_stage_bounds_its_batches(unlimited, sf_dir, small, name):
    docs, _ = small
    dict(corpus_pipeline.STAGES)[name](unlimited, docs, sf_dir)
    many = unlimited.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("some words "), 400).alias("text"))
    found = sizes(many)
    assert sum(n for n, _ in found) == 3000
    assert max(b for _, b in found) <= blocks.BATCH_BYTES + 10_000  # one batch of 13 MB before


def test_a_longer_row_is_a_batch_of_its_own(unlimited):
    blocks.bound_batches(unlimited)
    long = unlimited.range(0, 4, 1, 1).select("id", F.repeat(F.lit("x"), 6 << 20).alias("text"))
    assert [n for n, _ in sizes(long)] == [1] * 4


def test_a_limit_of_the_session_stays(unlimited):
    unlimited.conf.set(LIMIT, "64k")
    blocks.bound_batches(unlimited)
    assert unlimited.conf.get(LIMIT) == "64k"


def test_blocks_are_gathered_from_small_batches():
    batches = [pa.record_batch([pa.array(range(i, i + n))], names=["x"]) for i, n in ((0, 100), (100, 0), (100, 300), (400, 100), (500, 1))]
    tables = list(blocks.gathered(iter(batches), 3000))
    assert [t.num_rows for t in tables] == [400, 101]
    assert [x for t in tables for x in t["x"].to_pylist()] == list(range(501))
    assert not list(blocks.gathered(iter([])))


def test_smaller_batches_keep_the_same_rows(unlimited, sf_dir, small):
    def rows(limit, name, docs):
        unlimited.conf.set(LIMIT, limit)
        return sorted(map(repr, dict(corpus_pipeline.STAGES)[name](unlimited, docs, sf_dir).collect()))

    docs, _ = small
    for name in ("quality rules", "line dedup"):
        assert rows("8k", name, docs) == rows("64m", name, docs)
