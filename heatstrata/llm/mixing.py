"""Mixing sources to target weights by weighted fair queueing.

Each source is shuffled by a hash. A document's virtual finish time is the number of its source's
tokens up to and with it, divided by the source's target weight; a second pass over the source
follows the first. All passes are range-sorted by finish time and cut off at the total budget.

Running totals are taken in two steps, so that a source of any size is no single group: totals of
short ranges, their running total, and the running total inside each range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heatstrata.llm.stored import Stored

#: Rows of a range, about.
RANGE_ROWS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """totals (source, source_size) with the target of each source.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all
    sizes. A target stops at ``most`` times its source's size; the excess is shared again by weight
    until none is above. So target = min(most * size, level * weight) for one level, which is found
    by a running total over the sources in the order in which they fill up. There is one row per
    source.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    full = W.orderBy("fill", F.col("source").isNull(), "source")
    everything = W.partitionBy()
    rows = (
        totals.withColumn("weight", weight.cast("double"))
        .withColumn("fill", most * F.col("source_size") / F.col("weight"))
        .withColumn("before", F.sum(most * F.col("source_size")).over(full.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("rest", F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce("before", F.lit(0))) / F.col("rest"))
        .withColumn("open", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)["level"])
    )
    return rows.select(
        "source", "source_size", "weight", F.least(most * F.col("source_size"), F.coalesce(F.col("open") * F.col("weight"), most * F.col("source_size"))).cast("double").alias("target")
    )


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 11,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size counts the words of the whole text (null: none); taken counts the words that the mix takes
    of it: 0, once its size, up to ``most`` times. Reruns agree. Documents without words take
    nothing. A null source is a source of its own. Rows with the same id and text may swap places,
    which changes no total. Only whole documents are taken, so a source ends within one document of
    its target. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    store = Stored(spark)
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORDS)).cast("long")
    sized = store(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"),
                    F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), F.octet_length(F.col(text))).alias("turn"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = store(targets(totals.drop("rows"), weights, share, most).withColumn("key", F.xxhash64("source", F.lit(seed))))
    ranges = totals.select(F.col("source").alias("of"), F.ceil(F.col("rows") / RANGE_ROWS).alias("ranges"))

    same = lambda a, b: a.eqNullSafe(b)
    place = F.col("turn") / F.lit(2.0**64) + 0.5
    dealt = sized.join(ranges, same(F.col("source"), F.col("of"))).withColumn("range", F.floor(place * F.col("ranges"))).drop("of", "ranges")
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "range").orderBy("turn", "doc_id", "row").rowsBetween(W.unboundedPreceding, 0)
    queued = (
        dealt.withColumn("running", F.sum("size").over(inside))
        .join(offsets, same(F.col("source"), F.col("of")) & (F.col("range") == F.col("at")))
        .drop("of", "at")
        .join(goals.select(F.col("source").alias("of"), "source_size", "target"), same(F.col("source"), F.col("of")))
    )
    passes = (
        queued.filter((F.col("size") > 0) & (F.col("target") > 0))
        .select("row", "size", "turn", "target", (F.col("offset") + F.col("running")).alias("done"), "source_size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
        .withColumn("finish", (F.col("done") + F.col("pass") * F.col("source_size")) / F.col("target"))
        .select("row", "size", "finish", "turn")
    )

    # the global order: range-partitioned by finish time, totals of the ranges, running total in each
    n = max(1, math.ceil(sized.count() * most / RANGE_ROWS))
    ranged = store(passes.repartitionByRange(n, "finish", "turn").withColumn("range", F.spark_partition_id()))
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.sum("size").alias("sum")).select("range", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("start"))
    line = W.partitionBy("range").orderBy("finish", "turn", "row").rowsBetween(W.unboundedPreceding, 0)
    budget = goals.agg(F.sum("target")).first()[0] or 0.0
    served = (
        ranged.withColumn("total", F.sum("size").over(line)).join(starts, "range")
        .filter(F.col("start") + F.col("total") <= budget + 1e-6)
        .groupBy("row").agg(F.sum("size").alias("taken"))
    )
    found = sized.join(goals.select(F.col("source").alias("of"), "source_size", "target"), same(F.col("source"), F.col("of"))).join(served, "row", "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
