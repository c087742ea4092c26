"""Numbers that tell the rows of a document table apart, whatever their doc_ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "__row"


def with_row_ids(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang")) -> DataFrame:
    """docs with a long ``__row``: equal for rows that agree in all the columns, unequal for all others.

    It is the doc_id where that tells all rows apart, which keeps their order. Where some doc_id is null, or
    stands for several texts, it is a hash of the columns, the same whenever it is computed again. That no two
    unequal rows share a number is looked at once, by a digest; if some do, the next seed is taken.
    """
    present = [F.col(c).cast("string") for c in columns if c in docs.columns]
    # A null is told from any text by its own flag.
    parts = [part for c in present for part in (c.isNull(), c)]
    whole = F.concat_ws("\0", *[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in present])
    number, seed = F.col("doc_id").cast("long"), 0
    while True:
        digests = docs.select(number.alias("n"), F.unhex(F.sha2(whole, 256)).alias("d")).groupBy("n").agg(F.min("d").alias("low"), F.max("d").alias("high"))
        if not digests.where("n IS NULL OR low <> high").limit(1).count():
            return docs.withColumn(ROW, number)
        number, seed = F.xxhash64(F.lit(seed), *parts), seed + 1
