"""Tables that cut a plan: written below the shared work folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatstrata.sources.work_folder import work_folder


class Stored:
    """Stores tables in one new work folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, work_folder(spark), 0

    def __call__(self, frame: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)
