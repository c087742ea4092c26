"""Sums that are kept by batch, so that new years are added without reading old days again.

Pattern sums of the strata are all that the models need, and strata never reach over a year's end. So
each year's patterns are a batch of their own: adding a year writes one small batch, and refitting
reads only stored sums. The same holds for deaths by place and period. A batch that is written again
replaces what it wrote before, so a failed or repeated load does no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatstrata.functions.numbers import row_sum, sum_or_zero
from heatstrata.functions.periods import STUDY_PERIODS, Periods, period_of_year
from heatstrata.operators import crossover
from heatstrata.operators.crossover import Exposure
from heatstrata.operators.mortality import SEX_COLUMNS
from heatstrata.sources.writers import replace_batches


@dataclass(frozen=True)
class BatchedSums:
    """Sums of columns by keys, one stored part per batch."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    sums: tuple[str, ...]
    batch: str = "batch"

    def add(self, rows: DataFrame) -> None:
        """Replace the batches that the rows name; rows have the batch, the keys and the sums.

        One file per batch: its sums are as few as its keys' combinations.
        """
        chosen = rows.select(self.batch, *self.keys, *[f"`{c}`" for c in self.sums])
        replace_batches(chosen.repartition(self.batch), self.path, self.batch)

    def batches(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def merged(self, *more: Column) -> DataFrame:
        """The sums over all batches; ``more`` are keys made from the batch, such as its period."""
        return self.batches().groupBy(*more, *self.keys).agg(*[F.sum(f"`{c}`").alias(c) for c in self.sums])


def _period_of_batch(periods: Periods) -> Column:
    return period_of_year(F.col("batch").cast("int"), periods).alias("year_period")


@dataclass(frozen=True)
class PatternBatches:
    """Pattern sums of matched strata by year, and the models of their periods."""

    spark: SparkSession
    path: str
    exposures: tuple[Exposure, ...]
    periods: Periods = STUDY_PERIODS
    by: tuple[str, ...] = ()
    weight: str = "all_deaths"

    def _sums(self) -> BatchedSums:
        keys = (*self.by, "variable", "type", "xc", "n1", "n0")
        return BatchedSums(self.spark, self.path, keys, (self.weight, f"{self.weight}#2"))

    def add(self, strata: DataFrame, date: str = "date") -> None:
        """Add or replace the years that the strata cover. Each such year must be there as a whole."""
        rows = strata.withColumn("batch", F.year(date))
        self._sums().add(crossover.stratum_patterns(rows, self.exposures, [self.weight], ["batch", *self.by], squares=True))

    def fit(self) -> DataFrame:
        """The models of each period, from stored sums alone, with model-based and robust errors."""
        merged = self._sums().merged(_period_of_batch(self.periods))
        return crossover.fit(merged, ["year_period", *self.by, "variable", "type"], self.weight, robust=True)


@dataclass(frozen=True)
class DeathBatches:
    """Deaths by place and year, summed to periods."""

    spark: SparkSession
    path: str
    periods: Periods = STUDY_PERIODS
    keys: tuple[str, ...] = ("ENT_OCURR", "MUN_OCURR", "municipality")

    def _sums(self) -> BatchedSums:
        return BatchedSums(self.spark, self.path, self.keys, ("deaths_total",))

    def add(self, daily: DataFrame, date: str = "date") -> None:
        """Add or replace the years that the day sums cover; unknown cells count 0, rows without place or date go."""
        known = daily.na.drop(subset=[*self.keys, date])
        total = sum_or_zero(row_sum([F.col(c) for c in SEX_COLUMNS], "cell")).alias("deaths_total")
        self._sums().add(known.groupBy(F.year(date).alias("batch"), *self.keys).agg(total))

    def totals(self) -> DataFrame:
        return self._sums().merged(_period_of_batch(self.periods)).where(F.col("year_period").isNotNull())

