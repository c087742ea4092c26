"""Report tables: descriptive counts, shares, pivots and labelled odds ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatstrata.functions.indicators import any_column_equals
from heatstrata.functions.labels import (
    FAMILY_LABELS, REPORT_SECTIONS, SUBGROUP_LABELS, display_order, relabel,
)
from heatstrata.functions.numbers import mean_sd_text, number_or_null
from heatstrata.functions.periods import STUDY_PERIODS, Periods, period_labels
from heatstrata.operators.columns import reorder
from heatstrata.operators.crossover import SAME_DAY
from heatstrata.operators.exposure import EVENTS_BY_LENGTH

TOTAL_SECTION = "TOTAL"


def heat_descriptives(
    indicators: DataFrame, definitions: Mapping[str, tuple[str, str]] = EVENTS_BY_LENGTH
) -> DataFrame:
    """Mean and sample SD of the temperatures on hot days, every definition in one aggregate."""
    sides = (("max", "tmax_max"), ("min", "tmin_max"))
    measures = []
    for i, pair in enumerate(definitions.values()):
        for flag, (side, temperature) in zip(pair, sides):
            hot = F.when(F.col(flag) == 1, F.col(temperature))
            measures += [F.avg(hot).alias(f"{side}_mean_{i}"), F.stddev_samp(hot).alias(f"{side}_sd_{i}")]
    names = ("max_mean", "max_sd", "min_mean", "min_sd")
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("HW_definition"), *[F.col(f"{n}_{i}").alias(n) for n in names])
            for i, label in enumerate(definitions)
        ]
    )
    return (
        indicators.agg(*measures)
        .select(F.inline(rows))
        .withColumns(
            {
                "max_text": mean_sd_text(F.col("max_mean"), F.col("max_sd")),
                "min_text": mean_sd_text(F.col("min_mean"), F.col("min_sd")),
            }
        )
    )


def descriptive_table(
    long: DataFrame, periods: Periods, sections: Mapping[str, str] = REPORT_SECTIONS
) -> DataFrame:
    """Deaths by section, subgroup and period, with a Total column and a TOTAL row.

    ``long`` has subgroup_type, subgroup, year_period, deaths. The TOTAL row adds the Sex section.
    """
    labels = period_labels(periods)
    section_of = F.create_map(*[F.lit(x) for name, family in sections.items() for x in (family, name)])
    counted = (
        long.withColumn("section", section_of[F.col("subgroup_type")])
        .where(F.col("section").isNotNull() & F.col("year_period").isin(labels))
        .groupBy("section", F.col("subgroup").alias("Subgroup"))
        .pivot("year_period", labels)
        .agg(F.sum("deaths"))
    )
    filled = counted.select(
        "section", "Subgroup", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(p) for p in labels]
    )
    summed = filled.withColumn("Total", _added([F.col(f"`{p}`") for p in labels]))
    return with_total_row(summed, labels + ["Total"])


def _added(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def with_total_row(table: DataFrame, columns: Sequence[str], section: str = "Sex") -> DataFrame:
    """Add the column sums of one section, as a section of its own.

    Rows of that section count twice, once under their own name and once under TOTAL, so the
    table is computed once.
    """
    own = "struct(section, Subgroup)"
    total = f"struct('{TOTAL_SECTION}' AS section, '{TOTAL_SECTION}' AS Subgroup)"
    names = F.expr(f"inline(if(section = '{section}', array({own}, {total}), array({own})))")
    return (
        table.select(*[f"`{c}`" for c in columns], names)
        .groupBy("section", "Subgroup")
        .agg(*[F.sum(f"`{c}`").alias(c) for c in columns])
    )


def combine_sections(tables: Mapping[str, DataFrame], order: Sequence[str] = tuple(REPORT_SECTIONS)) -> DataFrame:
    """Section tables to one table: first column is the subgroup, the rest are numbers.

    Sections that are absent are skipped; a column that some section lacks is null there.
    """
    combined: DataFrame | None = None
    for name in order:
        if name not in tables:
            continue
        table = tables[name]
        label, *values = table.columns
        part = table.select(
            F.lit(name).alias("section"),
            F.col(f"`{label}`").cast("string").alias("Subgroup"),
            *[number_or_null(F.col(f"`{v}`")).alias(v) for v in values],
        )
        combined = part if combined is None else combined.unionByName(part, allowMissingColumns=True)
    if combined is None:
        raise ValueError("none of the wanted sections is present")
    return combined


def in_report_order(table: DataFrame, periods: Periods = STUDY_PERIODS) -> DataFrame:
    """Sections and columns in display order; for the sink."""
    front = ["section", "Subgroup", *period_labels(periods), "Total"]
    wanted = [TOTAL_SECTION, *REPORT_SECTIONS]
    return reorder(table, front).orderBy(display_order(F.col("section"), wanted), "section", "Subgroup")


#: Rows of a segment of ``carry_forward`` where the table has no blocks of its own.
SEGMENT_ROWS = 1 << 16


def carry_forward(
    table: DataFrame, value: Column, name: str, position: str = "_row", file: str | None = "_file", block: str | None = "_block"
) -> DataFrame:
    """Add the last known ``value`` at or before each row of its file, in the order of (block, position).

    A scan in two levels. Inside a block, a window; across blocks, the last value of each block, carried
    over the few rows of that small table. So the largest piece in one task is a block of a file (or
    SEGMENT_ROWS of a table that has only a whole-number position and no ``block``), or one row per block.
    """
    keys = [file] if file else []
    rows = table.withColumn("_value", value)
    if block is None:
        block = "_segment"
        rows = rows.withColumn(block, F.expr(f"`{position}` div {SEGMENT_ROWS}"))
    here = Window.partitionBy(*keys, block).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(here))
    last = rows.where("_value IS NOT NULL").groupBy(*keys, block).agg(F.max_by("_value", position).alias("_last"))
    ends = rows.select(*keys, block).distinct().join(last, [*keys, block], "left")
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, block, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    joined = own.join(carried, [*keys, block], "left").withColumn(name, F.coalesce("_own", "_carried"))
    return joined.drop("_value", "_own", "_carried", "_segment")


def label_forward(
    table: DataFrame, position: str, label: str = "Subgroup", mark: str = "—", file: str | None = None, block: str | None = None
) -> DataFrame:
    """A table with divider rows (``— SEX —``) to one with a ``section`` column and no dividers.

    The section of a row is the last divider before it in its file; an empty label reads "Unspecified".
    """
    text = F.trim(F.col(label))
    divider = F.coalesce(text.startswith(mark), F.lit(False))
    name = F.when(divider, F.trim(F.regexp_replace(text, mark, "")))
    labelled = carry_forward(table.withColumn("_divider", divider), name, "section", position, file, block)
    return labelled.where(~F.col("_divider")).drop("_divider").withColumn(label, F.coalesce(F.col(label), F.lit("Unspecified")))


def section_totals(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    return table.groupBy("section").agg(*[F.sum(f"`{c}`").alias(c) for c in columns])


def section_composition(long: DataFrame, value: str = "deaths") -> DataFrame:
    """Share of each subgroup within its section and period, in percent.

    The input is one row per section, subgroup and period, so a window holds one section's
    subgroups.
    """
    total = F.sum(value).over(Window.partitionBy("section", "year_period"))
    return long.withColumn("share_pct", F.try_divide(F.lit(100.0) * F.col(value), total))


def labelled_odds_ratios(results: DataFrame, variable: str, type: str = SAME_DAY) -> DataFrame:
    """Odds ratios of one exposure with display labels; codes without a label stay."""
    chosen = results.where((F.col("variable") == variable) & (F.col("type") == type))
    return chosen.select(
        "or", "or_low", "or_high",
        relabel(F.col("subgroup_type"), FAMILY_LABELS).alias("subgroup_type"),
        relabel(F.col("subgroup"), SUBGROUP_LABELS).alias("subgroup"),
        "year_period",
    )


def rows_mentioning(table: DataFrame, value: str) -> DataFrame:
    """Rows with the value in any column, read as text."""
    return table.where(any_column_equals(table.columns, value))


def pivot_mean(
    table: DataFrame, index: Sequence[str], column: str, value: str, wanted: Sequence[str]
) -> DataFrame:
    """Mean of ``value``, one column per wanted entry of ``column``, null where there is none."""
    return table.groupBy(*index).pivot(column, list(wanted)).agg(F.avg(f"`{value}`"))


def densify(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """A row for every key; keys without data get nulls."""
    return keys.join(table, list(on), "left")


def densify_entries(
    table: DataFrame, groups: Sequence[str], column: str, wanted: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Every group with every wanted entry of ``column``, in one pass over the table and without a join.

    A group has one row per entry at most; entries without a row get nulls.
    """

    def cell(entry: str):
        found = [F.max(F.when(F.col(column) == entry, F.col(f"`{v}`"))).alias(v) for v in values]
        return F.struct(F.lit(entry).alias(column), *found)

    return table.groupBy(*groups).agg(F.array(*map(cell, wanted)).alias("_cells")).select(*groups, F.inline("_cells"))


def key_grid(table: DataFrame, groups: Sequence[str], column: str, wanted: Sequence[str]) -> DataFrame:
    """Every group of the table with every wanted entry: the list is attached, not joined."""
    return table.select(*groups).distinct().withColumn(column, F.explode(F.array(*[F.lit(v) for v in wanted])))


def in_custom_order(table: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Wanted values first, in their order, then the others by name."""
    return table.orderBy(display_order(F.col(column), wanted), column)
