"""Readers for header CSV files whose columns drift from year to year."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatstrata.functions.numbers import number_or_null
from heatstrata.functions.periods import normal_label


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names of a header CSV file or folder; reads the first line only."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def header_catalogue(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, line): the first line of every file that is not empty, in one job however many files there are.

    Each task must have one piece of one file (``headers_by_file`` sees to it): its first row is the one
    numbered 0, and the first piece's is the header. Rows go no further than this filter in the scan.
    Lines are read by the text source: a header must not have a line break inside quotes.
    """
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"),
    )
    return lines.where("row = 0 AND start = 0").select("file", "line")


def headers_by_file(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Column names of each file that has a line, by the catalogue; the rows are as many as the files."""
    one_file_a_task = {"spark.sql.files.openCostInBytes": str(1 << 40)}
    with _settings(spark, one_file_a_task):
        found = {unquote(r.file): r.line for r in header_catalogue(spark, paths).collect()}
    # The catalogue's lines are parsed as CSV once per distinct header, not per file.
    distinct = sorted(set(found.values()))
    names = {line: tuple(_parsed_header(line)) for line in distinct}
    return {file: names[line] for file, line in sorted(found.items())}


def _parsed_header(line: str) -> list[str]:
    """Names of a header line as Spark's CSV source gives them: an empty name is ``_c<place>``, a repeated one gets its place."""
    cells = next(csv.reader([line.removeprefix("\ufeff")], escapechar="\\", doublequote=False), [])
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def files_below(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The files that Spark reads for a file, folder, glob or list of them."""
    return sorted(spark.read.text([paths] if isinstance(paths, str) else list(paths)).inputFiles())


def typed(name: str, known: T.StructType) -> Column:
    """A text column as its known type (names in any case), others as they are.

    Whole numbers may be written as floats (``9.0``). What does not fit becomes null.
    """
    kinds = {f.name.upper(): f.dataType for f in known.fields}
    text, kind = F.col(f"`{name}`"), kinds.get(name.upper(), T.StringType())
    if not isinstance(kind, T.IntegralType):
        return text.try_cast(kind).alias(name)
    number = text.try_cast("double")
    return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number).try_cast(kind)).alias(name)


def _same_header(spark: SparkSession, names: Sequence[str], files: list[str], known: T.StructType, misfits: str | None) -> DataFrame:
    """Files with one header, read by one scan; Spark checks the header of each against the names."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(files)
    if misfits is None:
        return raw
    lost = [(F.col(f"`{n}`").isNotNull() & typed(n, known).isNull()).cast("int") for n in names]
    return raw.withColumn(misfits, sum(lost, F.lit(0)))


def read_csv(spark: SparkSession, paths: str | Sequence[str], known: T.StructType, misfits: str | None = None, tag: str | None = None) -> DataFrame:
    """Header CSV with known types. Files are matched by each one's own header, never by place.

    Columns come in the order of the first file, then those that only others have; absent ones are
    null. A value that does not fit its type becomes null; ``misfits`` names a column with their
    number per row, ``tag`` one with the file's path.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, names in headers_by_file(spark, paths).items():  # files without a line are not in it
        by_header.setdefault(names, []).append(file)
    if not by_header:
        raise FileNotFoundError(f"no file with a header below {paths}")
    parts = [
        _same_header(spark, names, files, known, misfits).select(
            *[typed(n, known) for n in names], *([misfits] if misfits else []), *([F.col("_metadata.file_path").alias(tag)] if tag else [])
        )
        for names, files in by_header.items()
    ]
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined


def read_wanted(spark: SparkSession, path: str, wanted: Iterable[str], known: T.StructType) -> DataFrame:
    """Only the wanted columns that the file has; the CSV parser skips the others."""
    df = read_csv(spark, path, known)
    return df.select(*[c for c in wanted if c in df.columns])


def read_years(
    spark: SparkSession, paths: Sequence[str], known: T.StructType, tag: str | None = None, skipped: list[str] | None = None,
    misfits: str | None = None,
) -> DataFrame:
    """Union of yearly files by column name, upper-cased; absent columns are null.

    Files with the same header are read by one scan, and all headers are found by one job. A path that
    cannot be opened is an error, unless a list ``skipped`` is given to which it is added; if none opens,
    that is an error too. ``tag`` names a column that gets each file's path, ``misfits`` one with the
    number of values of the row that do not fit their type and became null.
    """
    present = list(paths)
    try:
        by_file = headers_by_file(spark, present)
    except AnalysisException:  # some path is not there: find out which
        present = []
        for path in paths:
            try:
                files_below(spark, path)
                present.append(path)
            except AnalysisException as e:
                if skipped is None:
                    raise FileNotFoundError(f"cannot read {path}") from e
                skipped.append(path)
        by_file = headers_by_file(spark, present) if present else {}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, names in by_file.items():
        by_header.setdefault(names, []).append(file)
    if not by_header:
        raise FileNotFoundError(f"no readable file among {list(paths)}")
    combined: DataFrame | None = None
    for names, same in by_header.items():
        columns = [typed(n, known).alias(n.upper()) for n in names]
        if tag is not None:
            columns.append(F.col("_metadata.file_path").alias(tag))
        if misfits is not None:
            columns.append(F.col(misfits))
        part = _same_header(spark, names, same, known, misfits).select(*columns)
        combined = part if combined is None else combined.unionByName(part, allowMissingColumns=True)
    return combined


def misfits_by_file(rows: DataFrame, tag: str, misfits: str) -> DataFrame:
    """(file, n_rows, n_misfits) of a table read with ``tag`` and ``misfits``."""
    return rows.groupBy(F.col(tag).alias("file")).agg(F.count("*").alias("n_rows"), F.sum(misfits).cast("long").alias("n_misfits"))


def with_place_in_file(spark: SparkSession, path: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows of header CSV files as text, with ``_file``, ``_block`` and ``_row``: their file, the piece of it, the order inside.

    Blocks of a file are ordered by their first byte, and a block's rows come in order. All are marked
    where the file is read, before any shuffle.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.option("header", True).schema(schema).csv([path] if isinstance(path, str) else list(path))
    return rows.select(
        *[F.col(f"`{n}`") for n in names],
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
    )


def year_in_path(path_column: str) -> Column:
    """Four-digit year in a file's path: ``.../year=2013/...``."""
    return F.regexp_extract(F.col(path_column), r"year=(\d{4})", 1).try_cast("int")


def read_period_files(spark: SparkSession, folder: str, known: T.StructType, prefix: str = "combined_sum_") -> DataFrame:
    """All ``<prefix>*`` files of a folder, with ``year_period`` from names ``<prefix><first>_<last>``, else null."""
    df = read_csv(spark, f"{folder.rstrip('/')}/{prefix}*", known, tag="_file")
    found = F.regexp_extract("_file", prefix + r"(\d{4}_\d{4})", 1)
    return df.withColumn("year_period", normal_label(F.nullif(found, F.lit("")))).drop("_file")


def read_sections(
    spark: SparkSession, folder: str, sections: Sequence[str], skipped: list[str] | None = None
) -> dict[str, DataFrame]:
    """Section tables of a report: one CSV folder per section, all columns as text.

    A section that is not there, or cannot be read, is an error, unless a list ``skipped`` is given
    to which its name is added.
    """
    tables: dict[str, DataFrame] = {}
    for name in sections:
        try:
            tables[name] = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{name}")
        except AnalysisException as e:
            if skipped is None:
                raise FileNotFoundError(f"no section {name} in {folder}") from e
            skipped.append(name)
    return tables


def read_section_table(spark: SparkSession, folder: str, sections: Sequence[str], label: str = "Subgroup", absent: list[str] | None = None) -> DataFrame:
    """All sections of a report as one table: ``section``, the label, and every other column as a number.

    One CSV folder per section; all are read together, files with equal headers by one scan. The first
    column of a file is its label, whatever its name. A section without files is an error, unless a list
    ``absent`` is given to which its name is added.
    """
    base = folder.rstrip("/")
    there = []
    for name in sections:
        try:
            files_below(spark, f"{base}/{name}")
            there.append(name)
        except AnalysisException as e:
            if absent is None:
                raise FileNotFoundError(f"no section {name} in {folder}") from e
            absent.append(name)
    if not there:
        raise FileNotFoundError(f"none of the sections is in {folder}")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, names in headers_by_file(spark, [f"{base}/{name}" for name in there]).items():
        by_header.setdefault(names, []).append(file)
    place = F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -2)
    combined: DataFrame | None = None
    for names, files in by_header.items():
        first, *values = names
        part = _same_header(spark, names, files, T.StructType([]), None).select(
            place.alias("section"), F.col(f"`{first}`").alias(label), *[number_or_null(F.col(f"`{v}`")).alias(v) for v in values]
        )
        combined = part if combined is None else combined.unionByName(part, allowMissingColumns=True)
    return combined
