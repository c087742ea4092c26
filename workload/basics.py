"""Scans, sinks, projections, filters and scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatstrata.functions import dates, indicators, numbers, periods, places
from heatstrata.operators import columns, exposure, mortality, reports
from heatstrata.plans import combine
from heatstrata.sources import readers, schemas, writers
from heatstrata.sources.work_folder import work_folder
from workload import sql
from workload.tables import PERIODS, death_records, deaths_clean, deaths_daily, rounded, table, weather, weather_raw

RAW_NAMES = [f.name for f in schemas.DEATHS_RAW.fields]
# Periods with a gap, so that some years lie outside.
GAPPED = ((1995, 1996), (1999, 2001))


def raw_weather_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weather with its date as text."""
    return weather_raw(spark, sf_dir).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather written as header CSV and read back with declared types."""
    folder = work_folder(spark)
    writers.write_csv(raw_weather_text(spark, sf_dir), folder)
    return rounded(readers.read_csv(spark, folder, schemas.WEATHER_RAW), 9)


def scan_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the wanted columns that the file has; one wanted column does not exist."""
    folder = work_folder(spark)
    writers.write_csv(raw_weather_text(spark, sf_dir), folder)
    wanted = ["ADM2_PCODE", "date", "tmax", "humidity"]
    return rounded(readers.read_wanted(spark, folder, wanted, schemas.WEATHER_RAW), 9)


def scan_union_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files whose headers drift: lower case before 2012, an extra column from 2012 on.

    Each part is one write, split into a folder per registration year.
    """
    folder = work_folder(spark)
    records = death_records(spark, sf_dir).select(*RAW_NAMES, F.col("REG_YEAR").alias("year"))
    old, new = records.where("year < 2012"), records.where("year >= 2012")
    old = old.toDF(*[c.lower() for c in old.columns])
    new = new.withColumn("AREA_UR", F.lit(1))
    for part, name in ((old, "old"), (new, "new")):
        part.write.option("header", True).partitionBy("year").csv(f"{folder}/{name}")
    paths = [f"{folder}/{name}/year={y}" for name, years in (("old", range(1998, 2012)), ("new", range(2012, 2023))) for y in years]
    found = readers.read_years(spark, [*paths, f"{folder}/missing"], schemas.DEATHS_RAW, tag="path", skipped=[])
    return found.withColumn("REG_YEAR", readers.year_in_path("path")).select(*RAW_NAMES, "AREA_UR", "REG_YEAR")


def scan_period_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums in one CSV folder per period, by one write; the period comes back from the folder name."""
    folder = work_folder(spark)
    daily = deaths_daily(spark, sf_dir).select("date_of_occurrence", "ENT_OCURR", "MUN_OCURR", *mortality.SEX_COLUMNS)
    period = F.replace(periods.period_of_date(F.col("date_of_occurrence"), PERIODS), F.lit("-"), F.lit("_"))
    named = daily.withColumn("combined_sum", F.coalesce(period, F.lit("unknown")))
    named.write.option("header", True).partitionBy("combined_sum").csv(folder)
    return readers.read_period_files(spark, folder, schemas.DEATHS_DAILY, prefix="combined_sum=")


def scan_drifting_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder whose files have the same columns in three orders, and one column that only some have."""
    folder = work_folder(spark)
    records = death_records(spark, sf_dir).select(*RAW_NAMES, "o_orderkey")
    for part, names in enumerate((RAW_NAMES, RAW_NAMES[::-1], [*RAW_NAMES[5:], *RAW_NAMES[:5]])):
        rows = records.where(F.col("o_orderkey") % 3 == part)
        rows.select(*names, *(["o_orderkey"] if part else [])).write.mode("append").option("header", True).csv(f"{folder}/{'ab'[part % 2]}")
    found = readers.read_csv(spark, [f"{folder}/a", f"{folder}/b"], schemas.DEATHS_RAW)
    return found.select(*RAW_NAMES, F.col("o_orderkey").cast("long").alias("o_orderkey"))


def scan_float_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files that write codes as 9.0, 9,0 or as words: values that do not fit, counted per file."""
    folder = work_folder(spark)
    records = death_records(spark, sf_dir)
    sex = F.col("SEXO").cast("string")
    written = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(sex, F.lit(",0"))).when(F.col("o_orderkey") % 5 == 1, F.concat(sex, F.lit(".0")))
        .when(F.col("o_orderkey") % 5 == 2, F.lit("x")).otherwise(sex)
    )
    records.select("ENT_OCURR", written.alias("SEXO"), F.col("REG_YEAR").alias("year")).write.option("header", True).partitionBy("year").csv(folder)
    rows = readers.read_years(spark, [folder], schemas.DEATHS_RAW, tag="path", misfits="lost")
    per_file = readers.misfits_by_file(rows.withColumn("path", readers.year_in_path("path")), "path", "lost")
    sexes = rows.groupBy(readers.year_in_path("path").alias("file")).agg(F.sum("SEXO").cast("long").alias("sum_sex"))
    return per_file.join(sexes, "file")


def scan_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicator table as an earlier run exports it, in CSV, read back by its schema."""
    folder = work_folder(spark)
    writers.write_csv(exposure.heat_indicators(weather(spark, sf_dir)), folder)
    return rounded(readers.read_csv(spark, folder, schemas.HEAT_INDICATORS))


def project_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaned table with repeated names and an absent column, repaired; all columns of one prefix summed."""
    clean = deaths_clean(spark, sf_dir).select("date_of_occurrence", "ENT_OCURR", "MUN_OCURR", *mortality.SEX_COLUMNS)
    twice = clean.select("*", F.lit(7).alias("ENT_OCURR"), F.lit(8).alias("Group_A_SEXO"))
    once = columns.require_columns(columns.drop_repeated_names(twice), ["ENT_OCURR", "Group_A_SEXO"], "cleaned deaths")
    full = columns.add_if_absent(once, {"AREA_UR": F.lit(None).cast("int"), "ENT_OCURR": F.lit(-1)})
    found = columns.columns_starting(full, "Group_")
    return full.groupBy("ENT_OCURR", "AREA_UR").agg(*[F.sum(c).alias(c) for c in found])


def scan_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section tables of a report, a folder of CSV files each, read as one table; their columns differ."""
    folder = work_folder(spark)
    customer = table(spark, sf_dir, "customer")
    counts = customer.groupBy(F.col("c_mktsegment").alias("Segment")).agg(F.count("*").alias("Total"), F.sum("c_nationkey").alias("Keys"))
    writers.write_csv(counts, f"{folder}/Market segment")
    nations = customer.groupBy(F.concat(F.lit("N"), F.col("c_nationkey")).alias("Nation")).agg(F.count("*").alias("Total"))
    writers.write_csv(nations, f"{folder}/Nation + key")
    return readers.read_section_table(spark, folder, ["Market segment", "Nation + key", "Occupation"], absent=[])


def report_lines(spark: SparkSession, sf_dir: str) -> str:
    """A report per nation: dividers with a market segment, below each its customers. Returns the folder."""
    folder = work_folder(spark)
    customer = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 7 != 0, F.col("c_name"))
    lines = customer.select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("place"), name.alias("Subgroup"), F.col("c_custkey").cast("string").alias("key"))
    dividers = customer.select("c_nationkey", "c_mktsegment").distinct().select(
        "c_nationkey", "c_mktsegment", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("— "), "c_mktsegment", F.lit(" —")).alias("Subgroup"), F.lit(None).cast("string").alias("key")
    )
    ordered = lines.unionByName(dividers).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_mktsegment", "place")
    ordered.select("c_nationkey", "Subgroup", "key").write.option("header", True).partitionBy("c_nationkey").csv(folder)
    return folder


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of each line of many report files, from the divider above it."""
    rows = readers.with_place_in_file(spark, f"{report_lines(spark, sf_dir)}/*", ["Subgroup", "key"])
    found = reports.label_forward(rows, "_row", file="_file", block="_block")
    return found.select("section", "Subgroup", F.col("key").cast("long").alias("c_custkey"))


def append_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums loaded by year as CSV batches; two years are loaded twice. Rows and deaths as read back."""
    folder = work_folder(spark)
    sums = deaths_daily(spark, sf_dir).select("ENT_OCURR", "MUN_OCURR", *mortality.SEX_COLUMNS, F.year("date").alias("batch"))
    known = sums.where("batch IS NOT NULL")
    for years in ("batch <= 1996", "batch IN (1995, 1996)", "batch > 1996"):
        writers.replace_batches(known.where(years), folder, kind="csv")
    back = readers.read_csv(spark, folder, schemas.DEATHS_DAILY, tag="path").withColumn("batch", F.regexp_extract("path", r"batch=(\d+)", 1).cast("int"))
    deaths = numbers.row_sum([F.col(c) for c in mortality.SEX_COLUMNS])
    return back.groupBy("batch").agg(F.count("*").alias("n_rows"), F.sum(deaths).alias("deaths"))


def combine_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned yearly files, each with one of three date layouts, combined and split by period."""
    folder = work_folder(spark)
    clean = mortality.clean_deaths(death_records(spark, sf_dir).withColumn("YEAR_FILE", F.col("REG_YEAR")), "YEAR_FILE")
    clean = clean.withColumn("year", F.year("date_of_occurrence"))
    third = F.coalesce(F.col("year"), F.lit(0)) % 3
    layouts = [F.when(third == k, F.date_format("date_of_occurrence", x)) for k, x in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"))]
    yearly = clean.withColumn("date_of_occurrence", F.coalesce(*layouts))
    yearly.write.option("header", True).partitionBy("year").csv(f"{folder}/yearly")
    split = combine.combine_and_split(spark, [f"{folder}/yearly"], f"{folder}/out", periods=PERIODS)
    return split.select("date_of_occurrence", "ENT_OCURR", "MUN_OCURR", *mortality.SEX_COLUMNS, "year_period")


def split_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums split by period in few files sorted by municipality; one period and place read back."""
    folder = work_folder(spark)
    daily = deaths_daily(spark, sf_dir).where(F.col("year_period").isNotNull())
    writers.write_by_period(daily.select("date", "municipality", *mortality.SEX_COLUMNS, "year_period"), folder, sort=["municipality", "date"])
    return spark.read.parquet(folder).where("year_period = '1997-1998' AND municipality >= 'MX02'")


def split_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums written to one folder per period and read back."""
    folder = work_folder(spark)
    daily = deaths_daily(spark, sf_dir).where(F.col("year_period").isNotNull())
    writers.write_by_period(daily.select("date", "municipality", *mortality.SEX_COLUMNS, "year_period"), folder)
    return spark.read.parquet(folder)


def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(columns.rename(weather_raw(spark, sf_dir), {"ADM2_PCODE": "municipality", "tmax": "tmax_max", "tmin": "tmin_max"}), 9)


def project_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    unused = ["CAUSA_DEF", "SEXO", "EDAD_AGRU", "ESCOLARIDA", "NACIONALID", "EDO_CIVIL", "OCUPACION", "LISTA_MEX", "NECROPSIA"]
    return columns.drop_if_present(death_records(spark, sf_dir), unused)


def project_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.reorder(death_records(spark, sf_dir), ["ANIO_OCUR", "MES_OCURR", "DIA_OCURR", "absent"])


def project_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.existing(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_area"])


def filter_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one period, as bounds on the stored date so that file statistics apply."""
    kept = table(spark, sf_dir, "lineitem").where(
        "l_shipdate >= timestamp_ntz'1997-01-01' AND l_shipdate < timestamp_ntz'1999-01-01'"
    )
    return kept.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"))


def filter_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    kept = orders.where(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return kept.select("o_orderkey", "o_orderstatus", "o_orderpriority")


def filter_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.where(indicators.any_column_equals(customer.columns, "MACHINERY")).select("c_custkey", "c_mktsegment")


def date_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = dates.date_from_parts(F.col("ANIO_OCUR"), F.col("MES_OCURR"), F.col("DIA_OCURR"))
    return death_records(spark, sf_dir).select("o_orderkey", built.alias("date_of_occurrence"))


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text dates with and without a time, some of them unreadable."""
    text = F.when(F.col("l_returnflag") == "R", F.lit("bad")).otherwise(
        F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).otherwise(
            F.date_format("l_shipdate", "yyyy-MM-dd")
        )
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dates.date_from_text(text).alias("date"))


def mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyy/MM/dd"))
        .when(F.col("o_orderpriority") == "5-LOW", F.date_format(day, "MM/dd/yyyy"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("unknown"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


def date_parse_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First layout that fits each row."""
    return mixed_dates(spark, sf_dir).select("o_orderkey", dates.date_from_layouts(F.col("text")).alias("date"))


def date_parse_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First layout that fits any row, used for the whole column."""
    mixed = mixed_dates(spark, sf_dir)
    layout = dates.column_layout(mixed, "text")
    return mixed.select("o_orderkey", F.try_to_date("text", layout).alias("date"))


def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        *[c.alias(n) for n, c in dates.calendar_parts(day).items()],
        dates.sunday_weekday(day).alias("wday_from_sunday"),
    )


def period_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period of each order; years outside become null in one column and text in the other."""
    year = F.year("o_orderdate")
    label = periods.period_of_year(year, GAPPED)
    spelled = F.concat(F.lit(" "), F.replace(label, F.lit("-"), F.lit("_")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        label.alias("period"),
        periods.period_of_year(year, GAPPED, keep_other=True).alias("period_or_year"),
        periods.normal_label(spelled).alias("normal"),
    )


def period_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = periods.period_of_date(F.col("o_orderdate").cast("date"), PERIODS)
    counted = table(spark, sf_dir, "orders").groupBy(label.alias("year_period")).agg(F.count("*").alias("n_orders"))
    return counted.withColumn("period_days", periods.period_days(F.col("year_period")))


def municipality_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id of every customer's place; unknown for customers in debt."""
    state = F.when(F.col("c_acctbal") >= 0, F.col("n_regionkey"))
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", places.municipality_id(state, F.col("n_nationkey")).alias("municipality"))


def state_from_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of an id and of part brands, of which some are too short."""
    ids = municipality_id(spark, sf_dir).select(
        F.col("c_custkey").alias("key"), "municipality", places.state_of_id(F.col("municipality")).alias("state")
    )
    brands = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_brand").alias("municipality"), places.state_of_id(F.col("p_brand")).alias("state")
    )
    return ids.unionByName(brands)


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.substring("p_brand", 7, 2))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        numbers.number_or_null(text).alias("brand"),
        numbers.number_or_null(F.col("p_name")).alias("name"),
        numbers.number_or_null(F.concat(F.substring("p_brand", 7, 2), F.lit("d"))).alias("suffixed"),
        numbers.number_or_null(F.concat(F.col("p_size").cast("string"), F.lit(".5e1"))).alias("size"),
    )


def row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums across columns that skip unknown cells, or give up the row."""
    days = weather(spark, sf_dir)
    cells = [F.col("tmin_max"), F.col("tmax_max")]
    return rounded(
        days.select(
            "municipality", "date", numbers.row_sum(cells, "cell").alias("by_cell"), numbers.row_sum(cells, "row").alias("by_row")
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        scan_csv, scan_projected, scan_union_years, scan_period_from_path, split_by_period, project_rename, project_drop,
        project_reorder, project_select, filter_period, filter_isin, filter_any_column, date_from_parts, date_parse,
        date_parse_multi, date_parse_column, date_parts, period_bucket, period_days, municipality_id, state_from_id,
        numeric_coerce, row_sums, scan_drifting_order, scan_float_codes, scan_sections, report_sections, append_repeated,
        combine_and_split, split_clustered, scan_indicators, project_repair,
    )
}

WEATHER = f"WITH {sql.WEATHER}\n"
RECORDS = f"WITH {sql.RECORDS}\n"
DAILY = f"WITH {sql.DAILY}\n"
SEXES = ", ".join(mortality.SEX_COLUMNS)
MIXED = """WITH mixed AS (
 SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y/%m/%d')
  WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders)
"""
GAPPED_PERIOD = "CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN '1995-1996' WHEN year(o_orderdate) BETWEEN 1999 AND 2001 THEN '1999-2001' END"
CUSTOMER_IDS = """ids AS (
 SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN printf('MX%02d%03d', n_regionkey, n_nationkey) END AS municipality
 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
STATE = "CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) >= 2 THEN TRY_CAST(substr(regexp_replace({0}, '[^0-9]', '', 'g'), 1, 2) AS INTEGER) END"

ORACLES = {
    "scan_csv": WEATHER
    + """SELECT municipality AS ADM2_PCODE, strftime(date, '%Y-%m-%d') AS date, round(tmin_max, 9) AS tmin,
 round(tmax_max, 9) AS tmax, round(vp, 9) AS vp, round(prcp, 9) AS prcp FROM weather""",
    "scan_projected": WEATHER
    + "SELECT municipality AS ADM2_PCODE, strftime(date, '%Y-%m-%d') AS date, round(tmax_max, 9) AS tmax FROM weather",
    "scan_union_years": RECORDS
    + f"SELECT {', '.join(RAW_NAMES)}, CASE WHEN REG_YEAR >= 2012 THEN '1' END AS AREA_UR, REG_YEAR FROM records",
    "scan_period_from_path": DAILY
    + f"SELECT date_of_occurrence, ENT_OCURR, MUN_OCURR, {SEXES}, year_period FROM daily",
    "split_by_period": DAILY + f"SELECT date, municipality, {SEXES}, year_period FROM daily WHERE year_period IS NOT NULL",
    "project_rename": WEATHER
    + """SELECT municipality, date, round(tmin_max, 9) AS tmin_max, round(tmax_max, 9) AS tmax_max, round(vp, 9) AS vp,
 round(prcp, 9) AS prcp FROM weather""",
    "project_drop": RECORDS + "SELECT ENT_OCURR, MUN_OCURR, DIA_OCURR, MES_OCURR, ANIO_OCUR, REG_YEAR, o_orderkey FROM records",
    "project_reorder": RECORDS + "SELECT * FROM records",
    "project_select": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "filter_period": """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""",
    "filter_isin": """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')""",
    "filter_any_column": """SELECT c_custkey, c_mktsegment FROM customer
WHERE 'MACHINERY' IN (CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR), c_mktsegment)""",
    "date_from_parts": RECORDS + f"SELECT o_orderkey, {sql.DATE_OF_PARTS} AS date_of_occurrence FROM records",
    "date_parse": """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN CAST(l_shipdate AS DATE) END AS date
FROM lineitem""",
    "date_parse_multi": MIXED
    + """SELECT o_orderkey, CAST(coalesce(try_strptime(text, '%Y-%m-%d'), try_strptime(text, '%d/%m/%Y'),
 try_strptime(text, '%m/%d/%Y'), try_strptime(text, '%Y/%m/%d')) AS DATE) AS date FROM mixed""",
    "date_parse_column": MIXED + "SELECT o_orderkey, CAST(try_strptime(text, '%Y-%m-%d') AS DATE) AS date FROM mixed",
    "date_parts": """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
 CAST(isodow(o_orderdate) AS INTEGER) AS wday, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INTEGER) AS week,
 strftime(o_orderdate, '%d') AS day, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS wday_from_sunday FROM orders""",
    "period_bucket": f"""SELECT o_orderkey, {GAPPED_PERIOD} AS period,
 coalesce({GAPPED_PERIOD}, CAST(year(o_orderdate) AS VARCHAR)) AS period_or_year, {GAPPED_PERIOD} AS normal FROM orders""",
    "period_days": f"""SELECT year_period, count(*) AS n_orders, CAST(CASE year_period WHEN '1995-1996' THEN 731 WHEN '1997-1998' THEN 730
 WHEN '1999-2001' THEN 1096 END AS INTEGER) AS period_days
FROM (SELECT {sql.PERIOD_OF.format('o_orderdate')} AS year_period FROM orders) GROUP BY year_period""",
    "municipality_id": f"WITH {CUSTOMER_IDS} SELECT * FROM ids",
    "state_from_id": f"""WITH {CUSTOMER_IDS}
SELECT c_custkey AS key, municipality, {STATE.format('municipality')} AS state FROM ids
UNION ALL SELECT p_partkey, p_brand, {STATE.format('p_brand')} FROM part""",
    "numeric_coerce": """SELECT p_partkey, TRY_CAST(substr(p_brand, 7, 2) AS DOUBLE) AS brand, TRY_CAST(p_name AS DOUBLE) AS name,
 CAST(NULL AS DOUBLE) AS suffixed, CAST(p_size AS DOUBLE) * 10 + 5 AS size FROM part""",
    "scan_drifting_order": RECORDS
    + f"SELECT {', '.join(RAW_NAMES)}, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS o_orderkey FROM records",
    "scan_float_codes": RECORDS
    + """SELECT REG_YEAR AS file, count(*) AS n_rows, CAST(sum(CASE WHEN o_orderkey % 5 IN (0, 2) THEN 1 ELSE 0 END) AS BIGINT) AS n_misfits,
 CAST(sum(CASE WHEN o_orderkey % 5 NOT IN (0, 2) THEN SEXO END) AS BIGINT) AS sum_sex FROM records GROUP BY REG_YEAR""",
    "scan_indicators": f"WITH {sql.HEAT}\nSELECT "
    + ", ".join(f"round({c}, 6) AS {c}" if c in ("tmin_max", "tmax_max", "vp", "prcp") else c for c in exposure.INDICATOR_COLUMNS)
    + " FROM heat",
    "project_repair": f"""WITH {sql.CLEAN}
SELECT ENT_OCURR, CAST(NULL AS INTEGER) AS AREA_UR, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in mortality.SEX_COLUMNS)}
FROM clean GROUP BY ENT_OCURR""",
    "scan_sections": """SELECT 'Market segment' AS section, c_mktsegment AS Subgroup, CAST(count(*) AS DOUBLE) AS Total,
 CAST(sum(c_nationkey) AS DOUBLE) AS Keys FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'Nation + key', 'N' || c_nationkey, CAST(count(*) AS DOUBLE), NULL FROM customer GROUP BY c_nationkey""",
    "report_sections": """SELECT c_mktsegment AS section, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE 'Unspecified' END AS Subgroup,
 c_custkey FROM customer""",
    "append_repeated": DAILY
    + """SELECT CAST(year(date) AS INTEGER) AS batch, count(*) AS n_rows,
 CAST(sum(Group_A_SEXO + Group_B_SEXO + Group_C_SEXO) AS BIGINT) AS deaths FROM daily WHERE date IS NOT NULL GROUP BY year(date)""",
    "combine_and_split": f"""WITH {sql.CLEAN}
SELECT date_of_occurrence, ENT_OCURR, MUN_OCURR, {SEXES}, {sql.PERIOD_OF.format('date_of_occurrence')} AS year_period
FROM clean WHERE {sql.PERIOD_OF.format('date_of_occurrence')} IS NOT NULL""",
    "split_clustered": DAILY
    + f"SELECT date, municipality, {SEXES}, year_period FROM daily WHERE year_period = '1997-1998' AND municipality >= 'MX02'",
    "row_sums": WEATHER
    + """SELECT municipality, date, round(coalesce(tmin_max, 0) + coalesce(tmax_max, 0), 6) AS by_cell,
 round(tmin_max + tmax_max, 6) AS by_row FROM weather""",
}
