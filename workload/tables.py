"""The given tables in the roles that the operators expect.

weather       lineitem by supplier nation and ship day: prices scaled to degrees are temperatures
death records orders with their customer: one order is one death, codes come from its attributes
municipality  nation; state: region
user panel    events by user and day
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heatstrata.functions.periods import period_of_date
from heatstrata.functions.places import municipality_id
from heatstrata.operators import exposure, mortality
from heatstrata.operators.codebook import SUBGROUPS

PERIODS = ((1995, 1996), (1997, 1998), (1999, 2001))
YEARS = (1995, 2001)
DEGREES = 2500.0


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is taken from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if (sf_dir, name) not in _schemas:
        _schemas[sf_dir, name] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[sf_dir, name]).parquet(path)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key -> state, municipality number and id."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        "n_nationkey",
        F.col("n_regionkey").alias("ENT_OCURR"),
        F.col("n_nationkey").alias("MUN_OCURR"),
        municipality_id(F.col("n_regionkey"), F.col("n_nationkey")).alias("municipality"),
    )


def weather_raw(spark: SparkSession, sf_dir: str, unit: str = "municipality") -> DataFrame:
    """One row per unit and day: ADM2_PCODE, date, tmin, tmax, vp, prcp.

    The sums and extremes are combined before the shuffle, which moves at most one row per unit
    and day from each task. Supplier is a dimension whose size grows: no broadcast is forced, and
    a supplier with very many lines is split by the skew handling of the join.
    """
    supplier = (
        table(spark, sf_dir, "supplier")
        .join(places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("state", F.format_string("R%02d", "ENT_OCURR"))
        .select("s_suppkey", F.col(unit).alias("ADM2_PCODE"))
    )
    price = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("ADM2_PCODE", F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            (F.min(F.when(F.col("l_returnflag") != "R", price)) / F.lit(DEGREES)).alias("tmin"),
            (F.max(price) / F.lit(DEGREES)).alias("tmax"),
            F.max("l_discount").alias("vp"),
            F.sum("l_quantity").alias("prcp"),
        )
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.prepare_weather(weather_raw(spark, sf_dir), YEARS)


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather with thresholds, flags, lags and runs, and its period."""
    df = exposure.with_all_indicators(weather(spark, sf_dir))
    return df.withColumn("year_period", period_of_date(F.col("date"), PERIODS))


def death_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw record per order; the codes are digits of its price and its categories.

    The registration year runs over all eras of the code book, whatever the order date, so every
    row of the book is in use. Some days are 99 or impossible, some places 999, some codes null.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        places(spark, sf_dir).drop("municipality"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return (
        joined.withColumn("d", F.expr("bigint(floor(o_totalprice))"))
        .withColumns(
            {
                "REG_YEAR": F.expr("int(1998 + (d div 13) % 25)"),
                "priority": F.substring("o_orderpriority", 1, 1),
                "job": F.expr("int((d div 11) % 121)"),
            }
        )
        .selectExpr(
            "ENT_OCURR",
            "if(d % 97 = 0, 999, MUN_OCURR) AS MUN_OCURR",
            "coalesce(map(0L, 99, 1L, 31)[d % 53], day(o_orderdate)) AS DIA_OCURR",
            "month(o_orderdate) AS MES_OCURR",
            "year(o_orderdate) AS ANIO_OCUR",
            """coalesce(map('1', 'I219', '2', 'J189', '3', 'F101', '4', 'T67')[priority],
             map('F', 'X30', 'O', 'T670')[o_orderstatus]) AS CAUSA_DEF""",
            "int(nullif(d % 32, 0)) AS EDAD_AGRU",
            "array(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 88, 99)[int((d div 32) % 12)] AS ESCOLARIDA",
            "coalesce(map('F', 2, 'O', 1)[o_orderstatus], if(REG_YEAR <= 2013, 3, 9)) AS SEXO",
            "coalesce(map(0L, 9, 1L, 2)[(d div 7) % 10], 1) AS NACIONALID",
            """coalesce(map('2', 6, '4', 9)[priority],
             map('AUTOMOBILE', 1, 'BUILDING', 2, 'FURNITURE', 3, 'HOUSEHOLD', 4)[c_mktsegment], 5) AS EDO_CIVIL""",
            "if(job >= 118, job + 879, job) AS OCUPACION",
            "REG_YEAR",
            "o_orderkey",
        )
    )


def deaths_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.clean_deaths(death_records(spark, sf_dir), "REG_YEAR")


def deaths_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums by place with id, date and period."""
    daily = mortality.with_municipality(mortality.daily_sums(deaths_clean(spark, sf_dir)))
    return daily.withColumn("year_period", period_of_date(F.col("date"), PERIODS))


KEYS = ("ENT_OCURR", "municipality", "date", "year_period")


def deaths_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deaths per municipality-day. Day sums have one row per key, so this is a row expression."""
    return mortality.day_total(deaths_daily(spark, sf_dir), KEYS)


def deaths_by_subgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deaths of every subgroup and of everyone, side by side, per municipality-day.

    Day sums have one row per key, so the total is a row expression here, not another group-by.
    """
    daily = deaths_daily(spark, sf_dir)
    total = mortality.row_sum([F.col(c) for c in mortality.SEX_COLUMNS])
    return daily.select(*KEYS, *SUBGROUPS, total.alias("All"))


FAMILIES = {"All": "All", **SUBGROUPS}


def user_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-days with the highest and lowest value of the day; the number of units grows with the data."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("municipality"), F.col("ts").cast("date").alias("date"))
        .agg(F.max("value").alias("tmax_max"), F.min("value").alias("tmin_max"))
    )


def user_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases per user-day."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .groupBy(F.col("user_id").alias("municipality"), F.col("ts").cast("date").alias("date"))
        .agg(F.count("*").alias("all_deaths"))
    )


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals: engines differ in the last bits."""
    return df.withColumns(
        {f.name: F.round(F.col(f"`{f.name}`"), places) for f in df.schema.fields if f.dataType.typeName() == "double"}
    )
