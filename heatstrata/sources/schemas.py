"""Column types of the raw and intermediate tables. Files are never scanned to guess types."""

from __future__ import annotations

from pyspark.sql import types as T

from heatstrata.operators.codebook import SUBGROUPS
from heatstrata.operators.exposure import INDICATOR_COLUMNS

_int = T.IntegerType()
_long = T.LongType()
_text = T.StringType()
_double = T.DoubleType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


DEATHS_RAW = _struct(
    ("ENT_OCURR", _int), ("MUN_OCURR", _int), ("DIA_OCURR", _int), ("MES_OCURR", _int), ("ANIO_OCUR", _int),
    ("CAUSA_DEF", _text), ("EDAD_AGRU", _int), ("ESCOLARIDA", _int), ("SEXO", _int),
    ("NACIONALID", _int), ("EDO_CIVIL", _int), ("OCUPACION", _int),
)

DEATHS_CLEAN = _struct(
    ("date_of_occurrence", T.DateType()), ("ENT_OCURR", _int), ("MUN_OCURR", _int),
    *[(name, _int) for name in SUBGROUPS],
)

DEATHS_DAILY = _struct(
    ("date_of_occurrence", T.DateType()), ("ENT_OCURR", _int), ("MUN_OCURR", _int),
    *[(name, _long) for name in SUBGROUPS],
)

WEATHER_RAW = _struct(
    ("ADM2_PCODE", _text), ("date", _text), ("tmin", _double), ("tmax", _double), ("vp", _double), ("prcp", _double),
)

# The exported indicator table: flags and lags are 0, 1 or unknown.
HEAT_INDICATORS = _struct(
    *[
        (name, {"municipality": _text, "date": T.DateType(), "date2": T.DateType(), "year": _int, "month": _int}.get(name, _int if name.startswith("hw_") else _double))
        for name in INDICATOR_COLUMNS
    ]
)

# Hot days of a place and period, and deaths of a place and period, as exported.
HEAT_DAYS = _struct(("year_period", _text), ("municipality", _text), *[(name, _long) for name in INDICATOR_COLUMNS if name.startswith("hw_")])
DEATHS_PERIOD = _struct(("ENT_OCURR", _int), ("MUN_OCURR", _int), ("municipality", _text), ("year_period", _text), ("deaths_total", _long))

ODDS_RATIOS = _struct(
    ("ENT_OCURR", _text), ("variable", _text), ("type", _text), ("estimate", _double), ("std.error", _double),
    ("statistic", _double), ("or", _double), ("or_low", _double), ("or_high", _double), ("p.value", _double),
    ("year_period", _text),
)
