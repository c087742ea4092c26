"""Municipality and state codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def municipality_id(state: Column, municipality: Column) -> Column:
    """``MX`` + two-digit state + three-digit municipality; null if a part is unknown."""
    known = state.isNotNull() & municipality.isNotNull()
    return F.when(known, F.format_string("MX%02d%03d", state.cast("int"), municipality.cast("int")))


def state_of_id(municipality: Column, strict: bool = False) -> Column:
    """State number from the first two digits of an id.

    With ``strict`` an id that has fewer than two digits stops the query; otherwise it gives null.
    """
    digits = F.regexp_replace(municipality, "[^0-9]", "")
    state = F.substring(digits, 1, 2).try_cast("int")
    too_short = F.length(digits) < 2
    if not strict:
        return F.when(~too_short, state)
    problem = F.concat(F.lit("no state code in municipality id: "), F.coalesce(municipality, F.lit("null")))
    return F.when(F.coalesce(too_short, F.lit(True)), F.raise_error(problem).cast("int")).otherwise(state)
