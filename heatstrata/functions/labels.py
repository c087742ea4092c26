"""Labels and display order of subgroups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels of subgroup codes.
SUBGROUP_LABELS = {
    "IS_I": "Circulatory system issues",
    "IS_J": "Respiratory system diseases",
    "IS_F": "Mental, Behavioral and Neurodevelopmental disorders",
    "Group_A_SEXO": "Male",
    "Group_B_SEXO": "Female",
    "Group_A_OCUPACION": "Indoor workers/professions",
    "Group_B_OCUPACION": "Outdoor workers/professions",
    "Group_C_OCUPACION": "Unemployed or ineligible",
    "Group_A_ESCOLARIDA": "No schooling",
    "Group_B_ESCOLARIDA": "Primary or secondary schooling",
    "Group_C_ESCOLARIDA": "High schooling",
    "Group_D_ESCOLARIDA": "Professional schooling",
    "Group_E_ESCOLARIDA": "No information or ineligible",
    "Group_A_EDAD": "Less than 4",
    "Group_B_EDAD": "5–19",
    "Group_C_EDAD": "20–64",
    "Group_D_EDAD": "65–84",
    "Group_E_EDAD": "85–120",
    "Group_F_EDAD": "No specification",
    "CIVIL_SINGLE": "Single",
    "CIVIL_MARRIED": "Married",
    "CIVIL_COHABITING": "Live-in",
    "CIVIL_SEPERATED": "Separated",
    "CIVIL_WIDOWED": "Widowed",
    "CIVIL_NOT_SPEC": "Not specified",
    "NACIONALID_MEXICANA": "Mexican Nationality",
    "NACIONALID_EXTRANJERA": "Foreign Nationality",
}

# Display labels of subgroup families.
FAMILY_LABELS = {
    "EDAD": "Age group",
    "ESCOLARIDAD": "Education level",
    "SEXO": "Sex",
    "CAUSE_IS": "Cause of death",
    "CIVIL_STATUS": "Marital status",
    "OCUPACION": "Occupation",
    "NACIONALIDAD": "Nationality",
}

# Sections of the descriptive report, in display order, with their family.
REPORT_SECTIONS = {
    "Age group": "EDAD",
    "Sex": "SEXO",
    "Schooling": "ESCOLARIDAD",
    "Cause of death": "CAUSE_IS",
    "Nationality": "NACIONALIDAD",
    "Civil status": "CIVIL_STATUS",
    "Occupation": "OCUPACION",
}

# Subgroups left out of the odds-ratio figures.
UNPLOTTED_SUBGROUPS = ("Group_C_SEXO", "NACIONALID_NO_ESPEC")


def relabel(col: Column, labels: Mapping[str, str]) -> Column:
    """Look a code up; a code without a label stays as it is."""
    pairs = [F.lit(v) for v in chain.from_iterable(labels.items())]
    return F.coalesce(F.create_map(*pairs)[col], col)


def display_order(col: Column, wanted: Sequence[str]) -> Column:
    """Position in a wanted order; values outside it share the place after the last one."""
    place = F.array_position(F.array(*[F.lit(v) for v in wanted]), col)
    return F.when(place > 0, place.cast("int")).otherwise(F.lit(len(wanted) + 1))
