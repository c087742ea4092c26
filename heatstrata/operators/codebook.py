"""The code book: which raw codes make up each indicator, by registration year.

One table of plain values replaces a cleaning routine per era. A row holds for a span of
registration years; ``codes`` lists single codes, and a pair (low, high) is a range with both
ends included. A string code that ends in ``*`` is a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

EVERY_YEAR = (1998, 2022)


@dataclass(frozen=True)
class Code:
    family: str
    subgroup: str
    field: str
    codes: tuple
    years: tuple[int, int] = EVERY_YEAR


# Raw codes of every indicator.
CODE_BOOK = (
    # cause of death
    Code("CAUSE_IS", "IS_I", "CAUSA_DEF", ("I*",)),
    Code("CAUSE_IS", "IS_J", "CAUSA_DEF", ("J*",)),
    Code("CAUSE_IS", "IS_F", "CAUSA_DEF", ("F*",)),
    Code("CAUSE_IS", "IS_TX", "CAUSA_DEF", ("T67", "X30")),
    # age band
    Code("EDAD", "Group_A_EDAD", "EDAD_AGRU", ((1, 5),)),
    Code("EDAD", "Group_B_EDAD", "EDAD_AGRU", (6, 7, 8)),
    Code("EDAD", "Group_C_EDAD", "EDAD_AGRU", ((9, 17),)),
    Code("EDAD", "Group_D_EDAD", "EDAD_AGRU", ((18, 21),)),
    Code("EDAD", "Group_E_EDAD", "EDAD_AGRU", ((22, 29),)),
    Code("EDAD", "Group_F_EDAD", "EDAD_AGRU", (30,)),
    # schooling
    Code("ESCOLARIDAD", "Group_A_ESCOLARIDA", "ESCOLARIDA", (1,)),
    Code("ESCOLARIDAD", "Group_B_ESCOLARIDA", "ESCOLARIDA", ((2, 5),), (1998, 2011)),
    Code("ESCOLARIDAD", "Group_B_ESCOLARIDA", "ESCOLARIDA", ((2, 7),), (2012, 2022)),
    Code("ESCOLARIDAD", "Group_C_ESCOLARIDA", "ESCOLARIDA", (6,), (1998, 2011)),
    Code("ESCOLARIDAD", "Group_C_ESCOLARIDA", "ESCOLARIDA", (8,), (2012, 2022)),
    Code("ESCOLARIDAD", "Group_D_ESCOLARIDA", "ESCOLARIDA", (7,), (1998, 2011)),
    Code("ESCOLARIDAD", "Group_D_ESCOLARIDA", "ESCOLARIDA", (9, 10), (2012, 2022)),
    Code("ESCOLARIDAD", "Group_E_ESCOLARIDA", "ESCOLARIDA", (8, 9), (1998, 2011)),
    Code("ESCOLARIDAD", "Group_E_ESCOLARIDA", "ESCOLARIDA", (88, 99), (2012, 2022)),
    # sex
    Code("SEXO", "Group_A_SEXO", "SEXO", (1,)),
    Code("SEXO", "Group_B_SEXO", "SEXO", (2,)),
    Code("SEXO", "Group_C_SEXO", "SEXO", (3,), (1998, 2013)),
    Code("SEXO", "Group_C_SEXO", "SEXO", (9,), (2014, 2022)),
    # nationality
    Code("NACIONALIDAD", "NACIONALID_MEXICANA", "NACIONALID", (1,)),
    Code("NACIONALIDAD", "NACIONALID_EXTRANJERA", "NACIONALID", (2,)),
    Code("NACIONALIDAD", "NACIONALID_NO_ESPEC", "NACIONALID", (9,)),
    # civil status
    Code("CIVIL_STATUS", "CIVIL_SINGLE", "EDO_CIVIL", (1,)),
    Code("CIVIL_STATUS", "CIVIL_MARRIED", "EDO_CIVIL", (2,), (1998, 2003)),
    Code("CIVIL_STATUS", "CIVIL_MARRIED", "EDO_CIVIL", (5,), (2004, 2022)),
    Code("CIVIL_STATUS", "CIVIL_COHABITING", "EDO_CIVIL", (3,), (1998, 2003)),
    Code("CIVIL_STATUS", "CIVIL_COHABITING", "EDO_CIVIL", (4,), (2004, 2022)),
    Code("CIVIL_STATUS", "CIVIL_DIVORCED_SEPARATED", "EDO_CIVIL", (4, 5), (1998, 2003)),
    Code("CIVIL_STATUS", "CIVIL_DIVORCED_SEPARATED", "EDO_CIVIL", (3,), (2004, 2011)),
    Code("CIVIL_STATUS", "CIVIL_DIVORCED_SEPARATED", "EDO_CIVIL", (2, 6), (2012, 2022)),
    Code("CIVIL_STATUS", "CIVIL_WIDOWED", "EDO_CIVIL", (6,), (1998, 2003)),
    Code("CIVIL_STATUS", "CIVIL_WIDOWED", "EDO_CIVIL", (2,), (2004, 2011)),
    Code("CIVIL_STATUS", "CIVIL_WIDOWED", "EDO_CIVIL", (3,), (2012, 2022)),
    Code("CIVIL_STATUS", "CIVIL_NOT_SPEC", "EDO_CIVIL", (9,)),
    # occupation
    Code("OCUPACION", "Group_A_OCUPACION", "OCUPACION",
         (11, 12, 13, 14, 21, 51, 52, 53, 54, 55, 61, 62, 71, 72, 81, 82, 83), (1998, 2012)),
    Code("OCUPACION", "Group_A_OCUPACION", "OCUPACION", (1, 2, 3, 4, 5, 7, 8, 9), (2013, 2021)),
    Code("OCUPACION", "Group_A_OCUPACION", "OCUPACION",
         (11, 12, 13, 14, 15, 16, 17, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 31, 32, 39, 41, 42, 43, 49,
          51, 52, 53, 54, 72, 73, 74, 75, 76, 79, 81, 82, 83, 89, 93, 94, 95, 96, 97, 98),
         (2022, 2022)),
    Code("OCUPACION", "Group_B_OCUPACION", "OCUPACION", (41,), (1998, 2012)),
    Code("OCUPACION", "Group_B_OCUPACION", "OCUPACION", (6,), (2013, 2021)),
    Code("OCUPACION", "Group_B_OCUPACION", "OCUPACION", (61, 62, 63, 69, 71, 91, 92), (2022, 2022)),
    Code("OCUPACION", "Group_C_OCUPACION", "OCUPACION", (2, 97, 98, 99), (1998, 2012)),
    Code("OCUPACION", "Group_C_OCUPACION", "OCUPACION", (10, 11, 97, 98, 99), (2013, 2021)),
    Code("OCUPACION", "Group_C_OCUPACION", "OCUPACION", (99, 100, 110, 997, 998, 999), (2022, 2022)),
)

# An earlier book for 2001 that keeps separated and divorced apart.
SPLIT_CIVIL_BOOK = tuple(
    c for c in CODE_BOOK
    if c.subgroup != "CIVIL_DIVORCED_SEPARATED"
    and not (c.subgroup == "Group_C_OCUPACION" and c.years[0] == 1998)
) + (
    Code("CIVIL_STATUS", "CIVIL_SEPARATED", "EDO_CIVIL", (4,), (1998, 2003)),
    Code("CIVIL_STATUS", "CIVIL_DIVORCED", "EDO_CIVIL", (5,), (1998, 2003)),
    Code("OCUPACION", "Group_C_OCUPACION", "OCUPACION", (2, 98, 99), (1998, 2012)),
)

# Fixed value: another spelling of an indicator, found in files cleaned elsewhere.
SPELLINGS = {"CIVIL_DIVORCED_SEPERATED": "CIVIL_DIVORCED_SEPARATED"}

RAW_FIELDS = tuple(dict.fromkeys(c.field for c in CODE_BOOK))
SUBGROUPS = {c.subgroup: c.family for c in CODE_BOOK}


def families(book=CODE_BOOK) -> dict[str, list[str]]:
    """Family -> its subgroups, in book order."""
    found: dict[str, list[str]] = {}
    for code in book:
        members = found.setdefault(code.family, [])
        if code.subgroup not in members:
            members.append(code.subgroup)
    return found


def _numbers(codes: tuple) -> list[int]:
    """Single codes of a list that may hold ranges."""
    return [n for c in codes for n in (range(c[0], c[1] + 1) if isinstance(c, tuple) else (c,))]


def _lookup(rows: list[tuple[Code, int]]) -> str:
    """SQL text: the number of the row whose codes hold the field's value, else null.

    Numeric codes become a constant map, text codes a CASE.
    """
    field = rows[0][0].field
    if all(isinstance(c, (int, tuple)) for r, _ in rows for c in r.codes):
        pairs = ", ".join(f"{code}, {number}" for r, number in rows for code in _numbers(r.codes))
        return f"map({pairs})[{field}]"
    tests = [
        (f"startswith({field}, {c[:-1]!r})" if c.endswith("*") else f"{field} = {c!r}", number)
        for r, number in rows
        for c in r.codes
    ]
    return f"CASE {' '.join(f'WHEN {test} THEN {number}' for test, number in tests)} END"


def years_covered(book=CODE_BOOK) -> tuple[int, int]:
    return min(r.years[0] for r in book), max(r.years[1] for r in book)


def checked_year(year: str, book=CODE_BOOK) -> str:
    """SQL text: the registration year in a column; an error if it is unknown or the book has no codes for it."""
    first, last = years_covered(book)
    message = f"concat('no codes for registration year ', coalesce(string({year}), 'null'))"
    return f"if(coalesce({year} BETWEEN {first} AND {last}, false), {year}, raise_error({message}))"


def bands(year: int | str, book=CODE_BOOK) -> dict[str, str]:
    """SQL text per family: the place of the record's subgroup in its family, null for none.

    A record is in one subgroup of a family at most. ``year`` is the registration year: a number
    picks the era's codes while the plan is built; a column name makes the expression choose by
    row, so files of many eras are cleaned in one scan. Looking codes up in constant maps keeps
    the generated method below the size that the JVM still compiles; chains of comparisons for
    thirty subgroups do not.
    """
    found: dict[str, str] = {}
    first, last = years_covered(book)
    if isinstance(year, int) and not first <= year <= last:
        raise ValueError(f"no codes for registration year {year}")
    for family, members in families(book).items():
        rows = [(r, members.index(r.subgroup) + 1) for r in book if r.family == family]

        def of_year(y: int) -> list[tuple[Code, int]]:
            return [(r, n) for r, n in rows if r.years[0] <= y <= r.years[1]]

        starts = sorted({r.years[0] for r, _ in rows}, reverse=True)
        if isinstance(year, int):
            found[family] = _lookup(of_year(year))
        elif len(starts) == 1:
            found[family] = _lookup(rows)
        else:
            # latest era first, so one bound per era is enough
            eras = [f"WHEN {year} >= {start} THEN {_lookup(of_year(start))}" for start in starts[:-1]]
            found[family] = f"CASE {' '.join(eras)} ELSE {_lookup(of_year(starts[-1]))} END"
    return found


def band_flags(book=CODE_BOOK, prefix: str = "_band_") -> dict[str, str]:
    """SQL text of one 0/1 column per subgroup, from the band columns; never null."""
    return {
        member: f"if({prefix}{family} <=> {number}, 1, 0)"
        for family, members in families(book).items()
        for number, member in enumerate(members, 1)
    }
