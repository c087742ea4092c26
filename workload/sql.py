"""SQL building blocks of the oracles, as lists of common table expressions."""

from __future__ import annotations

PERIOD_OF = """CASE WHEN year({0}) BETWEEN 1995 AND 1996 THEN '1995-1996'
 WHEN year({0}) BETWEEN 1997 AND 1998 THEN '1997-1998'
 WHEN year({0}) BETWEEN 1999 AND 2001 THEN '1999-2001' END"""

PLACES = """places AS (
 SELECT n_nationkey, n_regionkey AS ENT_OCURR, n_nationkey AS MUN_OCURR,
  printf('MX%02d%03d', n_regionkey, n_nationkey) AS municipality FROM nation)"""

WEATHER = PLACES + """,
weather AS (
 SELECT municipality, CAST(l_shipdate AS DATE) AS date,
  min(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) / CAST(2500 AS DOUBLE) AS tmin_max,
  max(l_extendedprice) / CAST(2500 AS DOUBLE) AS tmax_max,
  max(l_discount) AS vp, sum(l_quantity) AS prcp
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey
 WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
 GROUP BY municipality, CAST(l_shipdate AS DATE))"""


def _flag(value: str, limit: str) -> str:
    return f"CASE WHEN {value} >= {limit} THEN 1 WHEN {value} IS NULL OR {limit} IS NULL THEN NULL ELSE 0 END"


def _run(*flags: str) -> str:
    every = " AND ".join(f"{f} = 1" for f in flags)
    none = " OR ".join(f"{f} = 0" for f in flags)
    return f"CASE WHEN {every} THEN 1 WHEN {none} THEN 0 END"


SIDES = {"max": "tmax_max", "min": "tmin_max"}


def heat_from(source: str) -> str:
    thresholds = ", ".join(
        f"quantile_cont({t}, 0.{q}) AS hwthr_{q}_{s}" for q in (99, 95, 90) for s, t in SIDES.items()
    )
    flags = ", ".join(
        [f"{_flag(t, f'hwthr_{q}_{s}')} AS hw_{q}_{s}_1" for q in (99, 95, 90) for s, t in SIDES.items()]
        + [f"{_flag('tmax_max', str(x))} AS hw_abs_{x}" for x in (30, 35)]
    )
    lags = ", ".join(
        [f"lag(hw_99_{s}_1, {k}) OVER u AS hw_99_{s}_lag{k}" for k in (1, 2, 3) for s in SIDES]
        + [f"lag(hw_abs_{x}, 1) OVER u AS hw_abs_{x}_lag1" for x in (30, 35)]
    )
    runs = ", ".join(
        f"{_run(f'hw_99_{s}_1', *[f'hw_99_{s}_lag{k}' for k in range(1, n)])} AS hw_99_{s}_{n}"
        for n in (2, 3) for s in SIDES
    )
    return f"""thresholds AS (SELECT municipality, {thresholds} FROM {source} GROUP BY municipality),
flagged AS (SELECT w.*, t.* EXCLUDE (municipality), {flags}
 FROM {source} w JOIN thresholds t ON w.municipality = t.municipality),
lagged AS (SELECT *, {lags} FROM flagged WINDOW u AS (PARTITION BY municipality ORDER BY date)),
heat AS (SELECT *, date AS date2, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
 {PERIOD_OF.format('date')} AS year_period, {runs} FROM lagged)"""


HEAT = WEATHER + ",\n" + heat_from("weather")

RECORDS = """digits AS (
 SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS d,
  CAST(1998 + (CAST(floor(o_totalprice) AS BIGINT) // 13) % 25 AS INTEGER) AS REG_YEAR,
  substr(o_orderpriority, 1, 1) AS priority
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
records AS (
 SELECT n_regionkey AS ENT_OCURR,
  CASE WHEN d % 97 = 0 THEN 999 ELSE n_nationkey END AS MUN_OCURR,
  CAST(CASE WHEN d % 53 = 0 THEN 99 WHEN d % 53 = 1 THEN 31 ELSE day(o_orderdate) END AS INTEGER) AS DIA_OCURR,
  CAST(month(o_orderdate) AS INTEGER) AS MES_OCURR, CAST(year(o_orderdate) AS INTEGER) AS ANIO_OCUR,
  CASE WHEN priority = '1' THEN 'I219' WHEN priority = '2' THEN 'J189' WHEN priority = '3' THEN 'F101'
   WHEN priority = '4' THEN 'T67' WHEN o_orderstatus = 'F' THEN 'X30' WHEN o_orderstatus = 'O' THEN 'T670' END AS CAUSA_DEF,
  CAST(nullif(d % 32, 0) AS INTEGER) AS EDAD_AGRU,
  CAST([1,2,3,4,5,6,7,8,9,10,88,99][1 + (d // 32) % 12] AS INTEGER) AS ESCOLARIDA,
  CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 1 WHEN REG_YEAR <= 2013 THEN 3 ELSE 9 END AS SEXO,
  CASE (d // 7) % 10 WHEN 0 THEN 9 WHEN 1 THEN 2 ELSE 1 END AS NACIONALID,
  CASE WHEN priority = '2' THEN 6 WHEN priority = '4' THEN 9 WHEN c_mktsegment = 'AUTOMOBILE' THEN 1
   WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_mktsegment = 'FURNITURE' THEN 3
   WHEN c_mktsegment = 'HOUSEHOLD' THEN 4 ELSE 5 END AS EDO_CIVIL,
  CAST(CASE WHEN (d // 11) % 121 >= 118 THEN (d // 11) % 121 + 879 ELSE (d // 11) % 121 END AS INTEGER) AS OCUPACION,
  REG_YEAR, o_orderkey
 FROM digits)"""

# Raw codes per indicator, spelled out a second time on purpose: the oracle must not share the
# library's code book.
INDICATORS = {
    "IS_I": "CAUSA_DEF LIKE 'I%'",
    "IS_J": "CAUSA_DEF LIKE 'J%'",
    "IS_F": "CAUSA_DEF LIKE 'F%'",
    "IS_TX": "CAUSA_DEF IN ('T67', 'X30')",
    "Group_A_EDAD": "EDAD_AGRU BETWEEN 1 AND 5",
    "Group_B_EDAD": "EDAD_AGRU BETWEEN 6 AND 8",
    "Group_C_EDAD": "EDAD_AGRU BETWEEN 9 AND 17",
    "Group_D_EDAD": "EDAD_AGRU BETWEEN 18 AND 21",
    "Group_E_EDAD": "EDAD_AGRU BETWEEN 22 AND 29",
    "Group_F_EDAD": "EDAD_AGRU = 30",
    "Group_A_ESCOLARIDA": "ESCOLARIDA = 1",
    "Group_B_ESCOLARIDA": "CASE WHEN REG_YEAR <= 2011 THEN ESCOLARIDA BETWEEN 2 AND 5 ELSE ESCOLARIDA BETWEEN 2 AND 7 END",
    "Group_C_ESCOLARIDA": "ESCOLARIDA = CASE WHEN REG_YEAR <= 2011 THEN 6 ELSE 8 END",
    "Group_D_ESCOLARIDA": "CASE WHEN REG_YEAR <= 2011 THEN ESCOLARIDA = 7 ELSE ESCOLARIDA IN (9, 10) END",
    "Group_E_ESCOLARIDA": "CASE WHEN REG_YEAR <= 2011 THEN ESCOLARIDA IN (8, 9) ELSE ESCOLARIDA IN (88, 99) END",
    "Group_A_SEXO": "SEXO = 1",
    "Group_B_SEXO": "SEXO = 2",
    "Group_C_SEXO": "SEXO = CASE WHEN REG_YEAR <= 2013 THEN 3 ELSE 9 END",
    "NACIONALID_MEXICANA": "NACIONALID = 1",
    "NACIONALID_EXTRANJERA": "NACIONALID = 2",
    "NACIONALID_NO_ESPEC": "NACIONALID = 9",
    "CIVIL_SINGLE": "EDO_CIVIL = 1",
    "CIVIL_MARRIED": "EDO_CIVIL = CASE WHEN REG_YEAR <= 2003 THEN 2 ELSE 5 END",
    "CIVIL_COHABITING": "EDO_CIVIL = CASE WHEN REG_YEAR <= 2003 THEN 3 ELSE 4 END",
    "CIVIL_DIVORCED_SEPARATED": "CASE WHEN REG_YEAR <= 2003 THEN EDO_CIVIL IN (4, 5) WHEN REG_YEAR <= 2011 THEN EDO_CIVIL = 3 ELSE EDO_CIVIL IN (2, 6) END",
    "CIVIL_WIDOWED": "EDO_CIVIL = CASE WHEN REG_YEAR <= 2003 THEN 6 WHEN REG_YEAR <= 2011 THEN 2 ELSE 3 END",
    "CIVIL_NOT_SPEC": "EDO_CIVIL = 9",
    "Group_A_OCUPACION": "CASE WHEN REG_YEAR <= 2012 THEN OCUPACION IN (11,12,13,14,21,51,52,53,54,55,61,62,71,72,81,82,83)"
    " WHEN REG_YEAR <= 2021 THEN OCUPACION IN (1,2,3,4,5,7,8,9)"
    " ELSE OCUPACION IN (11,12,13,14,15,16,17,19,20,21,22,23,24,25,26,27,28,29,31,32,39,41,42,43,49,"
    "51,52,53,54,72,73,74,75,76,79,81,82,83,89,93,94,95,96,97,98) END",
    "Group_B_OCUPACION": "CASE WHEN REG_YEAR <= 2012 THEN OCUPACION = 41 WHEN REG_YEAR <= 2021 THEN OCUPACION = 6"
    " ELSE OCUPACION IN (61,62,63,69,71,91,92) END",
    "Group_C_OCUPACION": "CASE WHEN REG_YEAR <= 2012 THEN OCUPACION IN (2,97,98,99)"
    " WHEN REG_YEAR <= 2021 THEN OCUPACION IN (10,11,97,98,99) ELSE OCUPACION IN (99,100,110,997,998,999) END",
}

FAMILY_OF = {
    **dict.fromkeys(["IS_I", "IS_J", "IS_F", "IS_TX"], "CAUSE_IS"),
    **dict.fromkeys([f"Group_{x}_EDAD" for x in "ABCDEF"], "EDAD"),
    **dict.fromkeys([f"Group_{x}_ESCOLARIDA" for x in "ABCDE"], "ESCOLARIDAD"),
    **dict.fromkeys([f"Group_{x}_SEXO" for x in "ABC"], "SEXO"),
    **dict.fromkeys(["NACIONALID_MEXICANA", "NACIONALID_EXTRANJERA", "NACIONALID_NO_ESPEC"], "NACIONALIDAD"),
    **dict.fromkeys(
        ["CIVIL_SINGLE", "CIVIL_MARRIED", "CIVIL_COHABITING", "CIVIL_DIVORCED_SEPARATED", "CIVIL_WIDOWED", "CIVIL_NOT_SPEC"],
        "CIVIL_STATUS",
    ),
    **dict.fromkeys([f"Group_{x}_OCUPACION" for x in "ABC"], "OCUPACION"),
}

DATE_OF_PARTS = "TRY_CAST(printf('%04d-%02d-%02d', ANIO_OCUR, MES_OCURR, DIA_OCURR) AS DATE)"

CLEAN = RECORDS + f""",
clean AS (
 SELECT {DATE_OF_PARTS} AS date_of_occurrence, ENT_OCURR, MUN_OCURR,
  {", ".join(f"CASE WHEN {test} THEN 1 ELSE 0 END AS {name}" for name, test in INDICATORS.items())}
 FROM records
 WHERE DIA_OCURR IS DISTINCT FROM 99 AND ENT_OCURR IS DISTINCT FROM 999 AND MUN_OCURR IS DISTINCT FROM 999)"""

DAILY = CLEAN + f""",
daily AS (
 SELECT date_of_occurrence, ENT_OCURR, MUN_OCURR,
  {", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in INDICATORS)},
  printf('MX%02d%03d', ENT_OCURR, MUN_OCURR) AS municipality, date_of_occurrence AS date,
  {PERIOD_OF.format('date_of_occurrence')} AS year_period
 FROM clean GROUP BY date_of_occurrence, ENT_OCURR, MUN_OCURR)"""

TOTAL = DAILY + """,
total AS (
 SELECT ENT_OCURR, municipality, date, year_period,
  CAST(sum(Group_A_SEXO + Group_B_SEXO + Group_C_SEXO) AS BIGINT) AS all_deaths
 FROM daily GROUP BY ENT_OCURR, municipality, date, year_period
 HAVING sum(Group_A_SEXO + Group_B_SEXO + Group_C_SEXO) > 0)"""

# 1 - erf(|z| / sqrt 2) through the all-positive series of erf
P_VALUE = """CASE WHEN {z} IS NOT NULL THEN 1 - 2 * least(abs({z}) / sqrt(2.0), 6) * exp(-pow(least(abs({z}) / sqrt(2.0), 6), 2)) / sqrt(pi())
 * list_sum(list_transform(range(0, 200), lambda n: exp(n * ln(2 * pow(least(greatest(abs({z}), 1e-12) / sqrt(2.0), 6), 2))
   - ((n + 1) * ln(2.0) + lgamma(n + 1.5) - 0.5 * ln(pi()))))) END"""


def stratum_ctes(exposures: list[tuple[str, str]], deaths: str, weather: str = "heat") -> str:
    """Expanded matching, then counts per death-day and exposure."""
    names = ", ".join(f"'{c}'" for c, _ in exposures)
    types = ", ".join(f"'{t}'" for _, t in exposures)
    columns = ", ".join(f"h.{c}" for c, _ in exposures)
    return f"""matched AS (
 SELECT d.municipality, d.date, h.date = d.date AS is_case,
  unnest([{names}]) AS variable, unnest([{types}]) AS type, unnest([{columns}]) AS x
 FROM {deaths} d JOIN {weather} h ON h.municipality = d.municipality AND year(h.date) = year(d.date)
  AND month(h.date) = month(d.date) AND isodow(h.date) = isodow(d.date)),
strata AS (
 SELECT municipality, date, variable, type,
  CAST(max(CASE WHEN is_case THEN x END) AS INTEGER) AS xc,
  CAST(sum(x) AS INTEGER) AS n1, CAST(count(x) - sum(x) AS INTEGER) AS n0
 FROM matched WHERE x IS NOT NULL GROUP BY municipality, date, variable, type)"""


def model_ctes(weights: str, keys: list[str], weight: str = "w") -> str:
    """Newton iterations for every model over rows (municipality, date, keys..., w) of ``weights``."""
    by = ", ".join(keys)
    same = " AND ".join(f"n.{k} = c.{k}" for k in keys)
    nby = ", ".join(f"n.{k}" for k in keys)
    return f"""cells AS (
 SELECT {by}, xc, n1, n0, CAST(sum({weight}) AS DOUBLE) AS w
 FROM strata s JOIN {weights} d ON s.municipality = d.municipality AND s.date = d.date
 WHERE xc IS NOT NULL AND d.w > 0 GROUP BY {by}, xc, n1, n0),
models AS (
 SELECT {by}, sum(w) AS n_cases, sum(CASE WHEN n1 > 0 AND n0 > 0 THEN w ELSE 0 END) AS n_informative,
  sum(CASE WHEN n1 > 0 AND n0 > 0 AND xc = 1 THEN w ELSE 0 END) AS n_exposed
 FROM cells GROUP BY {by}),
newton AS (
 SELECT {by}, 0 AS step, CAST(0 AS DOUBLE) AS b FROM models WHERE n_exposed > 0 AND n_exposed < n_informative
 UNION ALL
 SELECT {by}, step + 1, b + greatest(-1, least(1, sum(w * (xc - p)) / sum(w * p * (1 - p))))
 FROM (SELECT {nby}, n.step, n.b, c.w, c.xc, c.n1 * exp(n.b) / (c.n0 + c.n1 * exp(n.b)) AS p
  FROM newton n JOIN cells c ON {same} WHERE c.n1 > 0 AND c.n0 > 0 AND n.step < 60)
 GROUP BY {by}, step, b),
fitted AS (
 SELECT {nby}, n.b AS estimate, 1 / sqrt(sum(c.w * (c.n1 * exp(n.b) / (c.n0 + c.n1 * exp(n.b)))
   * (c.n0 / (c.n0 + c.n1 * exp(n.b))))) AS std_error
 FROM newton n JOIN cells c ON {same} WHERE c.n1 > 0 AND c.n0 > 0 AND n.step = 60 GROUP BY {nby}, n.b),
results AS (
 SELECT {", ".join(f"m.{k}" for k in keys)}, n.estimate, n.std_error, n.estimate / n.std_error AS statistic,
  exp(n.estimate) AS "or", exp(n.estimate - 1.96 * n.std_error) AS or_low,
  exp(n.estimate + 1.96 * n.std_error) AS or_high,
  {P_VALUE.format(z='(n.estimate / n.std_error)')} AS p_value,
  CAST(m.n_cases AS BIGINT) AS n_cases, CAST(m.n_informative AS BIGINT) AS n_informative,
  n.estimate IS NOT NULL AS converged
 FROM models m LEFT JOIN fitted n ON {same.replace('c.', 'm.')})"""


RESULT_VALUES = """round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(statistic, 6) AS statistic,
 round("or", 6) AS "or", round(or_low, 6) AS or_low, round(or_high, 6) AS or_high, round(p_value, 6) AS p_value,
 n_cases, n_informative, converged"""
