"""Run registered queries and their SQL side by side and compare the rows.

    python -m workload.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """One form for equal values of both engines."""
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(type_name: str) -> str:
    text = type_name.lower()
    if text in ("int", "integer", "bigint", "long"):
        return text.replace("long", "bigint").replace("integer", "int")
    return {"varchar": "string", "bool": "boolean"}.get(text, text)


def compare(spark, con, sf_dir: str, query, text: str) -> list[str]:
    """Differences between the query's rows and the rows of its SQL; empty when they agree."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = con.sql(text)
    found = sorted(relation.columns)
    if columns != found:
        return [f"columns {columns} != {found}"]
    types = dict(zip(relation.columns, map(str, relation.types)))
    problems = [
        f"type of {name}: {spark_type} != {types[name]}"
        for name, spark_type in df.dtypes
        if kind(spark_type) != kind(types[name])
    ]
    order = [relation.columns.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    if rows != expected:
        only_spark, only_sql = rows - expected, expected - rows
        problems.append(
            f"{sum(rows.values())} rows, SQL {sum(expected.values())}; differ {sum(only_spark.values())}/{sum(only_sql.values())}"
        )
        problems += [f"  spark {r}" for r in sorted(only_spark, key=str)[:3]] + [f"  sql   {r}" for r in sorted(only_sql, key=str)[:3]]
    if not rows:
        problems.append("no rows")
    return problems


def main() -> None:
    from heatstrata.session import local_session
    from workload import registry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in args.names or registry.QUERIES:
        start = time.time()
        if name not in registry.ORACLES:
            print(f"{name:28s} rows {registry.QUERIES[name](spark, sf_dir).count()} (no SQL)", flush=True)
            continue
        try:
            problems = compare(spark, con, sf_dir, registry.QUERIES[name], registry.ORACLES[name])
        except Exception as e:  # report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(problems)
        print(f"{name:28s} {'DIFFERS' if problems else 'ok':8s} {time.time() - start:6.2f}s", *problems, sep="\n    " if problems else " ", flush=True)
    print("differing queries:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
