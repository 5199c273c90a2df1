"""Compares registered queries with their SQL twins in DuckDB.

    python tests/oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, (float, decimal.Decimal)):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return f"f{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return f"t{value.isoformat()}"
    return f"s{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(canonical(row[i]) for i in order) for row in rows)


KINDS = {
    "int": ("tinyint", "smallint", "integer", "bigint", "int", "uinteger", "utinyint"),
    "float": ("double", "float"),
    "text": ("varchar", "string"),
    "bool": ("boolean",),
}


def kind_of(name):
    name = name.lower()
    return next((k for k, names in KINDS.items() if name in names), name)


def type_problem(df, con, sql):
    """Columns whose type class differs between both sides."""
    theirs = {r[0]: kind_of(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    mine = {f.name: kind_of(f.dataType.simpleString()) for f in df.schema.fields}
    wrong = {c: (mine[c], theirs.get(c)) for c in mine if mine[c] != theirs.get(c)}
    return f"types {wrong}" if wrong else None


def compare(df, con, sql):
    """None when equal, otherwise a short text with the difference."""
    problem = type_problem(df, con, sql)
    if problem:
        return problem
    mine = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, mine), rows_of(columns, theirs)
    if a == b:
        return None
    extra = [r for r in a if r not in set(b)][:2]
    lost = [r for r in b if r not in set(a)][:2]
    return f"{len(a)} rows vs {len(b)}; only here {extra}; only there {lost}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                count = ""
                if not problem:
                    count = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]
            else:
                problem, count = None, f"{df.count()} (no twin)"
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - start:.1f}s {count} {problem or ''}",
              flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
