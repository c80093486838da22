"""Compares a registered query with its SQL on the same Parquet files."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "isoformat"):
        return str(value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def kind(type_name: str) -> str:
    t = type_name.lower()
    for family, names in {
        "int": ("bigint", "integer", "int", "long", "hugeint", "smallint", "tinyint"),
        "float": ("double", "float"),
        "text": ("varchar", "string"),
        "time": ("timestamp", "timestamp_ntz"),
        "bool": ("boolean",),
    }.items():
        if t in names:
            return family
    return t


def connect(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in glob.glob(f"{path}/*.parquet"):
        name = os.path.basename(file)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def differences(df, con, sql: str) -> list[str]:
    """What differs between the Spark result and the SQL result; empty when nothing does."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: kind(str(d[1])) for d in cursor.description}
    expected = cursor.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} but SQL has {sorted(names)}"]
    for name, spark_type in df.dtypes:
        if kind(spark_type) != types[name]:
            problems.append(f"type of {name}: {spark_type} but SQL has {types[name]}")
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    want = sorted((tuple(normal(r[i]) for i in at) for r in expected), key=repr)
    got = sorted((tuple(normal(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if len(want) != len(got):
        problems.append(f"{len(got)} rows but SQL has {len(want)}")
    if want != got:
        wrong = [(g, w) for g, w in zip(got, want) if g != w][:2]
        problems.append(f"columns {columns}: first differences {wrong}")
    return problems


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    from estatelake.registry import load
    from estatelake.session import build_session

    path = os.environ.get("SF", "/root/testdata/sf0.001")
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(path)
    wanted = sys.argv[1:]
    failed = 0
    for name, entry in load().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = entry.run(spark, path)
            if entry.sql:
                found = differences(df, con, entry.sql)
            else:
                found = [] if df.count() >= 0 else []
                name += " (no sql)"
            rows = len(con.execute(entry.sql).fetchall()) if entry.sql and not found else "?"
        except Exception as e:
            found, rows = [f"{type(e).__name__}: {str(e)[:600]}"], "?"
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} rows={rows} {time.time() - start:.1f}s", *found, sep="\n      " if found else " ", flush=True)
    print("failed:", failed)
