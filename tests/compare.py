"""Run a registered query and its SQL and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _canon(x)) for k, x in v.items()))
    return v


def rows_of(table, names):
    cols = {n: table.column(n).to_pylist() for n in table.column_names}
    order = sorted(names)
    return sorted((tuple(_canon(cols[n][i]) for n in order) for i in range(table.num_rows)), key=repr)


def compare(con, df, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    got = df.toArrow()
    want = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    kinds = lambda t: {f.name: ("int" if "int" in str(f.type) else "str" if "string" in str(f.type) else str(f.type)) for f in t.schema}
    if kinds(got) != kinds(want):
        return f"types {kinds(got)} != {kinds(want)}"
    a, b = rows_of(got, got.column_names), rows_of(want, want.column_names)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            bad = sum(1 for p, q in zip(a, b) if p != q)
            return f"{bad} of {len(a)} rows differ, first {x} != {y}"
    return None


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            note = compare(con, df, sql) if sql else f"rows only: {len(df.toArrow())}"
        except Exception as e:  # report and go on
            sql, note = "error", f"{type(e).__name__}: {str(e)[:1500]}"
        ok = note is None or sql is None
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - started:.2f}s {note or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = next((a for a in args if a.startswith("/")), "/root/testdata/sf0.01")
    sys.exit(main([a for a in args if not a.startswith("/")], sf))
