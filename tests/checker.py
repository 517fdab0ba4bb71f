"""Run registered queries against their SQL twins in DuckDB and report differences."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, list):
        return repr([_cell(x) for x in v])
    return None if v is None else str(v)


def spark_rows(df):
    table = df.toArrow()
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(_cell(v) or "" for v in r) for r in zip(*cols))


SAME_TYPE = {
    "BIGINT": "bigint", "DOUBLE": "double", "DATE": "date", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int",
}


def type_mismatches(df, con, sql):
    """Columns whose Spark type is not the counterpart of the DuckDB type."""
    spark_types = dict(df.dtypes)
    rows = con.execute(f"DESCRIBE {sql}").fetchall()
    return [(r[0], spark_types.get(r[0]), r[1]) for r in rows if SAME_TYPE.get(r[1]) != spark_types.get(r[0])]


def duck_rows(con, sql):
    cur = con.execute(sql)
    raw = [d[0] for d in cur.description]
    order = sorted(range(len(raw)), key=lambda i: raw[i])
    rows = cur.fetchall()
    return [raw[i] for i in order], sorted(tuple(_cell(r[i]) or "" for i in order) for r in rows)


def compare(entry, spark, con, sf_dir: str):
    """(status, detail, seconds) of one query."""
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    names, got = spark_rows(df)
    took = time.time() - t0
    sql = entry.oracle()
    if sql is None:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows", took
    wrong = type_mismatches(df, con, sql)
    if wrong:
        return "TYPES", str(wrong), took
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return "SCHEMA", f"{names} vs {want_names}", took
    if got == want:
        return ("ok" if got else "EMPTY"), f"{len(got)} rows", took
    a, b = set(got) - set(want), set(want) - set(got)
    return "DIFF", f"rows {len(got)}/{len(want)} diff {len(a)}/{len(b)}\n   spark {sorted(a)[:2]}\n   duck  {sorted(b)[:2]}", took


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-tests-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from factorlab.catalog import ENTRIES

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark, con = session(), connect(sf)
    bad = []
    for name, e in ENTRIES.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            status, detail, took = compare(e, spark, con, sf)
        except Exception as ex:  # noqa: BLE001
            status, detail, took = "ERROR", f"{type(ex).__name__}: {str(ex)[:600]}", 0.0
        if status not in ("ok", "rows"):
            bad.append(name)
        print(f"{status:7s} {name:32s} {took:6.1f}s {detail}", flush=True)
    print("BAD", len(bad), " ".join(bad))
