"""Compare queries with their expected results: ``check.py [folder] [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

from cellzonal.session import local_session
from workload.queries import ORACLES, QUERIES
from workload.tables import GIVEN


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in GIVEN:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return db


def canonical(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    names = sorted(df.columns)
    rows = [tuple(plain(v) for v in row) for row in df[names].itertuples(index=False, name=None)]
    return [tuple(names)] + sorted(rows, key=repr)


# Spark type to the DuckDB type that holds the same values.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def type_differences(df, db, name: str) -> list[str]:
    wanted = {r[0]: r[1] for r in db.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    return [
        f"{c}: {spark_type} vs {wanted.get(c)}"
        for c, spark_type in df.dtypes
        if SAME_TYPE.get(spark_type, spark_type) != wanted.get(c)
    ]


def compare(spark, db, sf: str, name: str) -> tuple[bool, str]:
    start = time.time()
    result = QUERIES[name](spark, sf)
    actual = result.toPandas().astype(object)
    took = time.time() - start
    if name not in ORACLES:
        return False, f"{len(actual)} rows, no oracle, {took:.1f}s"
    start = time.time()
    wanted = db.execute(ORACLES[name]).fetchdf().astype(object)
    a, w = canonical(actual), canonical(wanted)
    note = f"{len(actual)} rows, {took:.1f}s (oracle {time.time() - start:.1f}s)"
    differences = type_differences(result, db, name)
    if differences:
        return False, f"types differ: {differences}"
    if a == w:
        return len(actual) > 0, note + ("" if len(actual) else " EMPTY")
    bad = [(x, y) for x, y in zip(a, w) if x != y][:2]
    return False, f"{note} wanted {len(wanted)} rows; {a[0]} vs {w[0]}; {bad}"


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf)
    failed = []
    for name in args or QUERIES:
        try:
            ok, note = compare(spark, db, sf, name)
        except Exception:
            ok, note = False, traceback.format_exc(limit=-2)[-1500:]
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
