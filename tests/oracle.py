"""Compare registered queries with their SQL twins in DuckDB.

Run as a script: ``python tests/oracle.py [folder] [name-prefix ...]``.
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from suite.base import BASE  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (v if not v.is_integer() else float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    if hasattr(v, "as_py"):
        return v.as_py()
    return v


def rows_of(table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    types = []
    for n in names:
        t = str(table.schema.field(n).type).replace("large_", "")
        types.append("timestamp" if t.startswith("timestamp") else t)
    cols = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_norm(v) for v in r) for r in zip(*cols)] if cols else []
    return names, types, sorted(rows, key=repr)


def compare(spark, con, folder: str, fn, sql: str) -> str:
    """Empty text when equal, else what differs."""
    got = rows_of(fn(spark, folder).toArrow())
    result = con.execute(sql)
    table = result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.fetch_arrow_table()
    want = rows_of(table)
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[2]) != len(want[2]):
        return f"rows {len(got[2])} != {len(want[2])}"
    for a, b in zip(got[2], want[2]):
        if a != b:
            return f"value {a} != {b}"
    if got[1] != want[1]:
        diff = [(n, a, b) for n, a, b in zip(got[0], got[1], want[1]) if a != b]
        return f"types {diff}"
    return "" if want[2] else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from furrow import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(p.lower() for p in sys.argv[2:])
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.lower().startswith(prefixes):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                note = compare(spark, con, folder, fn, oracles[name])
            else:
                n = len(fn(spark, folder).toArrow())
                note = "" if n else "no rows"
                note = note or f"(rows only: {n})"
                if not note.startswith("no"):
                    print(f"ok   {name} {note} {time.time() - t0:.1f}s", flush=True)
                    continue
        except Exception as e:  # report and go on
            note = f"{type(e).__name__}: {str(e)[:700]}"
        if note:
            bad += 1
            print(f"FAIL {name} {time.time() - t0:.1f}s {note}", flush=True)
        else:
            print(f"ok   {name} {time.time() - t0:.1f}s", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
