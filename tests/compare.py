"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normalised(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def compare(frame, con, sql: str) -> tuple[bool, int, str]:
    left_columns, left = normalised(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    right_columns, right = normalised([d[0] for d in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return False, len(left), f"columns {left_columns} / {right_columns}"
    if left == right:
        return True, len(left), ""
    only_left = sorted(set(left) - set(right), key=repr)[:3]
    only_right = sorted(set(right) - set(left), key=repr)[:3]
    return False, len(left), f"{len(left)}/{len(right)} rows; spark {only_left}; sql {only_right}"


def main() -> None:
    import __spark_entry__ as entry
    from loomdex.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            if name in sqls:
                ok, rows, detail = compare(fn(spark, sf_dir), con, sqls[name])
            else:
                ok, rows, detail = True, len(fn(spark, sf_dir).collect()), "rows only"
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            ok, rows, detail = False, -1, f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{'ok  ' if ok and rows else 'FAIL'} {name:32} rows={rows:<7} {time.time() - start:5.1f}s {detail}", flush=True)


if __name__ == "__main__":
    main()
