"""Compare registered queries with their SQL; `python tests/compare.py [folder] [names...]`."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def difference(spark, con, query, sql, folder) -> tuple[str, int]:
    """('' where equal, number of rows)"""
    return frame_difference(query(spark, folder), con, sql)


def frame_difference(df, con, sql) -> tuple[str, int]:
    got = shape(df.columns, df.collect())
    cur = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = shape([d[0] for d in cur.description], cur.fetchall())
    other = {c: (k, kinds.get(c)) for c, k in df.dtypes if KINDS.get(k, k) != kinds.get(c)}
    if other:
        return f"types {other}", len(got[1])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(got[1])
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first\n   spark {str(bad[0][0])[:600]}\n   duck  {str(bad[0][1])[:600]}", len(got[1])
    return "", len(got[1])


def main() -> None:
    import __spark_entry__ as entry
    from basketwise.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false",
                              "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem, n = difference(spark, con, query, sqls[name], folder)
            else:
                problem, n = "", len(query(spark, folder).collect())
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        mark = "ok  " if not problem else "FAIL"
        print(f"{mark} {name} rows={n} {time.time() - start:.2f}s {'' if name in sqls else '(no sql)'} {problem}", flush=True)


if __name__ == "__main__":
    main()
