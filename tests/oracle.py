"""Compare registered queries with their SQL twins in DuckDB.

Run as a script for a report: ``python tests/oracle.py FOLDER [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value if value is None else str(value)


_KINDS = {
    "bigint": "int64", "int": "int32", "double": "double", "string": "varchar", "boolean": "bool",
    "timestamp_ntz": "timestamp", "date": "date", "float": "float", "smallint": "int16",
}
_DUCK = {
    "BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "varchar", "BOOLEAN": "bool",
    "TIMESTAMP": "timestamp", "DATE": "date", "FLOAT": "float", "HUGEINT": "hugeint", "SMALLINT": "int16",
}


def compare(df, con, sql: str) -> str:
    """Empty text when equal, else what differs."""
    rel = con.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(rel.columns):
        return f"columns {columns} vs {sorted(rel.columns)}"
    kinds = {c: _KINDS.get(t, t) for c, t in df.dtypes}
    duck = {c: _DUCK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    typed = [f"{c}: {kinds[c]} vs {duck[c]}" for c in columns if kinds[c] != duck[c]]
    pick = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(_plain(r[i]) for i in pick) for r in rel.fetchall())
    have = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    note = ("types " + "; ".join(typed) + " ") if typed else ""
    if want != have:
        extra, missing = list((have - want).items())[:2], list((want - have).items())[:2]
        return (
            f"{note}rows {sum(have.values())} vs {sum(want.values())}; "
            f"differing {sum((have - want).values())}; spark only {extra}; sql only {missing}"
        )
    if not want:
        return note + "empty result"
    return note


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from rainweave.session import build_session

    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, fns, sqls, bad = connect(folder), entry.queries(), entry.oracle_sql(), 0
    chosen = [n for n in fns if not names or any(p in n for p in names)]
    for name in chosen:
        start = time.time()
        try:
            df = fns[name](spark, folder)
            if name in sqls:
                result = compare(df, con, sqls[name])
            else:
                rows = df.count()
                result = "" if rows else "no rows"
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(result)
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok ' if not result else 'BAD'} {time.time() - start:6.2f}s {kind:4s} {name} {result}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} fine")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
