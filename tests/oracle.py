"""Compare registered queries with their SQL on DuckDB: `python tests/oracle.py [sf] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when both engines agree, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got_columns, got = _table(df.columns, [tuple(x) for x in df.collect()])
    result = con.execute(sql)
    want_columns, want = _table([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{got_columns}: {a} != {b} ({sum(x != y for x, y in zip(got, want))} of {len(got)} rows)"
    return None


def main() -> int:
    from rankfold.plans import REGISTRY, SQL
    from rankfold.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(REGISTRY)
    sf_dir = str(DATA / f"sf{sf}")
    spark = get_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                 "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in SQL:
                note = compare(spark, con, REGISTRY[name], SQL[name], sf_dir)
            else:
                rows = REGISTRY[name](spark, sf_dir).count()
                note = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            note = f"{type(error).__name__}: {str(error)[:600]}"
        bad += note is not None
        print(f"{'ok  ' if note is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              f"{'' if name in SQL else ' (rows only)'}{'' if note is None else '  ' + note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
