"""Run registered queries and their SQL side by side: python -m tests.oracle_check [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else v)
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(
        (tuple(_plain(r[k]) for k in order) for r in rows), key=repr
    )


def compare(spark, con, sf_dir: str, run, sql: str) -> tuple[bool, str]:
    """Exact: same column names, same value types, same rows."""
    got = run(spark, sf_dir)
    got_columns, got_rows = _table(got.columns, [tuple(r) for r in got.collect()])
    want = con.execute(sql)
    want_columns, want_rows = _table([c[0] for c in want.description], want.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if len(got_rows) != len(want_rows):
        return False, f"{len(got_rows)} rows != {len(want_rows)}"
    for a, b in zip(got_rows, want_rows, strict=True):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(got_columns, a, b, strict=True) if x != y]
            return False, f"{bad} in {a}"
    return True, f"{len(got_rows)} rows"


def main(argv):
    import __spark_entry__ as entry

    from latewin import build_session

    spark = build_session(
        "local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{argv[0] if argv else 'sf0.01'}"
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name, run in queries.items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        start = time.time()
        try:
            if name in sql:
                ok, note = compare(spark, con, sf_dir, run, sql[name])
            else:
                ok, note = True, f"{run(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
