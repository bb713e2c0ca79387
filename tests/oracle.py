"""Run registered queries in Spark and DuckDB and compare them as bags of rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return "0.0" if v == 0 else repr(float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


# Spark type names against DuckDB's, where a driver that compares schemas would see a difference.
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "float": "FLOAT"}


def compare(df, con, sql: str) -> str:
    """Empty string when equal, else what differs."""
    rel = con.sql(sql)
    ours, theirs = sorted(df.columns), sorted(rel.columns)
    if ours != theirs:
        return f"columns {ours} / {theirs}"
    kinds = dict(zip(rel.columns, (str(t) for t in rel.types)))
    odd = [f"{n}: {t}/{kinds[n]}" for n, t in df.dtypes if t in SAME and SAME[t] != kinds[n]]
    a = sorted((str([plain(row[c]) for c in ours]) for row in df.collect()))
    order = [rel.columns.index(c) for c in ours]
    b = sorted(str([plain(row[i]) for i in order]) for row in rel.fetchall())
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}"
    return f"types {odd}" if odd else ""


def main(argv):
    from risklattice.plans import ORACLES, QUERIES
    from risklattice.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con, bad = local_session(8), connect(sf), 0
    for key, fn in QUERIES.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if key in ORACLES:
                problem = compare(df, con, ORACLES[key])
                note = "ok" if not problem else "DIFFERS " + problem[:600]
            else:
                problem, note = "", f"rows {len(df.collect())} (no oracle)"
        except Exception as e:  # noqa: BLE001
            problem, note = "error", f"ERROR {type(e).__name__}: {str(e)[:900]}"
        bad += bool(problem)
        print(f"{time.time() - start:6.1f}s {key}: {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
