"""Run a registered query on Spark and its SQL on DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark, query, folder: str, db) -> str | None:
    """None when both results agree, else a short description."""
    frame = query.run(spark, folder)
    got = table(frame.columns, frame.collect())
    cursor = db.execute(query.sql)
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        a, b = set(got[1]), set(want[1])
        return f"{len(got[1])} rows against {len(want[1])}; only here {list(a - b)[:2]}, only there {list(b - a)[:2]}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if repr(g) != repr(w)]
    return f"{len(wrong)} of {len(want[1])} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    from tunefathom.queries import load
    from tunefathom.session import build_session
    folder, *patterns = sys.argv[1:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    db = database(folder)
    bad = 0
    for name, q in load().items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        start = time.time()
        try:
            if q.sql:
                problem = difference(spark, q, folder, db)
                note = "ok" if problem is None else "DIFF " + problem
            else:
                note = f"rows-only {q.run(spark, folder).count()}"
        except Exception as exc:  # report and go on with the next query
            note = f"FAIL {type(exc).__name__}: {str(exc)[:700]}"
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{name:34s} {time.time() - start:6.2f}s {note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
