"""Run queries against their SQL twins: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v) + 0.0:.9g}"
        return str(v)

    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, query, sql: str) -> str:
    """Empty when both give the same table, else what differs."""
    frame = query(spark, sf)
    ours = [tuple(r) for r in frame.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = canonical(ours, frame.columns), canonical(theirs, names)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, e.g. {wrong[0]}" if wrong else ""


def main() -> None:
    from oracle.sql import ORACLE_SQL
    from wireloom.plans.queries import QUERIES
    from wireloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLE_SQL:
                verdict = compare(spark, con, sf, QUERIES[name], ORACLE_SQL[name])
                note = f"oracle, {len(con.execute(ORACLE_SQL[name]).fetchall())} rows"
            else:
                note, verdict = f"{QUERIES[name](spark, sf).count()} rows", ""
        except Exception as error:  # report and go on with the next query
            verdict, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += bool(verdict)
        print(f"{'FAIL' if verdict else 'ok  '} {name:24s} {time.time() - start:6.1f}s {note} {verdict[:900]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
