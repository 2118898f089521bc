"""Run registered queries and their DuckDB SQL side by side.

    python tools/compare.py [folder] [name ...]
"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fraudwatch.catalog import ORACLES, QUERIES  # noqa: E402
from fraudwatch.session import local_session  # noqa: E402


def tables(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def rows_of(columns, rows):
    """Rows with columns sorted by name, as a sorted list of texts."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(normal(row[i]) for i in order)) for row in rows)


def compare(spark, con, folder, name):
    frame = QUERIES[name](spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        return len(ours), None, ""
    relation = con.sql(ORACLES[name])
    columns = relation.columns
    if sorted(columns) != sorted(frame.columns):
        return len(ours), False, f"columns {sorted(frame.columns)} against {sorted(columns)}"
    theirs = rows_of(columns, relation.fetchall())
    if ours == theirs:
        return len(ours), True, ""
    only = [r for r in ours if r not in set(theirs)][:2], [r for r in theirs if r not in set(ours)][:2]
    return len(ours), False, f"{len(theirs)} rows expected; ours only {only[0]}; expected only {only[1]}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == x or n.startswith(x + "_") for x in names)]
    spark, con = local_session(8), tables(folder)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            count, same, note = compare(spark, con, folder, name)
        except Exception as error:  # show every query's outcome
            count, same, note = 0, False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += same is False
        state = {True: "ok", None: "rows", False: "FAIL"}[same]
        print(f"{state:5} {name:28} {count:8} rows {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    sys.exit(bool(failed))
