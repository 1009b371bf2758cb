"""Run registered queries against their SQL on DuckDB: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=str)


def compare(spark_df, con, sql):
    """(rows, message) - an empty message means the two agree."""
    cur = con.execute(sql)
    names, theirs = [d[0] for d in cur.description], cur.fetchall()
    ours = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return len(ours), f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = canonical(spark_df.columns, ours), canonical(names, theirs)
    if len(a) != len(b):
        return len(ours), f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    # Numbers must have the same Python type as well, as the text above tells 1 from 1.0.
    return len(ours), f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main(argv):
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not argv[1:] or any(n == a or n.startswith(a) for a in argv[1:])]
    failed = 0
    for name in wanted:
        t = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sqls:
                n, message = compare(df, con, sqls[name])
            else:
                n, message = len(df.collect()), ""
        except Exception as e:  # report and go on
            n, message = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(message)
        state = "FAIL" if message else ("ok" if name in sqls else "ok (rows only)")
        print(f"{state:<15}{name:<28}{n:>8} rows {time.time() - t:6.1f}s  {message}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
