"""Run every registered query against its SQL: python tests/compare.py [folder] [names...]."""

import sys
import time
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(got, want):
    """None if equal, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = normal(got), normal(want)
    for c in got.columns:
        a, b = got[c].to_numpy(), want[c].to_numpy()
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            a, b = a.astype(float), b.astype(float)
            bad = ~((a == b) | (np.isnan(a) & np.isnan(b)))
        else:
            bad = a != b
        if bad.any():
            at = int(np.flatnonzero(bad)[0])
            return f"{c}: {int(bad.sum())} values, first {a[at]!r} / {b[at]!r}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conforank.storage import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        t = time.time()
        try:
            got = entry.queries()[name](spark, folder).toPandas()
            t1 = time.time()
            sql = entry.oracle_sql().get(name)
            problem = None if sql is None else difference(got, con.execute(sql).fetch_df())
        except Exception as error:  # reported, not hidden
            got, t1, problem = [], time.time(), f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28} {len(got):7} rows {t1 - t:6.2f}s sql {time.time() - t1:5.2f}s {problem or 'ok'}", flush=True)
    print("failed:", failed)
