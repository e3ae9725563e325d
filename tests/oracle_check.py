"""Compare registered queries with their SQL in DuckDB: python tests/oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, con, name: str, sf: str) -> str:
    start = time.time()
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted((tuple(norm(v) for v in r) for r in df.select(cols).collect()), key=repr)
    spent = time.time() - start
    text = oracle_sql().get(name)
    if text is None:
        return f"rows-only {len(ours)} rows {spent:.1f}s"
    start = time.time()
    rel = con.sql(text)
    if sorted(rel.columns) != cols:
        return f"MISMATCH columns {cols} vs {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    if ours == theirs:
        return f"ok {len(ours)} rows spark {spent:.1f}s duckdb {time.time() - start:.1f}s"
    left, right = set(ours), set(theirs)
    only, missing = [r for r in ours if r not in right][:3], [r for r in theirs if r not in left][:3]
    return f"MISMATCH {len(ours)} vs {len(theirs)} rows; only ours {only}; only theirs {missing}"


def main() -> None:
    from codelode.session import local_session

    sf, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark, con = local_session(), duck(sf)
    for name in names:
        try:
            print(name, compare(spark, con, name, sf), flush=True)
        except Exception as error:  # report and go on with the next query
            print(name, "ERROR", str(error)[:600], flush=True)


if __name__ == "__main__":
    main()
