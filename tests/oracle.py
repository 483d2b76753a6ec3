"""Compare a registered query with its SQL in DuckDB: columns, types, rows, values.

Run as a script: python tests/oracle.py <sf_dir> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is not None, v) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=0, abs_tol=1e-12)
    return a == b


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cols = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({sql}) q")
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE SELECT * FROM ({sql}) q").fetchall()}
    if sorted(types) != cols:
        return f"columns {cols} != {sorted(types)}"
    for c, t in df.dtypes:
        if TYPES.get(t) != types[c]:
            return f"type of {c}: {t} != {types[c]}"
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({sql}) q")
    want = sorted(cur.fetchall(), key=key)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(same(a, b) for a, b in zip(g, w))]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main() -> None:
    from jurispark import get_session
    from __spark_entry__ import oracle_sql, queries

    QUERIES, ORACLES = queries(), oracle_sql()
    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLES:
                rows = df.count() if "-v" in sys.argv else ""
                out = compare(df, con, ORACLES[name]) or f"ok {rows}"
            else:
                out = f"rows {df.count()}"
        except Exception as e:  # report and go on with the next query
            out = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {out}", flush=True)


if __name__ == "__main__":
    main()
