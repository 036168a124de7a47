"""Compare every registered query with its SQL on a small scale: python tests/oracle.py [names]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def key(row):
    return tuple((0, "") if v is None else (1, f"{v:.6f}") if isinstance(v, float) else (2, str(v)) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1.1e-6 * max(1.0, abs(a))
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b)


def compare(spark, name, query, sql, sf_dir):
    """None, or what differs."""
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size = '4GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql)
    cols = [c[0] for c in want.description]
    want = want.fetchall()
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(cols):
        return f"columns {df.columns} {cols}"
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if len(got) != len(want):
        return f"rows {len(got)} {len(want)}"
    bad = [(a, b) for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True) if not all(same(x, y) for x, y in zip(a, b, strict=True))]
    exact = sum(a != b for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
    return f"{len(bad)} of {len(got)} rows ({exact} not exact), as {bad[0]} {cols}" if bad else None if not exact else f"exact: {exact} rows differ in the last digit"


def main(names):
    import __spark_entry__ as e
    from tessera.session import local_session

    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    for name in names or [n for n in q if n in o]:
        t = time.time()
        try:
            said = compare(spark, name, q[name], o[name], os.environ.get("SF", "/root/testdata/sf0.01"))
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
