"""Runs registered queries beside their DuckDB oracles: ``python tests/compare.py SF_DIR [NAME...]``."""

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((repr(tuple(norm(r[i]) for i in order)) for r in rows))


def differences(df, con, sql):
    """Empty if the Spark rows equal the oracle's; else what differs."""
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
        return f"{len(ours[1])} and {len(theirs[1])} rows; ours only {sorted(a)[:3]}; theirs only {sorted(b)[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from subtide.session import get_spark

    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, all_queries = connect(sf), e.oracle_sql(), e.queries()
    bad = 0
    for name in names or all_queries:
        t = time.time()
        try:
            df = all_queries[name](spark, sf)
            said = differences(df, con, sqls[name]) if name in sqls else f"no oracle, {df.count()} rows"
        except Exception as x:
            said = f"ERROR {str(x)[:1500]}"
        bad += bool(said) and not said.startswith("no oracle")
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bool(bad))
