"""Compare registered queries with their SQL, run by DuckDB on the same files.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql) -> str:
    """Empty when the two results are the same multiset of rows."""
    mine = rows_by_name(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    theirs = rows_by_name([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] == theirs[1]:
        return ""
    only_mine, only_theirs = mine[1] - theirs[1], theirs[1] - mine[1]
    return (
        f"{sum(mine[1].values())} rows against {sum(theirs[1].values())}; only Spark ({sum(only_mine.values())}): "
        f"{list(only_mine)[:2]}; only SQL ({sum(only_theirs.values())}): {list(only_theirs)[:2]}"
    )


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tracehold.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(folder), entry.queries(), entry.oracle_sql()
    names, bad = sys.argv[2:] or list(queries), 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                verdict = problem or f"same, {df.count() if not problem else 0} rows"
                bad += bool(problem)
            else:
                verdict = f"{df.count()} rows (no SQL)"
        except Exception as error:  # keep going: this is a report
            verdict, bad = f"ERROR {type(error).__name__}: {str(error)[:1500]}", bad + 1
        print(f"{name}: {verdict} [{time.time() - start:.1f}s]", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
