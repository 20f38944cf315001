"""Runs registered queries and their SQL twins side by side and compares values.

python tests/check_oracle.py [folder] [name ...]
"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import duckdb

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder):
    con = duckdb.connect()
    for name in GIVEN.split():
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(repr(r[i]) for i in order) for r in rows])


def compare(spark, con, name, make, sql, folder):
    """Empty text when equal, else what differs."""
    df = make(spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = table([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = sorted(set(got[1]) - set(want[1]))[:2]
        missing = sorted(set(want[1]) - set(got[1]))[:2]
        return f"{len(got[1])} rows != {len(want[1])} rows\n  spark only {extra}\n  sql only   {missing}"
    return ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tallyscan.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(queries())
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries()[name], oracle_sql()[name], folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if 'FATAL' in problem or 'INTERNAL' in problem:
            con = connect(folder)
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
