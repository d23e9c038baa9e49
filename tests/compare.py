"""Run registered queries against their check SQL: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

KINDS = {
    "bigint": ["BIGINT"],
    "int": ["INTEGER"],
    "double": ["DOUBLE"],
    "string": ["VARCHAR"],
    "boolean": ["BOOLEAN"],
    "timestamp_ntz": ["TIMESTAMP"],
    "date": ["DATE"],
}


def connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, (int, float)):
        return ("n", float(x))
    return (type(x).__name__, str(x))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([_cell(row[i]) for i in order]) for row in rows)


def compare(df, con, sql):
    """Differences as text, empty when equal; and the number of rows."""
    rows = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    other = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(set(df.columns) ^ set(names))}", len(rows)
    kinds = {d[0]: str(d[1]) for d in result.description}
    wrong = [
        (f.name, f.dataType.simpleString(), kinds[f.name])
        for f in df.schema.fields
        if kinds[f.name] not in KINDS.get(f.dataType.simpleString(), [kinds[f.name]])
    ]
    if wrong:
        return f"types differ: {wrong}", len(rows)
    mine, theirs = normal(df.columns, rows), normal(names, other)
    if mine == theirs:
        return "", len(rows)
    extra = [x for x in mine if x not in set(theirs)][:2]
    missing = [x for x in theirs if x not in set(mine)][:2]
    return f"{len(mine)} rows against {len(theirs)}; only here {extra}; only there {missing}", len(rows)


def main() -> None:
    import __spark_entry__ as e
    from tallyscope.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connection(folder)
    queries, checks = e.queries(), e.oracle_sql()
    bad = 0
    for name in args[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in checks:
                problem, rows = compare(df, con, checks[name])
            else:
                problem, rows = "", len(df.collect())
        except Exception:
            problem, rows = traceback.format_exc(limit=4)[-1500:], -1
        kind = "check" if name in checks else "rows "
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} rows={rows} {time.time() - start:.1f}s {problem}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
