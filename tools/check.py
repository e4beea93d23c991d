"""Run registered queries and their SQL on the same tables and compare the rows.

    python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from emberline.catalog import load  # noqa: E402
from emberline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else f"{type(r[i]).__name__}:{r[i]}" for i in order) for r in rows)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    catalog = load()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{opts.sf}/{t}.parquet'")
    bad = 0
    for name in opts.names or catalog.queries:
        begin = time.time()
        try:
            df = catalog.queries[name](spark, opts.sf)
            got = [tuple(r) for r in df.collect()]
            spent = time.time() - begin
            note = "rows only"
            ok = True
            if name in catalog.sql:
                cur = con.execute(catalog.sql[name])
                columns = [d[0] for d in cur.description]
                want = cur.fetchall()
                ok = sorted(columns) == sorted(df.columns)
                a, b = canonical(df.columns, got), canonical(columns, want)
                ok = ok and a == b
                note = "equal" if ok else f"DIFFERENT: {len(a)} rows against {len(b)}; columns {df.columns} {columns}"
                if not ok:
                    only_a = [x for x in a if x not in set(b)][:2]
                    only_b = [x for x in b if x not in set(a)][:2]
                    note += f"\n   spark {only_a}\n   sql   {only_b}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok, spent, note, got = False, time.time() - begin, f"ERROR {type(error).__name__}: {str(error)[:600]}", []
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {len(got):7d} rows {spent:6.2f}s  {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
