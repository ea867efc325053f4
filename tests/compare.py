"""Run registered queries next to their SQL twins and compare the rows.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb
import pandas as pd

from tallyloom.plans.catalog import all_oracles, all_queries
from tallyloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    return str(v) if not isinstance(v, float) else repr(v)


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    cols = [[v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in c] for c in cols]
    return sorted((tuple(_value(v) for v in r) for r in zip(*cols)), key=repr)


def types(table) -> dict[str, str]:
    def kind(t) -> str:
        s = str(t).replace("large_", "")
        return "timestamp" if s.startswith("timestamp") else s

    return {f.name: kind(f.type) for f in table.schema}


def compare(mine, con, statement: str) -> tuple[bool, str]:

    theirs = con.sql(statement).to_arrow_table()
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return False, f"columns {sorted(mine.column_names)} / {sorted(theirs.column_names)}"
    note = ""
    a_types, b_types = types(mine), types(theirs)
    diff = {c: (a_types[c], b_types[c]) for c in a_types if a_types[c] != b_types[c]}
    if diff:
        note = f" types {diff}"
    a, b = rows(mine), rows(theirs)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b), key=repr)[:2], sorted(set(b) - set(a), key=repr)[:2]
        return False, f"{len(a)} / {len(b)} rows\n   spark {only_a}\n   sql   {only_b}{note}"
    return not diff, f"{len(a)} rows{note}"


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("--sf", default="0.01")
    args = p.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("compare")
    con = connect(sf_dir)
    queries, oracles = all_queries(), all_oracles()
    bad = 0
    for name in args.names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            rows_table = df.toArrow()
            spent = time.time() - t
            if name in oracles:
                ok, note = compare(rows_table, con, oracles[name])
            else:
                ok, note = True, f"{rows_table.num_rows} rows (no SQL twin)"
        except Exception as e:  # report and go on with the next query
            ok, note, spent = False, f"{type(e).__name__}: {str(e)[:1500]}", time.time() - t
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {spent:.1f}s + {time.time() - t - spent:.1f}s {note}", flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
