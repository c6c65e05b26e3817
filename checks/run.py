"""Run every query and compare it with its SQL: ``python -m checks.run [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks import flows  # registers its queries
from checks.catalog import QUERIES
from checks.oracle_flows import ORACLES
from tollgate.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(0.0 if value == 0 else value)
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got = rows_of(df.columns, df.collect())
            took = time.time() - began
            if name not in ORACLES:
                print(f"{name:28s} rows-only {len(got[1]):7d}  {took:6.2f}s", flush=True)
                continue
            cursor = con.execute(ORACLES[name])
            want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
            same = got == want
            print(f"{name:28s} {'ok' if same else 'DIFF':9s} {len(got[1]):7d}  {took:6.2f}s", flush=True)
            if not same:
                bad.append(name)
                if got[0] != want[0]:
                    print("   columns", got[0], want[0])
                else:
                    only_got = sorted(set(got[1]) - set(want[1]))[:3]
                    only_want = sorted(set(want[1]) - set(got[1]))[:3]
                    print("   rows", len(got[1]), len(want[1]), "\n   spark", only_got, "\n   sql  ", only_want)
        except Exception as error:
            bad.append(name)
            print(f"{name:28s} ERROR {type(error).__name__}: {str(error)[:1500]}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
