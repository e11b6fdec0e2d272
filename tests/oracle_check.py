"""Compare named queries with their SQL twins: python -m tests.oracle_check [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb

import __spark_entry__ as contract
from pulseloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    frame = contract.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = [tuple(_plain(r[c]) for c in columns) for r in frame.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return bool(mine), f"{len(mine)} rows, no SQL"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return False, f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    mine.sort(key=repr)
    theirs.sort(key=repr)
    if mine == theirs:
        return True, f"{len(mine)} rows"
    left = [r for r in mine if r not in set(theirs)][:2] if len(mine) < 200_000 else []
    right = [r for r in theirs if r not in set(mine)][:2] if len(mine) < 200_000 else []
    return False, f"{len(mine)} rows against {len(theirs)}\n   spark {left}\n   sql   {right}"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(contract.queries())
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - the list goes on
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
