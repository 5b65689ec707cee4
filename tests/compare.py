"""Run queries next to their SQL in DuckDB and compare names, types, and the multiset of rows bit by bit.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import collections
import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
driver = importlib.import_module("__spark_entry__")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "int", "hugeint": "int",
         "double": "double", "float": "double", "varchar": "string", "string": "string", "boolean": "boolean"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return repr(value + 0.0) if isinstance(value, float) else value


def bag(rows, order):
    return collections.Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir) -> list[str]:
    """Differences found; an empty list means equal."""
    df = driver.queries()[name](spark, sf_dir)
    result = con.execute(driver.oracle_sql()[name])
    theirs = [(c[0], KINDS.get(str(c[1]).lower(), str(c[1]).lower())) for c in result.description]
    ours = [(c, KINDS.get(t, t)) for c, t in df.dtypes]
    if sorted(ours) != sorted(theirs):
        return [f"schema: {sorted(set(ours) ^ set(theirs))}"]
    names = sorted(c for c, _ in ours)
    a = bag(df.collect(), [df.columns.index(c) for c in names])
    b = bag(result.fetchall(), [[c for c, _ in theirs].index(c) for c in names])
    if a == b:
        return [] if a else ["both empty"]
    extra, missing = a - b, b - a
    return [f"rows {sum(a.values())} vs {sum(b.values())}, only here {sum(extra.values())}: {list(extra)[:2]}, "
            f"only there {sum(missing.values())}: {list(missing)[:2]}"]


if __name__ == "__main__":
    from ledgerloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(driver.queries())
    spark, con = local_session(8), duck(sf)
    bad = 0
    for q in chosen:
        start = time.time()
        try:
            found = compare(spark, con, q, sf)
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {q} {time.time() - start:.1f}s", *[f[:900] for f in found], flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} equal")
