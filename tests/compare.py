"""Compare a query's rows with its SQL's, regardless of order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str) -> list[dict]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return [dict(zip(names, r)) for r in cursor.fetchall()]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return int(value) if isinstance(value, bool) else value


def rows_of(records) -> list:
    return sorted((tuple(sorted((k, plain(v)) for k, v in r.items())) for r in records), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    mine, theirs = rows_of(r.asDict() for r in df.collect()), rows_of(duck(sql, sf_dir))
    assert len(mine) == len(theirs)
    assert mine == theirs
