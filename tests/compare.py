"""Run registered queries beside their SQL: ``python tests/compare.py sf0.01 [name ...]``."""

from __future__ import annotations

import math
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parents[1]
DATA = pathlib.Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA / sf / name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    return str(value)


def _sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(frame, con, sql: str) -> str | None:
    """None if the rows agree (columns by name, any order of rows)."""
    names = sorted(frame.columns)
    got = [tuple(_plain(r[n]) for n in names) for r in frame.collect()]
    relation = con.sql(sql)
    places = {n: i for i, n in enumerate(relation.columns)}
    if sorted(places) != names:
        return f"columns {names} against {sorted(places)}"
    want = [tuple(_plain(r[places[n]]) for n in names) for r in relation.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    got.sort(key=_sort_key)
    want.sort(key=_sort_key)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {names}: {str(wrong[0][0])[:300]} / {str(wrong[0][1])[:300]}"
    return None


def main(sf: str, only: list[str]) -> int:
    sys.path.insert(0, str(ROOT))
    from lodestone.catalog import QUERIES, SQL
    from lodestone.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = fn(spark, str(DATA / sf))
            if name not in SQL:
                print(f"rows {name} {frame.count()} {time.time() - start:.1f}s", flush=True)
                continue
            problem = differences(frame, con, SQL[name])
        except Exception as error:  # keep going: the run reports on every query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    spark.stop()
    print(f"{bad} wrong")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
