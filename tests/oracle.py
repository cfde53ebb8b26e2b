"""Run a registered query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return cols, sorted(out, key=lambda r: tuple((v is None, str(type(v).__name__), str(v)) for v in r))


def compare(spark, folder: str, query, sql: str) -> list[str]:
    """Differences, empty when both sides agree exactly."""
    con = connect(folder)
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_cols, want = _rows(want_names, cur.fetchall())
    df = query(spark, folder)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return [f"columns {got_cols} instead of {want_cols}"]
    problems = []
    if len(got) != len(want):
        problems.append(f"{len(got)} rows instead of {len(want)}")
    if not want:
        problems.append("no rows at all")
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    problems += [f"{len(bad)} rows differ"] if bad else []
    problems += [f"got {g}\n   want {w}" for g, w in bad[:3]]
    return problems
