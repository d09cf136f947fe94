"""Holds a Spark result against DuckDB SQL over the same tables."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, str)):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, datetime.date):
        return v
    return float(v)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    key = lambda r: tuple((v is not None, str(type(v)), round(v, 6) if isinstance(v, float) else v) if v is not None else (False, "", 0) for v in r)
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in data), key=key)


def differences(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    want_names, want = rows([d[0] for d in cur.description], cur.fetchall())
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if names != want_names:
        return [f"columns {names} and {want_names}"]
    if len(got) != len(want):
        out.append(f"{len(got)} rows and {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]
    if bad:
        out.append(f"{len(bad)} rows differ, such as {bad[0]}")
    return out
