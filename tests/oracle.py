"""Runs a query and its SQL side by side: rows as multisets, columns by name."""

import math
from collections import Counter

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in found)


def compare(df, con, sql):
    cursor = con.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0], (got[0], want[0])
    if got[1] != want[1]:
        raise AssertionError(f"{sum(got[1].values())} and {sum(want[1].values())} rows; only here {list((got[1] - want[1]))[:3]}, only there {list((want[1] - got[1]))[:3]}")
