"""Order-insensitive comparison with DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(df, con, sql) -> tuple[int, list[str]]:
    names, rows = duck(con, sql)
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
        return 0, problems
    got, want = bag(df.collect(), df.columns), bag(rows, names)
    if got != want:
        problems.append(f"rows {sum(got.values())} vs {sum(want.values())}")
        problems.append(f"only spark {list((got - want).items())[:3]}")
        problems.append(f"only sql {list((want - got).items())[:3]}")
    return sum(got.values()), problems
