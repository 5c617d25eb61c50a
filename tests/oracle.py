"""Runs SQL over the test tables and compares rows without order."""

import math
import os

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(folder, sql):
    import duckdb

    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x.is_integer() else round(x, 6)
    return int(x) if isinstance(x, bool) else x if x is None or isinstance(x, int) else str(x).removesuffix(" 00:00:00")


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def same(df, folder, sql):
    got, want = table(df.columns, [tuple(r) for r in df.collect()]), table(*sql_rows(folder, sql))
    assert got[0] == want[0]
    assert got[1] == want[1]
