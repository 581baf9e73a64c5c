"""Rows of a query beside those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(x):
    return round(x, 6) if isinstance(x, float) else str(x) if x is not None and not isinstance(x, (int, bool, str)) else x


def compare(df, sql, db):
    """What differs; empty if the rows are the same."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=repr)
    if ours == theirs:
        return ""
    extra = [r for r in ours if r not in set(theirs)][:2]
    return f"{len(ours)} and {len(theirs)} rows; {order}: only here {extra}, only there {[r for r in theirs if r not in set(ours)][:2]}"
