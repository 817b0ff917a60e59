"""Compares a registered query with its SQL, run by DuckDB on the same files."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of_query(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(_plain, r)) for r in df.select(*cols).collect()), key=repr)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(rel.columns), sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
