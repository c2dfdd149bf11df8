"""Spark's rows of a query against DuckDB's rows of its SQL."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if v != v else float(v) + 0.0
    return str(v)


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


def both(spark, name, query, sql, sf_dir=DATA):
    con = duckdb.connect()
    for p in sf_dir.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = query(spark, str(sf_dir))
    relation = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns), name
    quoted = ", ".join(f'"{c}"' for c in columns)
    return rows_of(df.select(*(f"`{c}`" for c in columns)).collect()), rows_of(con.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
