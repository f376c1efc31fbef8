"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def _text(v):
    if v is None or v != v:
        return "null"
    return f"{v:.10g}" if isinstance(v, float) else str(v)


def table(rows, columns):
    return sorted(tuple(_text(r[c]) for c in columns) for r in rows)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    relation = con.sql(sql)
    assert columns == sorted(relation.columns)
    want = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    assert table([r.asDict() for r in df.collect()], columns) == table(want, columns)
