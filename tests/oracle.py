"""Run a registered query and its SQL twin and compare columns, types, row counts and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def sql_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return sql_type(spark_type[6:-1]) + "[]"
    return SQL_TYPES.get(spark_type, spark_type)


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_cell(r[k]) for k in order) for r in rows)


def compare(df, con, sql):
    """None when both sides agree, otherwise a short description of the difference."""
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    got_types = {n: sql_type(t) for n, t in df.dtypes}
    if want_types != got_types:
        diff = {k: (got_types.get(k), want_types.get(k)) for k in set(want_types) | set(got_types)
                if got_types.get(k) != want_types.get(k)}
        return f"schema (spark, sql): {diff}"
    want = canonical(rel.columns, rel.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if len(want[1]) != len(got[1]):
        return f"rows: spark {len(got[1])}, sql {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} of {len(want[1])} rows differ, columns {want[0]}; first (spark, sql): {bad[0]}"
    if not want[1]:
        return "both sides are empty"
    return None
