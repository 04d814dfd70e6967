"""Runs a registered query on Spark and its SQL on DuckDB and compares the two results as bags of rows."""

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, db, query, sql: str, sf_dir: str) -> list[str]:
    """Differences found; empty when names, types and values agree."""
    df = query(spark, sf_dir)
    left_names, left = _rows(df.columns, df.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    right_names, right = _rows(names, result.fetchall())
    problems = []
    if left_names != right_names:
        return [f"columns {left_names} != {right_names}"]
    for name, kind in df.dtypes:
        if SPARK_TO_DUCK.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    if len(left) != len(right):
        problems.append(f"{len(left)} rows != {len(right)}")
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems
