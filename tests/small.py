"""Freight tables of a few rows for tests; columns left out take a plain value."""

import datetime

from pyspark.sql import DataFrame

from seaflow.sources.schema import TABLES
from seaflow.sources.tables import FreightTables

_FILL = {"bigint": 0, "int": 0, "double": 0.0, "string": "x", "timestamp_ntz": datetime.datetime(2025, 1, 1)}


def at(day: int, hour: int = 0) -> datetime.datetime:
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(days=day - 1, hours=hour)


def frame(spark, name: str, rows: list[dict]) -> DataFrame:
    spec = TABLES[name]
    nullable = {f.name for f in spec.schema.fields if f.nullable}
    filled = []
    for number, row in enumerate(rows, 1):
        unknown = set(row) - set(spec.columns)
        assert not unknown, unknown
        values = []
        for f in spec.schema.fields:
            if f.name in row:
                values.append(row[f.name])
            elif f.name == spec.key:
                values.append(number)
            else:
                values.append(None if f.name in nullable else _FILL[f.dataType.simpleString()])
        filled.append(tuple(values))
    loose = type(spec.schema)([type(f)(f.name, f.dataType, True) for f in spec.schema.fields])
    return spark.createDataFrame(filled, loose)


def tables(spark, **rows: list[dict]) -> FreightTables:
    return FreightTables(spark, {name: frame(spark, name, rows.get(name, [])) for name in TABLES})


def dicts(df: DataFrame) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]
