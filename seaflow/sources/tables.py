"""Loading, saving and SQL access for the eleven freight tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaflow.sources.schema import TABLES, TableSpec

FILE_FORMATS = ("parquet", "orc", "csv", "json")


class FreightTables:
    """The eleven tables as attributes, each built on first use.

    ``FreightTables(spark, {"vessel": df, ...})`` wraps DataFrames that exist already; values may also be
    functions without arguments that return one.
    """

    def __init__(self, spark: SparkSession, sources: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        unknown = sorted(set(sources) - set(TABLES))
        if unknown:
            raise ValueError(f"not part of the freight model: {', '.join(unknown)}")
        self.spark = spark
        self._sources = dict(sources)
        self._built: dict[str, DataFrame] = {}
        self._sql_session: SparkSession | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._sources:
                raise KeyError(f"no source given for table {name}")
            source = self._sources[name]
            self._built[name] = source if isinstance(source, DataFrame) else source()
        return self._built[name]

    def names(self) -> list[str]:
        """Names of the tables present, in model order."""
        return [name for name in TABLES if name in self._sources]

    # -- files and databases ------------------------------------------------

    @classmethod
    def load(cls, spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> FreightTables:
        """Read ``path/<table>`` for every table with its declared schema (nothing is inferred)."""
        if fmt not in FILE_FORMATS:
            raise ValueError(f"unsupported format {fmt!r}; use one of {', '.join(FILE_FORMATS)}")
        if fmt == "csv":
            options = {"header": "true", **options}

        def reader(spec: TableSpec) -> Callable[[], DataFrame]:
            return lambda: spark.read.format(fmt).schema(spec.schema).options(**options).load(f"{path}/{spec.name}")

        return cls(spark, {name: reader(spec) for name, spec in TABLES.items()})

    @classmethod
    def load_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        bounds: Mapping[str, tuple[int, int]] | None = None,
        partitions: int = 32,
        **options: str,
    ) -> FreightTables:
        """Read every table from a database whose JDBC driver is on the class path.

        ``bounds`` gives the key range per table; a table listed there is read by ``partitions`` parallel key
        ranges, any other by one connection. Rows outside the range still fall into the first or last part.
        """
        bounds = bounds or {}

        def reader(spec: TableSpec) -> Callable[[], DataFrame]:
            def read() -> DataFrame:
                source = spark.read.format("jdbc").options(url=url, dbtable=spec.name, **options)
                if spec.name in bounds:
                    low, high = bounds[spec.name]
                    source = source.options(
                        partitionColumn=spec.key,
                        lowerBound=str(low),
                        upperBound=str(high),
                        numPartitions=str(partitions),
                    )
                return conform(source.load(), spec)

            return read

        return cls(spark, {name: reader(spec) for name, spec in TABLES.items()})

    def save(self, path: str, fmt: str = "parquet", mode: str = "errorifexists", ordered: bool = False) -> None:
        """Write every table present to ``path/<table>``.

        ``ordered`` lays the large tables out by the columns they are looked up and joined by, which is what an
        index does elsewhere: file statistics then let a look-up skip nearly all files. The range partitioning ends
        in a unique column, so a value held by very many rows is spread over several files. Parquet files also get
        Bloom filters of the table's key and of its unique text columns, by which a look-up passes over row groups whose
        range holds the value but which don't hold it themselves.
        """
        for name in self.names():
            df = self.table(name)
            layout = TABLES[name].layout
            if ordered and layout:
                df = df.repartitionByRange(*layout).sortWithinPartitions(*layout)
            writer = df.write.format(fmt).mode(mode)
            if ordered and layout and fmt == "parquet":
                for column in _looked_up_by(TABLES[name]):
                    writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            if fmt == "csv":
                writer = writer.option("header", "true")
            writer.save(f"{path}/{name}")

    # -- SQL ----------------------------------------------------------------

    def sql_session(self) -> SparkSession:
        """A session of its own whose views are just the freight tables.

        The caller's catalog is left alone, and a query cannot reach files by path.
        """
        if self._sql_session is None:
            session = self.spark.newSession()
            for key, value in self.spark.conf.getAll.items():
                if session.conf.isModifiable(key):
                    session.conf.set(key, value)
            session.conf.set("spark.sql.runSQLOnFiles", "false")
            for name in self.names():
                _share_view(self.table(name), session, name)
            for statement in _DIALECT_FUNCTIONS:
                session.sql(statement)
            self._sql_session = session
        return self._sql_session

    def run_query(self, sql: str, params: tuple = ()) -> DataFrame:
        """Run SQL over the freight tables; ``?`` markers take their values from ``params`` in order."""
        return self.sql_session().sql(sql, args=list(params) or None)


# The two date functions that queries written for the model use and Spark lacks. They are SQL functions, which
# Catalyst inlines; neither looks at the session's time zone.
_DIALECT_FUNCTIONS = (
    """
    create or replace temporary function strftime(pattern string, moment timestamp_ntz) returns string
    return replace(replace(replace(replace(replace(replace(pattern,
        '%Y', substr(cast(moment as string), 1, 4)), '%m', substr(cast(moment as string), 6, 2)),
        '%d', substr(cast(moment as string), 9, 2)), '%H', substr(cast(moment as string), 12, 2)),
        '%M', substr(cast(moment as string), 15, 2)), '%S', substr(cast(moment as string), 18, 2))
    """,
    """
    create or replace temporary function julianday(moment timestamp_ntz) returns double
    return (timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', moment) + 210866760000000) / 86400000e0
    """,
)


def _share_view(df: DataFrame, session: SparkSession, name: str) -> None:
    """Register ``df`` as view ``name`` of another session of the same application."""
    passing = f"seaflow_{uuid.uuid4().hex}"
    df.createOrReplaceGlobalTempView(passing)
    try:
        session.table(f"global_temp.{passing}").createOrReplaceTempView(name)
    finally:
        df.sparkSession.catalog.dropGlobalTempView(passing)


def _looked_up_by(spec: TableSpec) -> list[str]:
    """The key, references' keys that the table is laid out by, and text columns that are unique by themselves."""
    unique = {columns[0] for columns in spec.unique if len(columns) == 1}
    return sorted({spec.key} | unique | {c for c in spec.layout if c in spec.references})


def checked(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the declared schema, typed as by ``conform``, and the others as they came, with ``reasons``.

    A value doesn't fit if it is there but can't be cast, or is absent where one is required and there is no default.
    Both results are lazy and read ``df`` on their own; one bad cell therefore ends no load.
    """
    faults = []
    for f in spec.schema.fields:
        if f.name not in df.columns:
            continue  # conform gives a default or NULL, or says what is missing
        value, kind = F.col(f.name), f.dataType.simpleString()
        fault = F.when(value.isNotNull() & value.try_cast(f.dataType).isNull(), F.lit(f"{f.name}: not a {kind}"))
        if not f.nullable and f.name not in spec.defaults:
            fault = fault.when(value.isNull(), F.lit(f"{f.name}: missing"))
        faults.append(fault)
    reasons = F.concat_ws("; ", *faults)  # passes over NULL
    accepted = conform(df.filter(reasons == ""), spec)
    return accepted, df.withColumn("reasons", reasons).filter(F.col("reasons") != "")


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Declared columns in declared order and type; absent columns take their default, else NULL."""
    present = set(df.columns)
    columns = []
    for f in spec.schema.fields:
        if f.name in present:
            value = F.col(f.name)
            if f.name in spec.defaults:
                value = F.coalesce(value, F.lit(spec.defaults[f.name]))
        elif f.name in spec.defaults:
            value = F.lit(spec.defaults[f.name])
        elif f.nullable:
            value = F.lit(None)
        else:
            raise ValueError(f"{spec.name}: required column {f.name} is missing")
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)
