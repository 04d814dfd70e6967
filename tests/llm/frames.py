"""Small tables for tests, and helpers."""

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple], partitions: int = 3) -> DataFrame:
    """Documents from (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)


def clashing(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with extra columns of names that operators use themselves."""
    return docs.selectExpr("*", *[f"doc_id * 2 as `{n}`" for n in names])


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def save(path, **tables: DataFrame) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
