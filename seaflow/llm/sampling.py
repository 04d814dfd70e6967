"""Bounded samples for learning, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RANGE = 1 << 31


def least_hashes(rows: DataFrame, group: str, id_column: str, most: int) -> DataFrame:
    """The ``most`` rows of each group with the least hash of their id, the same however the rows are dealt.

    A threshold from the size of the group, which about twice as many rows pass, is applied where the rows are read,
    so that few rows are shuffled and sorted even of a group that holds most of the input.
    """
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    limits = sizes.select("_group", (F.lit(_RANGE) * (2 * most + 64) / F.col("_n")).alias("_limit"))
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(id_column), F.lit(_RANGE)))
    near = hashed.join(limits, hashed[group] == limits["_group"]).filter("_hash <= _limit")
    order = Window.partitionBy(group).orderBy("_hash", id_column)
    chosen = near.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most)
    return chosen.select(*rows.columns)
