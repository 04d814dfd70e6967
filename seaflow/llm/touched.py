"""Splits rows by whether a key may be among given ones, without shuffling them.

A Bloom filter of the given keys, one hash in ``FILTER_BITS`` bits, is broadcast: its size is the same for any number of
keys. Rows it doesn't hold need no join; the others, few as long as the keys are far fewer than the bits, take part in an
exact one. Null is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26  # 8 MB


def _spot(key: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))


def with_touched(rows: DataFrame, key: list[Column], keys: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``touched``: false only where ``key`` is not among those in ``columns`` of ``keys``."""
    marks = (
        keys.select(_spot([F.col(c) for c in columns]).alias("_spot"))
        .groupBy(F.bitmap_bucket_number("_spot").alias("_block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_marks"))
    )
    placed = rows.withColumn("_spot", _spot(key)).withColumn("_own_block", F.bitmap_bucket_number("_spot"))
    # FILTER_BITS / 32,768 rows of 4 KB at most.
    joined = placed.join(F.broadcast(marks), F.col("_own_block") == F.col("_block"), "left")
    place = F.bitmap_bit_position("_spot").cast("int")
    byte = F.conv(F.hex(F.substring("_marks", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # Shifted by a column, for which there is no function of the API.
    shifted = joined.withColumn("_byte", byte).withColumn("_bit", place % 8)
    touched = F.coalesce(F.expr("shiftright(_byte, _bit) & 1 = 1"), F.lit(False))
    return shifted.select(*rows.columns, touched.alias("touched"))
