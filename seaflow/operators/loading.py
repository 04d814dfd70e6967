"""Incremental loading: append only what is new, and resolve natural keys to surrogate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import totals


FILTER_BITS = 1 << 26  # 8 MB, broadcast


def possible_matches(existing: DataFrame, incoming: DataFrame, unique: list[str]) -> DataFrame:
    """Keys of the existing rows that may be among the incoming ones: all that are, and few others.

    A Bloom filter of the incoming keys, one hash in ``FILTER_BITS`` bits, is broadcast, so that the existing rows are
    passed over where they are read. Its size doesn't depend on the batch; a batch of a million keys lets 1.5 % of the
    other rows through, one of a hundred million most of them. Keys must have the same types on both sides.
    """
    spot = f"pmod(xxhash64({', '.join(unique)}), {FILTER_BITS}) as _spot"
    marks = totals(
        incoming.selectExpr(spot).selectExpr("_spot", "bitmap_bucket_number(_spot) as _block"),
        ["_block"],
        "bitmap_construct_agg(bitmap_bit_position(_spot)) as _marks",
    )
    place = "cast(bitmap_bit_position(_spot) as int)"
    byte = f"cast(conv(hex(substring(_marks, {place} div 8 + 1, 1)), 16, 10) as int)"
    return (
        existing.selectExpr(*unique, spot)
        .withColumn("_block", F.expr("bitmap_bucket_number(_spot)"))
        .join(F.broadcast(marks), "_block")  # FILTER_BITS / 32,768 rows of 4 KB at most
        .filter(f"shiftright({byte}, {place} % 8) & 1 = 1")
        .select(*unique)
    )


def new_rows(
    incoming: DataFrame, existing: DataFrame, unique: list[str], order: list[str], prune: bool = False
) -> DataFrame:
    """Incoming rows whose unique key is not there yet; of several with one key the first by ``order`` stays.

    Loading the same rows twice therefore changes nothing. The choice is a MIN over a struct, which combines
    map-side, so a key repeated very often does not end up in one task. A key with a NULL part equals no other: such
    rows are all new, in every load. ``prune``: the existing table is far larger than the batch, so only those of its
    keys are shuffled that ``possible_matches`` lets through.
    """
    absent = " or ".join(f"{c} is null" for c in unique)
    keyed, nameless = incoming.filter(f"not ({absent})"), incoming.filter(absent)
    rest = [c for c in incoming.columns if c not in unique and c not in order]
    leading = [c for c in order if c not in unique]
    kept = totals(keyed, unique, f"min(struct({', '.join(leading + rest)})) as _row")
    there = possible_matches(existing, keyed, unique) if prune else existing.select(*unique)
    fresh = kept.join(there, unique, "left_anti")
    return fresh.select(*unique, "_row.*").select(*incoming.columns).unionByName(nameless)


def load_once(
    incoming: DataFrame, existing: DataFrame, unique: list[str], order: list[str], prune: bool = False
) -> DataFrame:
    """The table after an idempotent load."""
    return existing.unionByName(new_rows(incoming, existing, unique, order, prune))


def resolve_keys(
    facts: DataFrame, dimension: DataFrame, natural: str, surrogate: str, column: str | None = None
) -> DataFrame:
    """Replace the natural key ``column`` of the facts by the surrogate key of the dimension.

    A value that the dimension does not know gives NULL, so it shows up in the reference audit.
    """
    column = column or natural
    lookup = dimension.selectExpr(f"{natural} as {column}", f"{surrogate} as {column}_{surrogate}")
    return facts.join(lookup, column, "left").drop(column)
