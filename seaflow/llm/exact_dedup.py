"""Exact deduplication by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``. Each level groups only the rows
the level before could not tell apart; a text whose length or beginning is unique never enters the grouping by full
hash. No level moves a text: the scan reduces it to a length and hashes, every group is folded before the shuffle, so
a group that holds a third of all rows costs one row per task. ``exact_dedup`` shuffles only rows that may be dropped
or repeated.

Defined results: a null text is an empty one; all empty texts are one group. A null doc_id comes after every number
when the row that stays is chosen. Rows that repeat both doc_id and text are one document written twice: ``groups``
reports each of them as kept, ``exact_dedup`` returns one. An empty table gives an empty result. Other columns, whatever
their names, are carried by ``exact_dedup`` and ignored by ``groups``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.llm.storage import written
from seaflow.llm.touched import with_touched

HEAD_CHARS = 64
BLANKS = r"[\x20\x09-\x0D]+"


def _normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(text):
    """SHA-256 of a text without blanks, as 32 bytes."""
    return F.unhex(F.sha2(_normalised(text), 256))


def _signatures(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column)
    bare = docs.select(
        F.col(id_column).alias("doc_id"),
        F.char_length(F.coalesce(text, F.lit(""))).alias("n_chars"),
        _normalised(text).alias("bare"),
    )
    return bare.select(
        "doc_id",
        "n_chars",
        F.char_length("bare").alias("n_bare"),
        F.xxhash64(F.substring("bare", 1, HEAD_CHARS)).alias("head"),
        F.unhex(F.sha2("bare", 256)).alias("digest"),
    )


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, repeats (rows that equal the one that stays in id and length too),
    n_chars, digest (32 bytes)."""
    rows = written(_signatures(docs, id_column, text_column), "signatures")
    same_length = rows.groupBy("n_bare").count().filter("count > 1").select("n_bare")
    by_length = rows.join(same_length, "n_bare", "left_semi")
    same_head = by_length.groupBy("n_bare", "head").count().filter("count > 1").select("n_bare", "head")
    survivors = rows.join(same_head, ["n_bare", "head"], "left_semi")
    # The greatest rank stays: most characters, then the smallest id, an id before none.
    rank = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("minus_id"))
    alike = survivors.groupBy("digest", "n_chars", "doc_id").agg(F.count("*").alias("alike"))
    full = (
        alike.groupBy("digest")
        .agg(F.max(F.struct(rank.alias("rank"), F.col("alike"))).alias("best"), F.sum("alike").alias("group_size"))
        .filter("group_size > 1")
        .selectExpr(
            "digest",
            "best.rank.n_chars as keep_chars",
            "-best.rank.minus_id as keep_id",
            "best.alike as repeats",
            "group_size",
        )
    )
    found = rows.select("doc_id", "n_chars", "digest").join(full, "digest", "left")
    single = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))).alias(
            "kept"
        ),
        F.coalesce("repeats", F.lit(1)).cast("long").alias("repeats"),
        "n_chars",
        "digest",
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    verdict = written(groups(docs, id_column, text_column).filter("group_size > 1"), "groups")
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col(id_column).alias("id"),
        F.char_length(F.coalesce(F.col(text_column), F.lit(""))).alias("n"),
        digest(F.col(text_column)).alias("key"),
    )
    # One line at most for a row, whatever the size of the group; none for rows that stay as they are.
    fate = verdict.groupBy("doc_id", "digest", "n_chars").agg(
        F.max(F.when(F.col("kept"), F.col("repeats"))).alias("repeats")
    )
    fate = written(fate.filter("repeats is null or repeats > 1"), "fates")
    marked = with_touched(packed, [F.col(c) for c in ("id", "key", "n")], fate, ["doc_id", "digest", "n_chars"])
    same = (
        F.col("id").eqNullSafe(fate["doc_id"]) & (F.col("key") == fate["digest"]) & (F.col("n") == fate["n_chars"])
    )
    joined = marked.filter("touched").join(fate, same, "left").filter("digest is null or repeats > 1")
    left = written(joined.select("row", "id", "key", "repeats"), "touched")
    again = left.filter("repeats > 1").groupBy("id", "key").agg(F.first("row").alias("row")).select("row")
    once = marked.filter("not touched").select("row").unionByName(left.filter("repeats is null").select("row"))
    return once.unionByName(again).select("row.*")
