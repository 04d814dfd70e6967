"""Line dedup: lines that recur across documents, or whose template does, are dropped from all of them.

Identical lines are counted on their own, whatever their words: a line goes that stands in ``least_documents``
documents or more, and one of ``LONG_CHARS`` characters or more already if two documents hold it that are otherwise
unlike, that is, have less than ``LIKE`` of the lines of the longer one in common (of the lines in fewer than
``least_documents`` documents). So near copies of one document don't lose their own text to each other.

A line is put into a tree of fixed depth: first by its number of words, then by its leading ``LEADING`` words, with
words that hold a digit generalised to ``<*>``. In a leaf, a word that is found at its position in fewer than
``least_documents`` documents is a variable field and becomes ``<*>`` too; what remains is the template of the line.
A template is dropped when it occurs in ``least_documents`` documents or more and at most ``VARIABLE_SHARE`` of it is
variable. All steps are counts, folded before they are shuffled. One scan of the texts gives hashes of lines and leaves;
a second takes the lines of leaves that recur apart.

Words are what blanks separate; lines without a word are kept. Defined results: a null text stays null and has no
lines; a document that repeats a line counts once; rows that repeat a document, with or without doc_id, count as one
document if their text is the same. An empty table gives an empty result. ``without_recurring_lines`` carries
other columns of any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaflow.llm.storage import written

LEADING = 3
LEAST_DOCUMENTS = 10
LEAST_WORDS = 1  # what _lines asks of a line by not being blank
VARIABLE_SHARE = 0.5
LONG_CHARS = 100
LIKE = 0.5
FIELD = "<*>"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\f"))


def _words(line: Column) -> Column:
    return F.split(_bare(line), r"\s+")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _general(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit(FIELD)).otherwise(w))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _leaf(words: Column) -> Column:
    """Path of a line in the tree, as a hash: number of words and leading words."""
    return F.xxhash64(F.size(words), F.array_join(_general(F.slice(words, 1, LEADING)), " "))


def _lines(docs: DataFrame, text_column: str) -> DataFrame:
    """Each distinct line with a word of each document: document (a hash of its text), n (how many it has), line."""
    text = docs[text_column]
    own = F.filter(F.array_distinct(F.split(text, "\n")), lambda x: _bare(x) != "")
    lines = docs.select(F.xxhash64(text).alias("document"), own.alias("own"))
    return lines.select("document", F.size("own").alias("n"), F.explode("own").alias("line"))


def _line_keys(docs: DataFrame, text_column: str) -> DataFrame:
    """Each distinct line with a word of each document: document, n (how many it has), line (16 bytes), long, leaf."""
    return (
        _lines(docs, text_column)
        .select(
            "document",
            "n",
            _key(F.col("line")).alias("line"),
            (F.char_length("line") >= LONG_CHARS).alias("long"),
            _let(_words(F.col("line")), _leaf).alias("leaf"),
        )
        .groupBy("document", "line")
        .agg(*[F.first(c).alias(c) for c in ("n", "long", "leaf")])
    )


def identical(keys: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Lines to drop (line, 16 bytes) as they stand in as many documents, or are long and stand in two unlike ones."""
    counts = keys.groupBy("line").agg(F.count("*").alias("holders"), F.first("long").alias("long"))
    counts = written(counts.filter("holders > 1"), "line-counts")
    often = counts.filter(F.col("holders") >= least_documents).select("line")
    rare = counts.filter(F.col("holders") < least_documents)
    # Fewer than least_documents documents a line, so the number of pairs grows with that of the lines.
    held = keys.select("document", "n", "line").join(rare, "line")
    held = held.groupBy("line", "long").agg(F.array_sort(F.collect_list(F.struct("document", "n"))).alias("own"))
    pairs = held.select("line", "long", "own", F.posexplode("own").alias("at", "a"))
    pairs = pairs.select("line", "long", "a", F.explode(F.slice("own", F.col("at") + 2, least_documents)).alias("b"))
    pairs = written(
        pairs.selectExpr("line", "long", "a.document as a", "a.n as n_a", "b.document as b", "b.n as n_b"), "line-pairs"
    )
    common = pairs.groupBy("a", "b").agg(
        F.count("*").alias("common"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")
    )
    # Lines that go anyway say nothing about likeness.
    gone = keys.join(often, "line", "left_semi").groupBy("document").agg(F.count("*").alias("gone"))
    gone = written(gone, "line-gone")
    left = gone.select(F.col("document").alias("a"), F.col("gone").alias("gone_a"))
    right = gone.select(F.col("document").alias("b"), F.col("gone").alias("gone_b"))
    rest = common.join(left, "a", "left").join(right, "b", "left")
    longer = F.greatest(
        F.col("n_a") - F.coalesce("gone_a", F.lit(0)), F.col("n_b") - F.coalesce("gone_b", F.lit(0))
    )
    unlike = rest.filter(F.col("common") < LIKE * longer).select("a", "b")
    shared = pairs.filter("long").select("line", "a", "b").join(unlike, ["a", "b"], "left_semi").select("line")
    return often.unionByName(shared.distinct())


def recurring(
    docs: DataFrame, keys: DataFrame, text_column: str = "text", least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """Lines to drop: line (16 bytes), template and n_documents of the template; ``keys`` are those of the lines."""
    hashes = (
        keys.select("document", "leaf")
        .distinct()
        .groupBy("leaf")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= least_documents)
        .select("leaf")
    )
    leaves = written(hashes, "leaves")

    def taken_apart(words: Column) -> Column:
        return F.struct(_leaf(words).alias("leaf"), words.alias("words"))

    lines = _lines(docs, text_column)
    apart = lines.select("document", "line", _let(_words(F.col("line")), taken_apart).alias("own"))
    held = written(
        apart.select("document", _key(F.col("line")).alias("line"), "own.leaf", "own.words")
        .join(leaves, "leaf", "left_semi")
        .withColumn("words", _general(F.col("words")))
        .distinct(),
        "lines",
    )
    places = held.select("document", "leaf", F.posexplode("words").alias("at", "word")).distinct()
    fixed = (
        places.groupBy("leaf", "at", "word")
        .agg(F.count("*").alias("n"))
        .filter((F.col("n") >= least_documents) & (F.col("word") != FIELD))
        .select("leaf", "at", "word")
    )
    # The words of a line that are fixed in its leaf, by their positions.
    kinds = held.select("leaf", "line", "words").distinct()
    kept = (
        kinds.select("leaf", "line", F.posexplode("words").alias("at", "word"))
        .join(fixed, ["leaf", "at", "word"])
        .groupBy("leaf", "line")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("fixed"))
    )
    template = F.concat_ws(
        " ", F.size("words"), F.transform("fixed", lambda p: F.concat_ws("=", p["at"], p["word"]))
    )
    shaped = (
        kinds.join(kept, ["leaf", "line"])
        .filter(F.size("fixed") >= (1 - VARIABLE_SHARE) * F.size("words"))
        .select("line", template.alias("template"))
    )
    per_template = (
        held.join(shaped, "line")
        .select("template", "document")
        .distinct()
        .groupBy("template")
        .agg(F.count("*").alias("n_documents"))
        .filter(F.col("n_documents") >= least_documents)
    )
    return shaped.join(per_template, "template").select("line", "template", "n_documents")


def without_recurring_lines(
    docs: DataFrame, text_column: str = "text", least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """``docs`` with their text free of recurring lines, and n_lines and n_dropped, the lines before and dropped."""
    keys = written(_line_keys(docs, text_column), "line-keys")
    shaped = recurring(docs, keys, text_column, least_documents).select("line")
    dropped = written(shaped.unionByName(identical(keys, least_documents)).distinct(), "recurring")
    text = docs[text_column]
    # Which lines of a text go: found for its distinct lines by a join on hashes, without moving texts.
    gone = (
        keys.select("document", "line")
        .join(dropped, "line", "left_semi")
        .groupBy("document")
        .agg(F.collect_set("line").alias("gone"))
    )
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != text_column]).alias("row"),
        text.alias("text"),
        F.xxhash64(text).alias("key"),
    )
    found = packed.join(gone, packed["key"] == gone["document"], "left")
    before = F.split("text", "\n")
    after = F.filter(before, lambda x: ~F.array_contains("gone", _key(x)))
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(after, "\n"))
    n_lines = F.coalesce(F.size(before), F.lit(0))
    n_after = F.when(F.col("gone").isNull(), n_lines).otherwise(F.size(after))
    done = found.select(
        "row",
        cleaned.alias("cleaned"),
        F.greatest(n_lines, F.lit(0)).alias("n_lines"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines - n_after).alias("n_dropped"),
    )
    columns = [F.col("cleaned").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns]
    return done.select(*columns, "n_lines", "n_dropped")
