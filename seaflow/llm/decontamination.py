"""Benchmark decontamination: documents that contain a benchmark item with at most a given share of edits.

Both sides are compared in lower case with every run of characters that are no letter or digit as one space. An item of
n characters may differ in ``k = n // CHARS_PER_EDIT`` edits (insertions, deletions, substitutions of a character).
Cut into k + 1 pieces, at least one piece of it must occur unchanged (pigeonhole); an automaton finds the pieces of all
items in one pass over a text, and the stretch around each hit is verified with Myers' bit-parallel edit distance. An
item must begin and end at word borders, give or take its edits; items without letter or digit match nothing.

The items are a query set: they are read in blocks of bounded size, each of which is held against all documents. With
more than one block, the hits of each are written before the next is sent, so that one automaton is in memory at a time.
The documents are never shuffled for the search.

Defined results: null texts contain nothing; null doc_ids are reported as null and their rows are judged like others;
repeated rows are each reported. An empty table of either kind gives an empty result. ``decontaminated`` carries other
columns of any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seaflow.llm.storage import written

CHARS_PER_EDIT = 12
BLOCK_CHARS = 4_000_000
_OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """A text as it is compared: words joined and surrounded by one space each."""
    return " " + _OTHER.sub(" ", (text or "").lower()).strip() + " "


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """Start and text of edits + 1 pieces whose lengths differ by one at most."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to a stretch of ``text``, and the end of the first such stretch (Myers)."""
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = where.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        h_plus = minus | (full & ~(across | plus))
        h_minus = plus & across
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(vertical | h_plus))
        minus = h_plus & vertical
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items: list[tuple[int | None, str, int]] = []
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = plain(text)
            if len(item) < 3:
                continue
            edits = (len(item) - 2) // CHARS_PER_EDIT
            for start, piece in pieces(item, edits):
                owners.setdefault(piece, []).append((len(self.items), start))
            self.items.append((item_id, item, edits))
        self.automaton = ahocorasick.Automaton()
        for piece, owned in owners.items():
            self.automaton.add_word(piece, (len(piece), owned))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end) per item found; ends count characters of the text as it is compared."""
        if not self.items:
            return []
        body = plain(text)
        spots: dict[int, list[int]] = {}
        for last, (length, owned) in self.automaton.iter(body):
            for n, start in owned:
                spots.setdefault(n, []).append(last + 1 - length - start)
        found = []
        for n, starts in spots.items():
            item_id, item, edits = self.items[n]
            best = None
            reached = -1
            for start in sorted(set(starts)):
                if start <= reached:  # within a stretch that was verified
                    continue
                # One stretch for all hits whose items would begin within the edits of this one.
                reached = start + edits
                low, high = max(0, start - edits), reached + len(item) + edits
                if body.startswith(item, start):
                    distance, end = 0, len(item) + start - low
                else:
                    distance, end = best_match(item, body[low:high])
                if distance <= edits and (best is None or distance < best[1]):
                    best = (item_id, distance, low + end)
            if best:
                found.append(best)
        return found


@lru_cache(maxsize=1)  # blocks follow one another
def _matcher(items: tuple[tuple[int | None, str], ...]) -> Matcher:
    return Matcher(list(items))


_HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())])
_HITS = "array<struct<item_id: bigint, distance: int, end: int>>"


def _searching(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value)
        for batch in batches:
            found = [matcher.find(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            hits = [[{"item_id": i, "distance": d, "end": e} for i, d, e in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hits, pa.list_(_HIT))], names=[*batch.schema.names, "hits"]
            )

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The items in blocks of about BLOCK_CHARS characters, in order of a hash."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = size // BLOCK_CHARS + 1
    for n in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == n).collect()
        yield tuple(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0], x[1])))


def _hits(docs: DataFrame, benchmark: DataFrame, carried: Column, text_column: str) -> DataFrame:
    """``carried`` of every row with its hits in all blocks."""
    context = docs.sparkSession.sparkContext
    found = docs.select(
        carried.alias("carried"), F.array().cast(_HITS).alias("before"), docs[text_column].cast("string").alias("text")
    )
    schema = StructType([*found.schema.fields, *StructType.fromDDL(f"hits {_HITS}").fields])
    for n, block in enumerate(_blocks(benchmark)):
        if n:  # one block at a time is in memory: the last one's hits are written before the next one is sent
            found = written(found, "hits")
            shared.destroy()
        shared = context.broadcast(block)
        searched = found.mapInArrow(_searching(shared), schema)
        found = searched.select("carried", F.concat("before", "hits").alias("before"), "text")
    return found.select("carried", F.col("before").alias("hits"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, item_id, distance and end for each item that a document contains."""
    found = _hits(docs, benchmark, docs[id_column], text_column)
    return found.select(F.col("carried").alias("doc_id"), F.explode("hits").alias("hit")).select(
        "doc_id", "hit.item_id", "hit.distance", "hit.end"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without any item, with all their columns."""
    whole = F.struct(*[docs[c] for c in docs.columns])
    return _hits(docs, benchmark, whole, text_column).filter(F.size("hits") == 0).select("carried.*")
