"""Byte-level BPE with Spark's higher-order functions, from the ranks of a vocabulary file.

A text is cut by the pattern of the vocabulary; each match, a word here, is encoded on its own: its bytes are folded,
merging the neighbours of least rank (the leftmost of equals) until no pair has a rank. Ranks are a scalar subquery of
the plan: arrays of small maps. A whole word's rank is found by a checksum of its bytes, held as hexadecimal text, two
characters each; that of two parts by their ids.

A word of more than ``LONG_BYTES`` bytes is first cut between bytes that stand side by side in no token: no merge can reach
across such a place. A piece that stays long has all places of its least rank merged in one step. That equals merging
them one by one unless a pair on the way has a lesser rank; then that step merges only the leftmost.

Words repeat. The most frequent words of the whole input, ``dictionary_size`` at most, are folded once and broadcast (the
size is the bound of the broadcast); words outside it are folded where they occur, once for each document. Documents are not
shuffled. Decoding looks up the bytes of every id in an array and concatenates them.

Defined results: a null text is an empty one and gives no ids, which decode to no bytes. Words of any length are
encoded whole. Repeated rows are encoded alike, an empty table gives an empty result, other columns are ignored by
``encoded`` and carried by ``round_trip``.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seaflow.llm.storage import release, written

# Fixed value: the pattern that cuts texts for the vocabulary files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same matches in fewer attempts: what an alternative has taken it never needs to give back, and the ends of
# contractions begin like no word or number, so these can be tried first.
JAVA_PATTERN = r"""(?U) ?\p{L}++| ?\p{N}++|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
DICTIONARY_SIZE = 800_000
LONG_BYTES = 128
BUCKETS = 1 << 15
NO_RANK = 2_147_483_647
PAIR_BUCKETS = 32_749
OFFSET = (1 << 8) - 1  # holds a place in a word of up to LONG_BYTES bytes
ID_BITS = 27
RANK_AT = ID_BITS + 8
NO_PAIR = (1 << ID_BITS) - 1
MOST_ID = NO_PAIR - 257  # above are 256 numbers for bytes without a rank
SLICE_WORDS = 1 << 18  # taken at once from an Arrow batch


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def words_of(text: Column) -> Column:
    """The matches of the pattern, in order; white space and classes are those of Unicode."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(JAVA_PATTERN), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the end of a fold over nothing, since ``transform`` copies what it gives."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, body)


def _rank(key: Column, maps: Column) -> Column:
    bucket = F.element_at(maps, (F.crc32(key) % BUCKETS + 1).cast("int"))
    return F.coalesce(F.try_element_at(bucket, key), F.lit(NO_RANK))


def _merged(bytes_: Column, known: Column) -> Column:
    """The ids of a word's bytes, one merge a step.

    The state is one number for each part: the rank of the pair it begins, the part's first byte, and the part's id in the
    lowest bits. The least number is thus the leftmost of the pairs of least rank, and that rank is the id of both together.
    """

    def begin(number: Column) -> Column:
        return number.bitwiseAND(OFFSET << ID_BITS)

    def own(number: Column) -> Column:
        return number.bitwiseAND(NO_PAIR)

    def pair(left: Column, right: Column) -> Column:
        """The rank of two parts, at its place in a number."""

        def found(both: Column) -> Column:
            bucket = F.get(known["pairs"], (both % PAIR_BUCKETS).cast("int"))
            return F.coalesce(F.try_element_at(bucket, both), F.lit(NO_PAIR)).cast("long")

        return F.shiftleft(_let(F.shiftleft(left, ID_BITS).bitwiseOR(right), found), RANK_AT)

    def pair_or_none(left: Column, right: Column) -> Column:
        return F.when(right.isNotNull(), pair(left, right)).otherwise(F.lit(NO_PAIR << RANK_AT))

    def numbers(ids: Column) -> Column:
        def number(part: Column, i: Column) -> Column:
            first = F.shiftleft(i.cast("long"), ID_BITS)
            return pair_or_none(part, F.get(ids, i + 1)).bitwiseOR(first).bitwiseOR(part)

        return F.transform(ids, number)

    def step(state: Column, _: Column) -> Column:
        def joined(least: Column) -> Column:
            made = F.shiftright(least, RANK_AT)

            def at(place: Column) -> Column:
                def put(number: Column, i: Column) -> Column:
                    here = pair_or_none(made, own(F.get(state, place + 2))).bitwiseOR(begin(least)).bitwiseOR(made)
                    before = pair(own(number), made).bitwiseOR(number.bitwiseAND((1 << RANK_AT) - 1))
                    return F.when(i == place, here).when(i == place - 1, before).otherwise(number)

                return F.transform(F.array_remove(state, F.get(state, place + 1)), put)

            # Not by array_position, which leaves its loop by throwing, nor by slices, which took longer.
            return _let(F.size(F.filter(state, lambda number: begin(number) < begin(least))), at)

        return _let(
            F.array_min(state), lambda least: F.when(least < NO_PAIR << RANK_AT, joined(least)).otherwise(state)
        )

    def id_of(number: Column) -> Column:
        return F.when(own(number) <= MOST_ID, own(number).cast("int")).otherwise(F.lit(NO_RANK))

    characters = F.split(F.decode(bytes_, "ISO-8859-1"), "")  # one for each byte
    parts = F.transform(characters, lambda c: F.get(known["bytes"], F.ascii(c)).cast("long"))
    return _let(
        parts,
        lambda ids: F.aggregate(
            F.sequence(F.lit(1), F.size(ids)), numbers(ids), step, lambda state: F.transform(state, id_of)
        ),
    )


def _merged_by_rank(key: Column, maps: Column) -> Column:
    """The ids of a word's bytes, all places of the least rank in a step.

    The steps are nested, since each copies the state, also one that finds nothing left to merge.
    """

    def state_of(parts: Column) -> Column:
        def ranked(p: Column) -> Column:
            pairs = F.transform(
                F.sequence(F.lit(1), F.size(p) - 1), lambda i: _rank(F.concat(p[i - 1], p[i]), maps)
            )
            ranks = F.when(F.size(p) > 1, pairs).otherwise(F.array().cast("array<int>"))
            return _let(
                ranks,
                lambda r: F.struct(
                    p.alias("parts"), r.alias("ranks"), F.coalesce(F.array_min(r), F.lit(NO_RANK)).alias("least")
                ),
            )

        return _let(parts, ranked)

    def chosen(marks: Column) -> Column:
        return F.split(marks, "")

    def merge(state: Column) -> Column:
        parts, ranks, least = state["parts"], state["ranks"], state["least"]
        n = F.size(parts)

        def at(places: Column, i: Column) -> Column:  # is place i, from 1, one to merge; false beyond the ends
            return F.coalesce(F.get(places, i - 1) == "1", F.lit(False))

        def overtaken(places: Column, m: Column) -> Column:
            """Whether a pair beside some merged place has a lesser rank, before or after the next place is merged."""

            def lesser(i: Column) -> Column:
                before = F.when(at(places, i - 2), m).otherwise(F.get(parts, i - 2))
                left = F.coalesce(_rank(F.concat(before, m), maps), F.lit(NO_RANK))
                right = F.coalesce(_rank(F.concat(m, F.get(parts, i + 1)), maps), F.lit(NO_RANK))
                return at(places, i) & (F.least(left, right) < least)

            return F.exists(F.sequence(F.lit(1), n - 1), lesser)

        def applied(places: Column) -> Column:
            made = F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.when(at(places, i), F.concat(parts[i - 1], F.get(parts, i)))
                .when(at(places, i - 1), F.lit(None))
                .otherwise(parts[i - 1]),
            )
            return state_of(F.filter(made, lambda part: part.isNotNull()))

        marks = F.array_join(F.transform(ranks, lambda r: F.when(r == least, "1").otherwise("0")), "")
        first = F.array_position(ranks, least).cast("int")
        alone = F.concat(F.repeat(F.lit("0"), first - 1), F.lit("1"), F.repeat(F.lit("0"), n - 1 - first))
        return _let(
            chosen(F.regexp_replace(marks, "11", "10")),  # of places that overlap the left one
            lambda places: _let(
                F.concat(F.element_at(parts, first), F.element_at(parts, first + 1)),
                lambda m: _let(
                    F.when(overtaken(places, m), chosen(alone)).otherwise(places), applied
                ),
            ),
        )

    def unless_done(state: Column, change: Callable[[Column], Column]) -> Column:
        return F.when(state["least"] < NO_RANK, change(state)).otherwise(state)

    def steps(state: Column) -> Column:
        return F.aggregate(some, state, lambda inner, _: unless_done(inner, merge))

    some = F.sequence(F.lit(1), F.ceil(F.sqrt(F.length(key) / 2)).cast("int"))  # nested, at least a step for each byte
    bytes_ = F.regexp_extract_all(key, F.lit(".."), F.lit(0))
    done = F.aggregate(
        some, state_of(bytes_), lambda state, _: unless_done(state, steps), lambda state: state["parts"]
    )
    return F.transform(done, lambda part: _rank(part, maps))


def _pieces(key: Column, adjacent: Column) -> Column:
    """A word cut between bytes that no token holds side by side."""

    def cut(bytes_: Column) -> Column:
        def piece(i: Column) -> Column:
            pair = F.conv(F.concat(bytes_[i - 1], F.get(bytes_, i)), 16, 10).cast("int")
            return F.concat(bytes_[i - 1], F.when(F.get(adjacent, pair) == 0, " ").otherwise(""))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.size(bytes_)), piece), "")

    return F.split(_let(F.regexp_extract_all(key, F.lit(".."), F.lit(0)), cut), " ")


def _folded(word: Column, known: Column) -> Column:
    """The ids of one word: itself if it has a rank, else its bytes with all merges made."""
    short = 2 * LONG_BYTES
    maps = known["maps"]

    def merged(key: Column) -> Column:
        return F.when(F.length(key) <= short, _merged(F.unhex(key), known)).otherwise(
            F.flatten(
                F.transform(
                    _pieces(key, known["adjacent"]),
                    lambda piece: F.when(F.length(piece) == 2, F.array(_rank(piece, maps)))
                    .when(F.length(piece) <= short, _merged(F.unhex(piece), known))
                    .otherwise(_merged_by_rank(piece, maps)),
                )
            )
        )

    return _let(
        F.hex(F.encode(word, "UTF-8")),
        lambda key: _let(
            _rank(key, maps), lambda whole: F.when(whole < NO_RANK, F.array(whole)).otherwise(merged(key))
        ),
    )


def _bucketed(pairs: dict[int, int]) -> pa.ListArray:
    """One row: an array of a map for each bucket. Made of flat arrays, which the driver holds in little memory."""
    keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
    ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
    buckets = keys % PAIR_BUCKETS
    order = np.argsort(buckets, kind="stable")
    offsets = np.concatenate(([0], np.bincount(buckets, minlength=PAIR_BUCKETS).cumsum())).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(offsets), pa.array(keys[order]), pa.array(ranks[order]))
    return pa.ListArray.from_arrays(pa.array([0, PAIR_BUCKETS], pa.int32()), maps)


class Ranks:
    """A vocabulary as a table of one row, whose columns plans use as scalar subqueries: a literal would stand in the texts
    of every plan, which the driver keeps."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        maps: list[list[tuple[str, int]]] = [[] for _ in range(BUCKETS)]
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            key = token.hex().upper()
            maps[zlib.crc32(key.encode()) % BUCKETS].append((key, rank))
            pieces[rank] = key
        beside = bytearray(1 << 16)  # whether some token holds two bytes side by side
        for token in ranks:
            for pair in zip(token, token[1:]):
                beside[pair[0] << 8 | pair[1]] = 1
        self.largest = len(pieces) - 1
        if self.largest > MOST_ID:
            raise ValueError(f"ranks beyond {MOST_ID:,} are not supported")
        bytes_ = [ranks.get(bytes([b]), NO_PAIR - 1 - b) for b in range(256)]
        parts = {bytes([b]): number for b, number in enumerate(bytes_)} | ranks
        pairs: dict[int, int] = {}  # of all parts that give a token side by side
        for token, rank in ranks.items():
            for n in range(1, len(token)):
                left, right = parts.get(token[:n]), parts.get(token[n:])
                if left is not None and right is not None:
                    pairs[left << ID_BITS | right] = rank
        columns = {
            "maps": pa.array([maps], pa.list_(pa.map_(pa.string(), pa.int32()))),
            "pairs": _bucketed(pairs),
            "bytes": pa.array([bytes_], pa.list_(pa.int32())),
            "adjacent": pa.array([list(beside)], pa.list_(pa.int8())),
            "pieces": pa.array([pieces], pa.list_(pa.string())),
        }
        self._row = spark.createDataFrame(pa.table(columns))

    def beside(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns that ``fold`` and ``decode`` read; a subquery may not stand within their lambdas. One
        select puts the columns in their place, so no row holds them."""
        known = [self._row.select(name).scalar().alias(name) for name in ("maps", "pairs", "bytes", "adjacent")]
        return rows.select("*", F.struct(*known).alias("known"), self._row.select("pieces").scalar().alias("pieces"))

    @staticmethod
    def fold(words: Column) -> Column:
        """The ids of each of an array of words. The maps are bound once for all look-ups."""
        return _let(F.col("known"), lambda known: F.transform(words, lambda word: _folded(word, known)))

    @staticmethod
    def decode(ids: Column) -> Column:
        """A struct of ids and decoded, the bytes that they stand for."""

        def both(v: Column) -> Column:
            keys = F.transform(v["ids"], lambda i: F.get(v["pieces"], i))
            return F.struct(v["ids"].alias("ids"), F.unhex(F.array_join(keys, "")).alias("decoded"))

        return _let(F.struct(ids.alias("ids"), F.col("pieces").alias("pieces")), both)


@dataclass
class Dictionary:
    """Words, and the ids of word n at ids[offsets[n]:offsets[n + 1]]."""

    words: pa.Array
    offsets: np.ndarray
    ids: np.ndarray
    _places: dict[str, int] | None = None

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each of some words, -1 for those outside. The table is made once and kept until ``forget``."""
        if self._places is None:
            self._places = dict(zip(self.words.to_numpy(zero_copy_only=False).tolist(), range(len(self.words))))
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter((self._places.get(w, -1) for w in distinct), np.int32, len(distinct))
        return own[coded.indices.to_numpy(zero_copy_only=False)]

    def forget(self) -> None:
        """Drops the table: a process that waits for its next task holds none."""
        self._places = None
        release()

    @staticmethod
    def of(rows: pa.Table, largest: int) -> Dictionary:
        """From columns word and ids, in the narrowest type that holds the largest id."""
        words = pa.concat_arrays([c.cast(pa.string()) for c in rows["word"].chunks] or [pa.array([], pa.string())])
        lists = [c for c in rows["ids"].chunks if len(c)]
        kind = np.uint16 if largest < 1 << 16 else np.int32
        ids = [c.flatten().to_numpy(zero_copy_only=False).astype(kind) for c in lists]
        lengths = [pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in lists]
        offsets = np.concatenate([np.zeros(1, np.int32), *lengths]).cumsum(dtype=np.int32)
        return Dictionary(words, offsets, np.concatenate([np.empty(0, kind), *ids]))

    def expand(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at ``places`` one after the other (none for -1), and the end of each word's ids."""
        starts = self.offsets[places]
        lengths = np.where(places >= 0, self.offsets[places + 1] - starts, 0)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(total, dtype=ends.dtype)], ends


def _row_lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and the offsets of its rows, starting at 0."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def _cut(
    carried: pa.Array, words: pa.Array, rows: np.ndarray, places: np.ndarray, known: Dictionary
) -> pa.RecordBatch:
    """Ids of the known words of some rows, cut at the unknown ones (place -1); these, without repeats in a row; and
    which of them stands at each cut."""
    ids, ends = known.expand(places)
    ends = np.concatenate(([0], ends))
    cuts = np.flatnonzero(places < 0)
    row_of_cut = np.searchsorted(rows, cuts, side="right") - 1
    cuts_before = np.searchsorted(cuts, rows)
    # A segment ends at each cut and at the end of each row.
    stops = np.sort(np.concatenate((cuts, rows[1:])), kind="stable")
    segments = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends[stops])).astype(np.int32)), pa.array(ids.astype(np.int32)))
    unknown = words.take(pa.array(cuts)).dictionary_encode()
    width = max(1, len(unknown.dictionary))
    distinct, which = np.unique(row_of_cut * width + unknown.indices.to_numpy().astype(np.int64), return_inverse=True)
    first = np.searchsorted(distinct, np.arange(len(rows)) * width)
    return pa.RecordBatch.from_arrays(
        [
            carried,
            pa.ListArray.from_arrays(pa.array((cuts_before + np.arange(len(rows))).astype(np.int32)), segments),
            pa.ListArray.from_arrays(
                pa.array(first.astype(np.int32)), unknown.dictionary.take(pa.array(distinct % width))
            ),
            pa.ListArray.from_arrays(
                pa.array(cuts_before.astype(np.int32)), pa.array((which - first[row_of_cut]).astype(np.int32))
            ),
        ],
        names=["carried", "segments", "rare", "rare_at"],
    )


def slices(rows: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` values, given the rows' offsets."""
    at = 0
    while at < len(rows) - 1:
        end = max(at + 1, int(np.searchsorted(rows, rows[at] + most, side="right")) - 1)
        yield at, end
        at = end


def _looking_up(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Dictionary = shared.value
        for batch in batches:
            words, rows = _row_lists(batch.column(1))
            places = known.places(words)
            for a, b in slices(rows, SLICE_WORDS):
                lo, hi = rows[a], rows[b]
                own = words.slice(lo, hi - lo)
                yield _cut(batch.column(0).slice(a, b - a), own, rows[a : b + 1] - lo, places[lo:hi], known)
        known.forget()

    return run


def frequent_words(docs: DataFrame, text_column: str, dictionary_size: int) -> DataFrame:
    """The words with the most occurrences in all texts: all from some count on, ``dictionary_size`` at most.

    The count comes from a histogram in bins of an eighth of a power of two, so no task orders the words.
    """
    counted = docs.select(F.explode(words_of(docs[text_column])).alias("word")).groupBy("word").count()
    counts = written(counted.withColumn("bin", F.floor(8 * F.log2("count")).cast("int")), "words")
    bins = sorted(((r["bin"], r["count"]) for r in counts.groupBy("bin").count().collect()), reverse=True)
    least, held = None, 0
    for number, n in bins:  # some hundreds
        held += n
        if held > dictionary_size:
            break
        least = number
    return counts.filter(F.col("bin") >= least if least is not None else F.lit(False)).select("word")


def _folded_words(frequent: DataFrame, vocabulary: Ranks) -> DataFrame:
    """word and ids. The words are dealt out and written first: a plan with an exchange is kept by the driver, and logged,
    anew after each stage, here with the fold's long expression."""
    parts = frequent.sparkSession.sparkContext.defaultParallelism * 2
    words = written(frequent.repartition(parts, "word"), "frequent")
    return vocabulary.beside(words).select("word", vocabulary.fold(F.array("word")).getItem(0).alias("ids"))


def _encoded(docs: DataFrame, carried: Column, vocabulary: Ranks, text_column: str, dictionary_size: int) -> DataFrame:
    """carried, ids and decoded."""
    release()  # what was read to make the vocabulary
    folded = _folded_words(frequent_words(docs, text_column, dictionary_size), vocabulary)
    known = Dictionary.of(folded.toArrow(), vocabulary.largest)  # at most dictionary_size rows
    pa.default_memory_pool().release_unused()
    cut = docs.select(carried.alias("carried"), words_of(docs[text_column]).alias("words"))
    added = StructType.fromDDL("segments array<array<int>>, rare array<string>, rare_at array<int>")
    schema = StructType([cut.schema.fields[0], *added.fields])
    looked_up = cut.mapInArrow(_looking_up(docs.sparkSession.sparkContext.broadcast(known)), schema)
    ids = _let(
        vocabulary.fold(F.col("rare")),
        lambda rare: F.flatten(
            F.zip_with(
                "segments",
                "rare_at",
                lambda s, k: F.when(k.isNull(), s).otherwise(F.concat(s, F.element_at(rare, k + 1))),
            )
        ),
    )
    whole = F.when(F.size("rare") == 0, F.flatten("segments")).otherwise(ids)
    found = vocabulary.beside(looked_up).select("carried", vocabulary.decode(whole).alias("found"))
    return found.select("carried", "found.ids", "found.decoded")


def encoded(
    docs: DataFrame,
    ranks: dict[bytes, int],
    id_column: str = "doc_id",
    text_column: str = "text",
    dictionary_size: int = DICTIONARY_SIZE,
) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (the bytes the ids stand for)."""
    vocabulary = Ranks(docs.sparkSession, ranks)
    found = _encoded(docs, docs[id_column], vocabulary, text_column, dictionary_size)
    return found.select(F.col("carried").alias("doc_id"), "ids", "decoded")


def round_trip(
    docs: DataFrame, ranks: dict[bytes, int], text_column: str = "text", dictionary_size: int = DICTIONARY_SIZE
) -> DataFrame:
    """``docs`` with ids and decoded."""
    vocabulary = Ranks(docs.sparkSession, ranks)
    whole = F.struct(*[docs[c] for c in docs.columns])
    found = _encoded(docs, whole, vocabulary, text_column, dictionary_size)
    return found.select("carried.*", "ids", "decoded")
