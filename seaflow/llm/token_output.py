"""Token ids as binary blocks with Elias-Fano encoded document boundaries.

Documents are put in ascending order of doc_id by a range partitioning, encoded in this order, and written as blocks
of about ``BLOCK_IDS`` ids in Parquet files, the container every store reads. A block holds the ids of its documents
one after the other (little-endian, two bytes each where the vocabulary allows it, else four), the doc_ids, and the
documents' ends as an Elias-Fano sequence: the low bits of each end packed, the high bits in unary, with the rank of
every 512th bit. ``EliasFano.select`` gives an end from these, so no table of 64-bit offsets is kept; the space is
about 2 + log2(ids / documents) bits a document. Starts over all blocks are sums over partitions plus the block's start
within its partition.

Defined results: a null text is an empty one, a document of its end id alone; rows with null doc_id come first; rows
that repeat a doc_id follow each other by a hash of their text. A document is never cut, so one larger than a block
makes a block of its own. An empty table writes no block. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seaflow.llm.byte_bpe import SLICE_WORDS, _row_lists, slices, words_of

BLOCK_IDS = 1 << 22
ENCODED_AT_ONCE = 5_000
CACHED_WORDS = 500_000  # per Python worker; words beyond are encoded again where they occur
DIRECTORY_BITS = 512


@dataclass
class EliasFano:
    """A sequence of n numbers in ascending order below ``limit + 1``."""

    n: int
    low_bits: int
    low: np.ndarray  # packed bits
    high: np.ndarray  # packed bits, most significant first
    directory: np.ndarray  # ones before every DIRECTORY_BITS-th bit of high

    @staticmethod
    def of(values: np.ndarray, limit: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(limit // n).bit_length() - 1) if n else 0
        values = values.astype(np.int64)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        unary = np.zeros(n + (int(limit) >> low_bits) + 1, dtype=np.uint8)
        unary[(values >> low_bits) + np.arange(n)] = 1
        ones = np.concatenate(([0], np.cumsum(unary, dtype=np.int64)))
        return EliasFano(
            n, low_bits, np.packbits(bits.astype(np.uint8)), np.packbits(unary), ones[::DIRECTORY_BITS].astype(np.uint32)
        )

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """The numbers at some places of the sequence, from the stretches of the high bits that the directory gives."""
        stretch = np.searchsorted(self.directory, numbers, side="right") - 1
        needed, own = np.unique(stretch, return_inverse=True)
        size = DIRECTORY_BITS // 8
        padded = np.concatenate((self.high, np.zeros(-len(self.high) % size, np.uint8))).reshape(-1, size)
        row, bit = np.nonzero(np.unpackbits(padded[needed], axis=1))
        first = np.searchsorted(row, np.arange(len(needed)))
        places = stretch * DIRECTORY_BITS + bit[first[own] + numbers - self.directory[stretch].astype(np.int64)]
        at = numbers[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return ((places - numbers) << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def stretches(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents of some numbers begin and end, if the sequence holds the ends of all."""
        ends = self.select(numbers)
        return np.where(numbers > 0, self.select(np.maximum(numbers - 1, 0)), 0), ends


@lru_cache(maxsize=2)
def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text), {}


def _pieces(text: Column, definition: str) -> Column:
    """The words of a text. As in the library, the strings of added tokens are found first; what stands between two of
    them is cut into words by itself."""
    added = json.loads(definition).get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that look at what is around them are not supported")
    if not added:
        return words_of(text)
    given = F.coalesce(text, F.lit(""))
    # Of strings that begin at one place the library takes the longest.
    strings = sorted((t["content"] for t in added), key=lambda s: (-len(s), s))
    either = "|".join(re.sub(r"([^\w\s])", r"\\\1", s) for s in strings)
    between = F.split(given, f"(?:{either})", -1)
    found = F.regexp_extract_all(given, F.lit(f"({either})"), F.lit(1))
    cut = F.flatten(
        F.zip_with(
            F.transform(between, words_of), found, lambda words, token: F.concat(words, F.array_compact(F.array(token)))
        )
    )
    has = [F.contains(given, F.lit(s)) for s in strings]
    return F.when(F.greatest(*has, F.lit(False)), cut).otherwise(words_of(text))


def _words_to_ids(definition: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after the other and their offsets; the cache of the worker is bounded."""
    tokenizer, cache = _tokenizer(definition)
    missing = [w for w in words if w not in cache]
    found: dict[str, bytes] = {}
    for at in range(0, len(missing), ENCODED_AT_ONCE):
        part = missing[at : at + ENCODED_AT_ONCE]
        for word, coded in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            found[word] = np.array(coded.ids, dtype="<u4").tobytes()
    ids = [found[w] if w in found else cache[w] for w in words]
    if len(cache) + len(found) <= CACHED_WORDS:
        cache.update(found)
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
    return np.frombuffer(b"".join(ids), dtype="<u4"), offsets


def _encoding(definition: str, end_id: int, kind: str):
    last = np.array([end_id], dtype=kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows = _row_lists(batch.column(1))
            coded = words.dictionary_encode()
            flat, offsets = _words_to_ids(definition, coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            all_codes = coded.indices.to_numpy(zero_copy_only=False)
            for a, b in slices(rows, SLICE_WORDS):
                codes = all_codes[rows[a] : rows[b]]
                lengths = np.diff(offsets)[codes]
                ends = np.cumsum(lengths)
                places = np.repeat(offsets[codes] - ends + lengths, lengths) + np.arange(lengths.sum())
                ids = flat[places].astype(kind)
                bounds = np.concatenate(([0], ends))[rows[a : b + 1] - rows[a]]
                packed = [ids[x:y].tobytes() + last for x, y in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], names=["doc_id", "ids"]
                )

    return run


_BLOCK = (
    "shard int, number int, start long, n_docs int, n_ids long, width int, doc_ids array<long>, "
    "low_bits int, low binary, high binary, directory binary, ids binary"
)


def _blocks(width: int):
    def block(shard: int, number: int, start: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
        coded = EliasFano.of(ends, int(ends[-1]))
        row = {
            "shard": shard,
            "number": number,
            "start": start,
            "n_docs": len(ids),
            "n_ids": int(ends[-1]),
            "width": width,
            "doc_ids": doc_ids,
            "low_bits": coded.low_bits,
            "low": coded.low.tobytes(),
            "high": coded.high.tobytes(),
            "directory": coded.directory.astype("<u4").tobytes(),
            "ids": b"".join(ids),
        }
        kinds = dict(
            shard=pa.int32(), number=pa.int32(), start=pa.int64(), n_docs=pa.int32(), n_ids=pa.int64(), width=pa.int32(),
            doc_ids=pa.list_(pa.int64()), low_bits=pa.int32(), low=pa.binary(), high=pa.binary(),
            directory=pa.binary(), ids=pa.binary(),
        )
        return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and size + len(ids) > BLOCK_IDS * width:
                    yield block(shard, number, start, doc_ids, held)
                    number, start, doc_ids, held, size = number + 1, start + size // width, [], [], 0
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            yield block(shard, number, start, doc_ids, held)

    return run


def write(
    docs: DataFrame, path: str, definition: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Writes the blocks of ``docs`` under ``path``. ``definition``: the JSON text of a tokenizer of that library,
    whose words are those of the byte-level pattern."""
    spark = docs.sparkSession
    width = 2 if max(end_id, _tokenizer(definition)[0].get_vocab_size() - 1) < 1 << 16 else 4
    texts = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        F.xxhash64(docs[text_column]).alias("tie"),
        docs[text_column].alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Texts are ordered, not ids: they are smaller when compressed, and nothing is encoded twice for the sampling.
    ordered = texts.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    words = ordered.select("doc_id", _pieces(F.col("text"), definition).alias("words"))
    encode, pack = _encoding(definition, end_id, f"<u{width}"), _blocks(width)
    words.mapInArrow(lambda batches: pack(encode(batches)), _BLOCK).write.parquet(path)


def _boundaries(row: dict) -> EliasFano:
    return EliasFano(
        row["n_docs"],
        row["low_bits"],
        np.frombuffer(row["low"], np.uint8),
        np.frombuffer(row["high"], np.uint8),
        np.frombuffer(row["directory"], "<u4"),
    )


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            starts, ends = _boundaries(row).stretches(np.arange(row["n_docs"]))
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["shard_start"] + row["start"] + starts),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32))
                    ),
                ],
                names=["doc_id", "start", "ids"],
            )


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with the number of ids in all shards before theirs: a running sum over one row a shard."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each partition that wrote, so the broadcast is bounded by their number.
    return blocks.join(F.broadcast(shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))), "shard")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document, from the blocks under ``path``."""
    return _placed(spark, path).mapInArrow(_reading, "doc_id long, start long, ids array<int>")


def _finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            numbers = np.array(row["wanted"], np.int64)
            starts, ends = _boundaries(row).stretches(numbers)
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["doc_ids"][i] for i in numbers], pa.int64()),
                    pa.array(row["shard_start"] + row["start"] + starts),
                    pa.array([ids[a:b] for a, b in zip(starts, ends)], pa.list_(pa.int32())),
                ],
                names=["doc_id", "start", "ids"],
            )


def look_up(spark: SparkSession, path: str, asked: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What ``read`` gives, for the documents of the ids in ``asked`` alone: their places in the blocks are found by
    doc_id, their stretches of ids by ``select``; other documents aren't unpacked."""
    blocks = _placed(spark, path)
    places = spark.read.schema(_BLOCK).parquet(path).select("shard", "number", F.posexplode("doc_ids").alias("place", "doc_id"))
    ids = asked.select(asked[id_column].cast("long").alias("doc_id")).distinct()
    wanted = places.join(ids, "doc_id", "left_semi").groupBy("shard", "number").agg(F.collect_list("place").alias("wanted"))
    return blocks.join(wanted, ["shard", "number"]).mapInArrow(_finding, "doc_id long, start long, ids array<int>")


def _checking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _reading(batches):
        ids, rows = _row_lists(found.column(2))
        raw = ids.to_numpy().astype("<u4")
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(rows, rows[1:])]
        yield pa.RecordBatch.from_arrays(
            [found.column(0), found.column(1), pa.array(np.diff(rows)), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit numbers, from the blocks."""
    return _placed(spark, path).mapInArrow(_checking, "doc_id long, start long, n_tokens long, ids_crc32 long")
