"""Sequences for training without padding: every document is cut into pieces whose lengths are powers of two.

A document's ids, with an end id behind them, give as many pieces of ``most`` (4096) tokens as fit, then one for each
binary digit of the rest, the longest first. Each piece is a sequence of its own, so none crosses documents, and a
length that is a power of two needs no padding. Pieces of one length make a bucket: sequence ids hold the bucket above
the partition and the place within it, so each bucket is a range of ids, and ``write`` puts each into a folder of its
own, from which batches of equal shape are read.

Nothing is shuffled and nothing is gathered: a piece and its id come from one pass over the documents. Ids are the same
whenever the same files are read with the same partitions.

The tokenizer must drop ASCII white space and never look across it, which is checked on a sample; words between white
space are then encoded once, as long as they are kept (``KEPT_WORDS`` a worker), instead of wherever they occur.
Special strings in a text are treated as the library does by default.

Defined results: a null or empty text is a document of its end id alone; texts of any length are packed whole; repeated
rows are packed each by itself, so rows of one doc_id differ by their sequences; an empty table gives no pieces.
Other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seaflow.llm.byte_bpe import _row_lists, slices

MOST = 4096
KEPT_WORDS = 900_000  # per Python worker
SLICE_WORDS = 1 << 19
_PARTITION_BITS, _PLACE_BITS = 24, 34

# Fixed value: the pattern by which the word-end vocabulary parts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# What that pattern and the normalizers make of these is known: stops behind a letter are a word by themselves, and a
# word of these letters alone is one word, in lower case.
_STOPPED = "^(?s:(?P<front>.*[A-Za-zß-öø-ÿ])(?P<stops>[.,;:!?#$%&*]+))$"
_LETTERS = "^[a-zß-öø-ÿ]+$"


class _Words:
    """Ids of words, each encoded once while it is kept. Slot 0 is the empty text."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer, self.bare = Tokenizer.from_str(definition), None
        if self._ids([" \t\r\n\x0b\x0c", "A b,\t\n c."]) != [[], sum(self._ids(["A", "b,", "c."]), [])]:
            raise ValueError("the tokenizer keeps white space or looks across it")
        parts = json.loads(definition)
        normal, cut_by = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}
        if {"type": "Lowercase"} in normal.get("normalizers", ()) and any(
            p.get("pattern") == {"Regex": PATTERN} for p in cut_by.get("pretokenizers", ())
        ):
            parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": cut_by["pretokenizers"][-1]}
            self.bare = Tokenizer.from_str(json.dumps(parts))
        self.forget()

    def _ids(self, texts: list[str], bare: bool = False) -> list[list[int]]:
        tokenizer = self.bare if bare else self.tokenizer
        return [coded.ids for coded in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(2, np.int64)

    def _learn(self, words: list[str], bare: bool) -> None:
        found = self._ids(words, bare)
        ids = np.fromiter(chain.from_iterable(found), "<u4")
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + self.ends[-1]
        self.slots.update(zip(words, range(len(self.slots), len(self.slots) + len(words))))
        self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, ends))

    def _slots(self, words: pa.Array) -> np.ndarray:
        """The slot of each of an array of words."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [w for w in distinct if w not in self.slots]
        letters = pc.match_substring_regex(pa.array(missing, pa.string()), _LETTERS).to_numpy(zero_copy_only=False).tolist()
        for bare in (True, False):
            words = [w for w, plain in zip(missing, letters) if (plain and self.bare is not None) == bare]
            if words:
                self._learn(words, bare)
        places = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))
        return places[coded.indices.to_numpy(zero_copy_only=False)]

    def of(self, words: pa.Array) -> np.ndarray:
        """Two slots for each word: its ids are those of the one, then those of the other."""
        if len(self.slots) > KEPT_WORDS:
            self.forget()
        coded = words.dictionary_encode()
        front, stops = coded.dictionary, np.zeros(len(coded.dictionary), np.int64)
        if self.bare is not None:
            parts = pc.extract_regex(front, _STOPPED)
            stops = self._slots(pc.fill_null(pc.struct_field(parts, "stops"), ""))
            front = pc.coalesce(pc.struct_field(parts, "front"), front)
            plain = pc.and_(pc.string_is_ascii(front), pc.invert(pc.match_substring(front, "<")))
            front = pc.if_else(plain, pc.ascii_lower(front), front)
        both = np.stack((self._slots(front), stops), axis=1)
        return both[coded.indices.to_numpy(zero_copy_only=False)].reshape(-1)


@lru_cache(maxsize=1)
def _words(definition: str) -> _Words:
    return _Words(definition)


def _documents_ids(slots: np.ndarray, rows: np.ndarray, known: _Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents one after the other, each with the end id, and the documents' lengths."""
    starts, lengths = known.ends[slots], known.ends[slots + 1] - known.ends[slots]
    ends = np.cumsum(lengths)
    within = np.arange(int(ends[-1]) if len(ends) else 0)
    ids = known.ids[np.repeat(starts - ends + lengths, lengths) + within]
    stops = np.concatenate(([0], ends))[rows]
    return np.insert(ids, stops[1:], end_id), np.diff(stops) + 1


def cut(totals: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Number of the document and length of each piece of documents of so many tokens, in order."""
    wholes = totals // most
    digits = (totals[:, None] % most >> np.arange(most.bit_length() - 2, -1, -1)) & 1
    rest, place = np.nonzero(digits)
    document = np.concatenate((np.repeat(np.arange(len(totals)), wholes), rest))
    length = np.concatenate((np.full(int(wholes.sum()), most), 1 << (most.bit_length() - 2 - place)))
    order = np.lexsort((-length, document))
    return document[order], length[order]


_PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long"


def _packing(definition: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        filled = np.zeros(most.bit_length(), np.int64)
        for batch in batches:
            words, rows = _row_lists(pc.ascii_split_whitespace(batch.column(1).cast(pa.string())))
            known = _words(definition)
            slots = known.of(words)
            for a, b in slices(rows, SLICE_WORDS):
                ids, totals = _documents_ids(slots[2 * rows[a] : 2 * rows[b]], 2 * (rows[a : b + 1] - rows[a]), known, end_id)
                document, length = cut(totals, most)
                bucket = np.log2(length).astype(np.int64)
                place = np.empty(len(length), np.int64)
                for e in range(most.bit_length()):
                    mine = np.flatnonzero(bucket == e)
                    place[mine] = filled[e] + np.arange(len(mine))
                    filled[e] += len(mine)
                before = np.concatenate(([0], np.cumsum(totals)))[document]
                ends = np.cumsum(length)
                offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(document)),
                        pa.array(ends - length - before),
                        pa.array(length),
                        pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]),
                        pa.array(totals[document]),
                        pa.array((((bucket << _PARTITION_BITS) | shard) << _PLACE_BITS) | place),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id"],
                )

    return run


def pack(
    docs: DataFrame, definition: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", most: int = MOST
) -> DataFrame:
    """A row for each piece, which is a sequence: doc_id, start (the document's ids before it), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id and offset, the place within the sequence
    (0). ``definition``: the JSON text of a tokenizer of that library; ``most``: a power of two."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    texts = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    schema = StructType([texts.schema["doc_id"], *StructType.fromDDL(_PIECE).fields])
    return texts.mapInArrow(_packing(definition, end_id, most), schema).withColumn("offset", F.lit(0).cast("long"))


def write(pieces: DataFrame, path: str) -> None:
    """The sequences as Parquet files under ``path``, a folder (bucket=…) for each length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
