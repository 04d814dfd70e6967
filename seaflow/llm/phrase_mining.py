"""Phrases of two to five words that stand together more often than their parts explain, for each language.

Counts of phrases are held in weighted acyclic automata (``Transducer``): the states are the prefixes of phrases, an
arc reads a word, the weight of a state is the number of occurrences of what leads to it. Three passes read the texts:

1. words are counted; a phrase counted ``least`` times has no word counted less;
2. pairs of such words are counted by a hash of 48 bits, as sorted blocks of differences; a longer phrase has no pair
   counted less, whatever pairs share its hash;
3. each shard sorts its phrases of such pairs and builds a transducer from them, prefix by prefix, which is cut into
   ranges of prefixes. The transducers of a range meet in one task and are united, equal paths adding their weights;
   states below ``least`` go.

What passes 1 and 2 found reaches the next pass as a Bloom filter of ``FILTER_BITS``, whatever the number of phrases:
a false hit costs work and is dropped when the weights are summed, so counts are exact. Ranges begin at occurrences of
pairs drawn by shards, about ``MOST_RANGES`` at most; a first word in a third of all phrases is spread over many.

A cut of a phrase needs the counts of both parts. That of the first part is the weight of a state on the phrase's own
path. The rest is sent to its own range as a query, and the queries are composed with the transducer there: they run
through its arcs as a sorted stream, which may be longer than memory. Single words are joined with the word counts.

A phrase is contained in a longer one of the same count only if it is in one of one word more, which has it as its
first part or its rest, so the counts of the cuts decide that too.

Defined results: a null text is empty and has no words, a null language is ``und``; repeated rows count each time;
an empty table gives no phrases; texts of any length are counted whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaflow.llm.storage import written

LEAST = 100
MOST_WORDS = 5
SLICE_BYTES = 1 << 23  # texts of a task that are counted at once, or one text where it is longer
FILTER_BITS = 1 << 27
RANGE_OCCURRENCES = 1 << 22
MOST_RANGES = 1 << 16
KEY_BITS = 48

_FACTOR = 0x2545F491
_PRIME, _FACTORS = (1 << 31) - 1, (0x5851F42D, 0x4C957F2D, 0x14057B7F)  # of the places of a key in a filter
_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(
    0x20 if b == 0x09 else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
_HIGHEST = 1 << 21  # words of one transducer that fit three to a sort key


# Words of shards


@dataclass
class Stream:
    """Words of one language: ``codes`` of ``words``, -1 between pieces."""

    lang: str
    words: list[bytes]
    codes: np.ndarray


def _stream(lang: str, texts: list[bytes]) -> Stream:
    tokens = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" " + _BREAK + b" ").split()
    seen: dict[bytes, int] = {_BREAK: -1}
    first = np.fromiter(map(seen.setdefault, tokens, count()), np.int64, len(tokens))
    places = np.cumsum(first == np.arange(len(first))) - 1
    del seen[_BREAK]
    return Stream(lang, list(seen), np.where(first < 0, -1, places[first]))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[Stream]:
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, raw in zip(langs, batch.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(raw)
            size += len(raw)
            if size >= SLICE_BYTES:
                yield from (_stream(*x) for x in held.items())
                held, size = {}, 0
    yield from (_stream(*x) for x in held.items())


# Bloom filters: the same places from words in tasks and from columns in Spark


@dataclass
class Filter:
    bits: np.ndarray  # bytes, least significant bit first

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for factor in _FACTORS:
            place = (keys % _PRIME * factor >> 22) % (8 * len(self.bits))
            found &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return found


def _hashes(stream: Stream) -> np.ndarray:
    start = zlib.crc32(stream.lang.encode() + b"\n")
    return np.fromiter((zlib.crc32(w, start) for w in stream.words), np.int64, len(stream.words))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of pairs, from the hashes of their words."""
    with np.errstate(over="ignore"):
        mixed = (a * _FACTOR + b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _word_key() -> Column:
    return F.crc32(F.encode(F.concat("lang", F.lit("\n"), "word"), "UTF-8"))


def _filter(rows: DataFrame, key: Column, bits: int = FILTER_BITS) -> Broadcast:
    """Of a key of rows. Its size is ``bits``, however many rows there are."""
    places = F.explode(F.array(*[F.shiftright(key % _PRIME * factor, 22) % bits for factor in _FACTORS])).alias("place")
    blocks = (
        rows.select(places)
        .groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
        .toArrow()
    )
    found = np.zeros(bits // 8, np.uint8)
    for block, part in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist()):
        found[(block - 1) * 4096 : block * 4096] = np.frombuffer(part, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(Filter(found))


def _known_words(stream: Stream, words: Filter) -> np.ndarray:
    """Codes, -1 for words that aren't in the filter."""
    known = words.has(_hashes(stream))
    return np.where((stream.codes >= 0) & np.append(known, False)[stream.codes], stream.codes, -1)


# Transducers


def _order(codes: np.ndarray) -> np.ndarray:
    """Places of rows of codes (-1 behind a path) in ascending order."""
    if len(codes) and int(codes.max()) + 1 < _HIGHEST:
        c = np.pad(codes.astype(np.int64) + 1, ((0, 0), (0, 6 - codes.shape[1])))
        keys = [(c[:, k] * _HIGHEST + c[:, k + 1]) * _HIGHEST + c[:, k + 2] for k in (0, 3)]
        return np.lexsort((keys[1], keys[0]))
    return np.lexsort(tuple(codes[:, k] for k in range(codes.shape[1] - 1, -1, -1)))


@dataclass
class Transducer:
    """States in the order of their paths: ``depth`` words lead to each, the last is ``label`` (of ``words``), and
    ``weight`` occurrences follow the path. A state comes after the one it is reached from."""

    words: list[bytes]  # ascending
    depth: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(words: list[bytes], paths: np.ndarray) -> Transducer:
        """From paths in ascending order, a row of codes each, -1 behind the last: each adds the states of its words
        behind what it has in common with the one before."""
        differs = np.ones(paths.shape, bool)
        differs[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
        new = differs & (paths >= 0)
        at, depth = np.nonzero(new)
        # Paths through a state follow one another; the next state of its depth or less begins behind them.
        weight = np.empty(len(at), np.int64)
        for d in range(paths.shape[1]):
            mine = depth == d
            ends = np.flatnonzero(differs[:, d])
            ends = np.append(ends, len(paths))
            weight[mine] = ends[np.searchsorted(ends, at[mine], side="right")] - at[mine]
        return Transducer(words, depth + 1, paths[at, depth], weight)

    def paths(self) -> np.ndarray:
        """The row of codes of each state, -1 behind the last."""
        most = int(self.depth.max()) if len(self.depth) else 1
        at = np.arange(len(self.depth))
        codes = np.full((len(at), max(MOST_WORDS, most)), -1, np.int64)
        for d in range(1, most + 1):
            last = np.maximum.accumulate(np.where(self.depth == d, at, 0))
            deep = self.depth >= d
            codes[deep, d - 1] = self.label[last[deep]]
        return codes

    @staticmethod
    def united(parts: list[Transducer]) -> Transducer:
        """Equal paths become one with the sum of their weights."""
        if len(parts) == 1:
            return parts[0]
        words = sorted(set().union(*[p.words for p in parts]))
        place = {w: i for i, w in enumerate(words)}
        codes = []
        for p in parts:
            moved = np.array([*[place[w] for w in p.words], -1], np.int64)
            codes.append(moved[p.paths()])
        return Transducer._summed(words, np.concatenate(codes), np.concatenate([p.weight for p in parts]))

    @staticmethod
    def _summed(words: list[bytes], codes: np.ndarray, weight: np.ndarray) -> Transducer:
        order = _order(codes)
        codes, weight = codes[order], weight[order]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(axis=1))) if len(codes) else np.empty(0, int)
        codes, weight = codes[first], np.add.reduceat(weight, first) if len(first) else weight
        depth = (codes >= 0).sum(axis=1)
        return Transducer(words, depth, codes[np.arange(len(depth)), depth - 1], weight)

    def chosen(self, keep: np.ndarray) -> Transducer:
        """With some states alone, which hold the ones they are reached from; words that aren't read go."""
        label = self.label[keep]
        used = np.unique(label)
        return Transducer([self.words[i] for i in used], self.depth[keep], np.searchsorted(used, label), self.weight[keep])

    def weights(self, asked: list[list[bytes]]) -> np.ndarray:
        """Composition with paths: the weight each leads to, 0 where there is no arc."""
        place = {w: i for i, w in enumerate(self.words)}
        codes, n = self.paths(), len(self.depth)
        state = np.zeros(len(asked), np.int64)  # the first state behind the prefix read so far, and the end of them
        end = np.full(len(asked), n, np.int64)
        lengths = np.fromiter(map(len, asked), np.int64, len(asked))
        # A prefix's states are a stretch of the order, in which the next word's codes ascend.
        for d in range(int(lengths.max()) if len(asked) else 0):
            code = np.fromiter((place.get(p[d], -2) if d < len(p) else -1 for p in asked), np.int64, len(asked))
            step = lengths > d
            column = codes[:, d] if d < codes.shape[1] else np.full(n, -1)
            state, end = _narrowed(column, state, end, code, step)
        found = np.zeros(len(asked), np.int64)
        some = (end > state) & (lengths > 0)
        found[some] = np.where(self.depth[state[some]] == lengths[some], self.weight[state[some]], 0)
        return found


def _narrowed(column: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray, step: np.ndarray):
    """The stretches of ``column`` within [start, end), ascending there, that equal ``code``, by bisection of all."""

    def bound(right: bool) -> np.ndarray:
        lo, hi = start.copy(), end.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            value = column[np.minimum(mid, len(column) - 1)]
            less = (value <= code if right else value < code) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        return lo

    return np.where(step, bound(False), start), np.where(step, bound(True), end)


# The three passes


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words; those of the null word are of all words."""
    for stream in _streams(batches):
        codes = stream.codes[stream.codes >= 0]
        counts = np.bincount(codes, minlength=len(stream.words))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([stream.lang] * (len(counts) + 1)),
                pa.array([*stream.words, None], pa.binary()).cast(pa.string()),
                pa.array(np.append(counts, len(codes))),
            ],
            names=["lang", "word", "n"],
        )


_PAIRS = "part int, keys binary, counts binary, lang string, first string, second string"


def _narrow(values: np.ndarray) -> bytes:
    """A byte for the width of the numbers, and the numbers."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counting_pairs(words: Broadcast, parts: int, share: float):
    """Counts of pairs of known words by their keys, in a block for each of ``parts`` ranges of keys; and pairs, spelled,
    of which each occurrence is drawn with the probability ``share``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for number, stream in enumerate(_streams(batches)):
            codes = _known_words(stream, words.value)
            a, b = codes[:-1], codes[1:]
            both = (a >= 0) & (b >= 0)
            n = max(1, len(stream.words))
            pairs, counts = np.unique(a[both] * n + b[both], return_counts=True)
            hashes = np.append(_hashes(stream), 0)
            keys, summed = _summed(_mixed(hashes[pairs // n], hashes[pairs % n]), counts)
            part = keys * parts >> KEY_BITS
            own, first = np.unique(part, return_index=True)
            ends = [*first[1:], len(keys)]
            drawn = np.flatnonzero(np.random.default_rng((shard, number)).binomial(counts, share))
            spelled = [(stream.words[p // n].decode(), stream.words[p % n].decode()) for p in pairs[drawn].tolist()]
            m, k = len(own), len(drawn)
            columns = {
                "part": pa.array([*own.tolist(), *range(k)], pa.int32()),
                "keys": pa.array([_narrow(np.diff(keys[x:y], prepend=0)) for x, y in zip(first, ends)] + [None] * k, pa.binary()),
                "counts": pa.array([_narrow(summed[x:y]) for x, y in zip(first, ends)] + [None] * k, pa.binary()),
                "lang": pa.array([None] * m + [stream.lang] * k, pa.string()),
                "first": pa.array([None] * m + [x for x, _ in spelled], pa.string()),
                "second": pa.array([None] * m + [y for _, y in spelled], pa.string()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _summing_pairs(least: int):
    """Rows come sorted by range. The keys counted ``least`` times or more; drawn pairs go through."""

    def batch_of(keys: list, langs: list, firsts: list, seconds: list) -> pa.RecordBatch:
        columns = [pa.array(keys, pa.int64()), *[pa.array(x, pa.string()) for x in (langs, firsts, seconds)]]
        return pa.RecordBatch.from_arrays(columns, names=["key", "lang", "first", "second"])

    def finished(held: list) -> pa.RecordBatch:
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
        keys = keys[counts >= least].tolist()
        return batch_of(keys, *[[None] * len(keys)] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, waiting = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["keys"] is None:
                    yield batch_of([None], [row["lang"]], [row["first"]], [row["second"]])
                    continue
                if row["part"] != part and held:
                    yield finished(held)
                    held, waiting = [], 0
                part = row["part"]
                held.append((np.cumsum(_wide(row["keys"])), _wide(row["counts"])))
                waiting += len(held[-1][0])
                if len(held) > 1 and waiting >= max(1 << 20, len(held[0][0])):
                    held, waiting = [_summed(*(np.concatenate(x) for x in zip(*held)))], 0
        if held:
            yield finished(held)

    return run


_TRANSDUCER = "part int, lang string, words array<binary>, depth binary, label binary, weight binary"


def _columns(part: int, lang: str, t: Transducer) -> dict[str, pa.Array]:
    return {
        "part": pa.array([part], pa.int32()),
        "lang": pa.array([lang], pa.string()),
        "words": pa.array([t.words], pa.list_(pa.binary())),
        "depth": pa.array([t.depth.astype(np.int8).tobytes()], pa.binary()),
        "label": pa.array([t.label.astype("<i4").tobytes()], pa.binary()),
        "weight": pa.array([t.weight.astype("<i8").tobytes()], pa.binary()),
    }


def _transducer(row: dict) -> Transducer:
    return Transducer(
        row["words"],
        np.frombuffer(row["depth"], np.int8).astype(np.int64),
        np.frombuffer(row["label"], "<i4").astype(np.int64),
        np.frombuffer(row["weight"], "<i8").astype(np.int64),
    )


def _paths(stream: Stream, words: Filter, pairs: Filter, most_words: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a shard in ascending order, and a sorted row of codes for each place where a known pair begins: as
    many words, ``most_words`` at most, as follow one another in known pairs."""
    codes = _known_words(stream, words)
    used = np.unique(codes[codes >= 0])
    spelled = [stream.words[i] for i in used]
    order = sorted(range(len(used)), key=spelled.__getitem__)
    place = np.full(len(stream.words) + 1, -1, np.int64)
    place[used[order]] = np.arange(len(used))
    hashes = np.append(_hashes(stream), 0)
    a, b = codes[:-1], codes[1:]
    pair = np.zeros(len(codes) + most_words, bool)
    at = np.flatnonzero((a >= 0) & (b >= 0))
    pair[at] = pairs.has(_mixed(hashes[a[at]], hashes[b[at]]))
    codes = np.append(place[codes], np.full(most_words, -1))
    at = np.flatnonzero(pair)
    paths = np.full((len(at), most_words), -1, np.int64)
    paths[:, 0], goes_on = codes[at], np.ones(len(at), bool)
    for d in range(1, most_words):
        goes_on &= pair[at + d - 1]
        paths[goes_on, d] = codes[at[goes_on] + d]
    return [spelled[i] for i in order], paths[_order(paths)]


def _building(words: Broadcast, pairs: Broadcast, starts: list[tuple], most_words: int):
    """The transducers of a shard's phrases, one for each range of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _streams(batches):
            spelled, paths = _paths(stream, words.value, pairs.value, most_words)
            first = bisect_left(starts, (stream.lang,))
            own = starts[first : bisect_left(starts, (stream.lang + "\0",))]
            heads = paths[:, 0] * len(spelled) + paths[:, 1]
            cuts = [0]
            for _, a, b in own:
                at = bisect_left(spelled, a)
                met = at < len(spelled) and spelled[at] == a
                cuts.append(int(np.searchsorted(heads, at * len(spelled) + (bisect_left(spelled, b) if met else 0))))
            for n, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(paths)])):
                if lo < hi:
                    t = Transducer.of(spelled, paths[lo:hi])
                    columns = _columns(first + n, stream.lang, t.chosen(np.ones(len(t.depth), bool)))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


_CUT = "phrase string, a long, k int, first string, rest string, l long"


def _cuts(lang: str, t: Transducer, starts: list[tuple]) -> dict[str, list]:
    """Each phrase of two words or more with each of its cuts, for the range of the rest; l is that of two words or
    more alone."""
    codes, weight = t.paths(), t.weight.tolist()
    rows: dict[str, list] = {name: [] for name in ("part", "phrase", "a", "k", "first", "rest", "l")}
    above = [0] * (MOST_WORDS + codes.shape[1] + 1)
    for at, (depth, path) in enumerate(zip(t.depth.tolist(), codes.tolist())):
        above[depth] = weight[at]
        words = [t.words[c] for c in path[:depth]]
        for k in range(1, depth):
            rest = words[k:]
            rows["part"].append(bisect_right(starts, (lang, rest[0], rest[1])) if len(rest) > 1 else None)
            rows["phrase"].append(b" ".join(words))
            rows["a"].append(weight[at])
            rows["k"].append(k)
            rows["first"].append(b" ".join(words[:k]))
            rows["rest"].append(b" ".join(rest))
            rows["l"].append(above[k] if k > 1 else None)
    return rows


def _both(columns: dict[str, pa.Array], cuts: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    """Rows of a transducer (with columns) or of cuts in one schema."""
    kinds = {"part": pa.int32(), "lang": pa.string(), "words": pa.list_(pa.binary()), "depth": pa.binary(), "label": pa.binary(), "weight": pa.binary(), "phrase": pa.string(), "a": pa.int64(), "k": pa.int32(), "first": pa.string(), "rest": pa.string(), "l": pa.int64()}
    found = columns | cuts
    return pa.RecordBatch.from_arrays([found[c] if c in found else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def _uniting(least: int, starts: list[tuple]):
    """Rows of a partition come sorted by range and language. A range is held once, with what has not been added yet."""

    def finished(part: int, lang: str, held: list[Transducer]) -> Iterator[pa.RecordBatch]:
        t = Transducer.united(held)
        t = t.chosen(t.weight >= least)
        if len(t.depth):
            yield _both(_columns(part, lang, t), {}, 1)
            rows = _cuts(lang, t, starts)
            for at in range(0, len(rows["k"]), 50_000):
                some = {c: v[at : at + 50_000] for c, v in rows.items()}
                n = len(some["k"])
                texts = {c: pa.array(some[c], pa.binary()).cast(pa.string()) for c in ("phrase", "first", "rest")}
                numbers = {"part": pa.array(some["part"], pa.int32()), "a": pa.array(some["a"], pa.int64()), "k": pa.array(some["k"], pa.int32()), "l": pa.array(some["l"], pa.int64())}
                yield _both({}, {"lang": pa.array([lang] * n), **texts, **numbers}, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, waiting = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["lang"]) != key:
                    if held:
                        yield from finished(*key, held)
                    key, held, waiting = (row["part"], row["lang"]), [], 0
                held.append(_transducer(row))
                waiting += len(held[-1].depth)
                if len(held) > 1 and waiting >= max(1 << 20, len(held[0].depth)):
                    held, waiting = [Transducer.united(held)], 0
        if held:
            yield from finished(*key, held)

    return run


def _composing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and language, the transducer before the cuts that ask for a rest there."""
    key, known = None, None
    for batch in batches:
        rows = batch.to_pylist()
        found = []
        at = 0
        while at < len(rows):
            row = rows[at]
            if row["words"] is not None:
                key, known = (row["part"], row["lang"]), _transducer(row)
                at += 1
                continue
            end = at
            while end < len(rows) and rows[end]["words"] is None and (rows[end]["part"], rows[end]["lang"]) == key:
                end += 1
            if end == at:
                raise ValueError("a rest is in no range")
            weights = known.weights([r["rest"].encode().split(b" ") for r in rows[at:end]])
            found += [r | {"r": w} for r, w in zip(rows[at:end], weights.tolist())]
            at = end
        kinds = {"lang": pa.string(), "phrase": pa.string(), "a": pa.int64(), "k": pa.int32(), "first": pa.string(), "rest": pa.string(), "l": pa.int64(), "r": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in kinds.items()], names=list(kinds))


def frequent_parts(docs: DataFrame, least: int, most_words: int, lang_column: str, text_column: str):
    """The counts of words (that of the null word is of all), and every cut (lang, phrase, a, k, first, rest, l, r) of
    every phrase of ``least`` occurrences."""
    texts = docs.select(
        F.coalesce(docs[lang_column], F.lit("und")).alias("lang"), F.coalesce(docs[text_column], F.lit("")).alias("text")
    )
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(counted.filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    known = _filter(words.filter("word is not null"), _word_key())
    n = int(words.filter("word is null").agg(F.sum("n")).first()[0] or 0)
    fewest = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(fewest, n // RANGE_OCCURRENCES))
    pairs = texts.mapInArrow(_counting_pairs(known, ranges, min(1.0, ranges / max(1, n))), _PAIRS)
    pairs = pairs.repartition(ranges, "part").sortWithinPartitions("part")
    pairs = written(pairs.mapInArrow(_summing_pairs(least), "key long, lang string, first string, second string"), "pairs")
    drawn = pairs.filter("key is null").select("lang", "first", "second").distinct().collect()  # about one a range
    starts = sorted((r[0], r[1].encode(), r[2].encode()) for r in drawn)
    known_pairs = _filter(pairs.filter("key is not null"), F.col("key"))
    parts = len(starts) + 1
    shards = texts.mapInArrow(_building(known, known_pairs, starts, most_words), _TRANSDUCER)
    dealt = shards.repartition(parts, "part").sortWithinPartitions("part", "lang")
    united = written(dealt.mapInArrow(_uniting(least, starts), f"{_TRANSDUCER}, {_CUT}"), "phrases")
    known.destroy()
    known_pairs.destroy()
    by_range = united.filter("part is not null").repartition(parts, "part")
    asked = by_range.sortWithinPartitions("part", "lang", F.col("words").isNull())
    cut = "lang string, phrase string, a long, k int, first string, rest string, l long, r long"
    longer = asked.mapInArrow(_composing, cut)
    one = words.filter("word is not null")
    last = united.filter("part is null").select("lang", "phrase", "a", "k", "first", "rest", "l")
    last = last.join(one.select("lang", F.col("word").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = written(longer.unionByName(last), "cuts")
    single = cuts.filter("k = 1").drop("l").join(one.select("lang", F.col("word").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    return words, cuts.filter("k > 1").unionByName(single)


def collocations(
    docs: DataFrame,
    most: int = 2000,
    least: int = LEAST,
    most_words: int = MOST_WORDS,
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """The first ``most`` phrases of each language by score: lang, rank, phrase, a (its occurrences), l and r (those of
    the two parts of its lowest-scoring cut), n (words of the language) and score, ``floor(1000 * a * n / (l * r))``.

    Phrases have two to ``most_words`` words and ``least`` occurrences; those that a longer one contains and that occur
    no more often are left out."""
    words, cuts = frequent_parts(docs, least, most_words, lang_column, text_column)
    totals = words.filter("word is null").select("lang", "n")
    # A product of two such numbers and a thousand has 39 digits at most; the counts of a corpus leave it far below.
    score = F.expr("(1000 * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    pieces = F.size(F.split("phrase", " "))
    in_longer = cuts.filter(pieces > 2).select(
        "lang",
        F.explode(
            F.array_compact(
                F.array(
                    F.when((F.col("k") == 1) & (F.col("a") >= F.col("r")), F.col("rest")),
                    F.when((F.col("k") == pieces - 1) & (F.col("a") >= F.col("l")), F.col("first")),
                )
            )
        ).alias("phrase"),
    )
    kept = best.join(in_longer.distinct(), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
