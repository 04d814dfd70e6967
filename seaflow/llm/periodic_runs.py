"""Runs: stretches of words that repeat a shorter piece at least ``least_exponent`` times.

A run is a maximal pair. Two places of a text form one when the words from both on agree for L words and no more, and
the words before them differ; if they lie q apart and L reaches ``(least_exponent - 1) * q``, the L + q words from the
first place on have period q and can't be extended, so nothing is compared again.

Suffixes of a text's words are sorted by doubling their length (numpy, many texts at once); only suffixes that share
enough words with another of their text go on. Bottom-up over the tree of their LCP intervals, the places of the
smaller child are looked up among those of the larger, which are held in ascending order with the class of the word to
their left. Neighbours in that order, of different children and different left classes, within reach of each other,
are the runs: with L of at least twice the distance, places of one interval that lie close form a progression of the
interval's own period, so all but its first have one left class, all but its last one child, and pairs that aren't
neighbours repeat a run at a multiple of its smallest period. Each run is thus found once, by its smallest period.
Intervals whose nearest places lie further apart than their longest shared stretch allows hold no run and aren't built.

Texts are handled whole and each on its own: nothing is shuffled, and a task's memory grows with ``SLICE_WORDS`` or its
longest text. Words are ``[^\\x20\\x09-\\x0D]+``.

Defined results: a null or empty text has no words, no runs and an empty collapsed text. Repeated rows each get the
same result, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
SLICE_WORDS = 1 << 19  # sorted at once, or one text where it is longer

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _sorted_suffixes(codes: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose suffixes share ``least`` words or more with another one's, in suffix order, and the number of
    words each shares with the one before it. ``codes`` are negative at ends of texts; ``stop`` has the next end."""
    n = len(codes)
    own = codes >= 0
    counts = np.bincount(codes[own], minlength=n)
    rank = np.zeros(n, np.int64)
    rank[own] = (np.cumsum(counts) - counts + 1)[codes[own]]
    levels, width = [rank], 1
    open_places = np.flatnonzero(own)
    open_places = open_places[counts[codes[open_places]] > 1]
    kept = np.empty(0, np.int64)
    while len(open_places):
        key = rank[open_places] * (n + 1) + rank[np.minimum(open_places + width, stop[open_places])]
        order = np.argsort(key)
        open_places, key = open_places[order], key[order]
        at = np.arange(len(key))
        old = rank[open_places]
        slots = old + at - np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, at, 0))
        new = np.diff(key, prepend=-1) != 0
        rank = rank.copy()
        rank[open_places] = slots[np.maximum.accumulate(np.where(new, at, 0))]
        levels.append(rank)
        width *= 2
        alone = new & np.append(new[1:], True)
        open_places = open_places[~alone]
        if width * 2 > least >= width:
            kept = open_places
    kept = kept[np.argsort(rank[kept])]
    a, b = kept[:-1], kept[1:]
    same = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + same, stop[a]), np.minimum(b + same, stop[b])
        equal = (levels[level][x] == levels[level][y]) & (codes[x] >= 0)
        same[equal] += 1 << level
    return kept, np.concatenate((np.zeros(min(1, len(kept)), np.int64), same))


def _merged(a: list[int], b: list[int], shared: int, left: list[int], ratio: int, shortest: int, out: list) -> list[int]:
    """The places of two children of an interval in one ascending list; neighbours that make a run go to ``out``."""
    if len(a) < len(b):
        a, b = b, a
    reach = shared // ratio
    few = len(b) * 16 < len(a)
    for n, place in enumerate(b):
        k = bisect_left(a, place)
        if k and (not n or b[n - 1] < a[k - 1]):  # neighbours in the merged list
            before = a[k - 1]
            if place - before <= reach and left[before - 1] != left[place - 1] and place - before + shared >= shortest:
                out.append((before, place - before + shared, place - before))
        if k < len(a) and (n + 1 == len(b) or b[n + 1] > a[k]):
            after = a[k]
            if after - place <= reach and left[after - 1] != left[place - 1] and after - place + shared >= shortest:
                out.append((place, after - place + shared, after - place))
    if few:
        for place in b:
            a.insert(bisect_left(a, place), place)
    else:
        a += b
        a.sort()
    return a


def _pairs(places: list[int], shared: list[int], left: list[int], ratio: int, shortest: int) -> list[tuple]:
    """(start, length, period) of the runs among the suffixes of one interval, by its tree from the leaves up."""
    found: list[tuple] = []
    opened: list[tuple[int, list[int]]] = []
    current = [places[0]]
    for place, value in zip(places[1:], shared[1:]):
        while opened and opened[-1][0] >= value:
            depth, others = opened.pop()
            current = _merged(others, current, depth, left, ratio, shortest, found)
        opened.append((value, current))
        current = [place]
    while opened:
        depth, others = opened.pop()
        current = _merged(others, current, depth, left, ratio, shortest, found)
    return found


def _runs(codes: np.ndarray, stop: np.ndarray, least_length: int, least_exponent: int) -> list[tuple]:
    """(start, length, period) of every run; starts are places of ``codes``."""
    ratio = least_exponent - 1
    least = min(max(least_length - d, ratio * d) for d in range(1, least_length + 1))
    places, shared = _sorted_suffixes(codes, stop, least)
    if not len(places):
        return []
    starts = np.flatnonzero(shared < least)
    group = np.cumsum(shared < least)
    order = np.lexsort((places, group))
    gaps = np.where(np.diff(group[order], prepend=0) == 0, np.diff(places[order], prepend=0), len(codes))
    hopeful = np.minimum.reduceat(gaps, starts) * ratio <= np.maximum.reduceat(shared, starts)
    if not hopeful.any():
        return []
    left, found = codes.tolist(), []
    for a, b in zip(starts[hopeful], np.append(starts[1:], len(places))[hopeful]):
        found += _pairs(places[a:b].tolist(), shared[a:b].tolist(), left, ratio, least_length)
    return found


def runs_of(texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[list[tuple]]:
    """Of each list of words its runs (start, length, period), by start and period."""
    total = sum(map(len, texts)) + len(texts) + 1
    codes, stop = np.full(total, -1, np.int64), np.zeros(total, np.int64)
    firsts, at = [], 1
    for words in texts:
        firsts.append(at)
        end = at + len(words)
        codes[at:end] = np.fromiter(map({}.setdefault, words, count(at)), np.int64, len(words))
        stop[at : end + 1] = end
        at = end + 1
    found: list[list[tuple]] = [[] for _ in texts]
    for start, length, period in _runs(codes, stop, least_length, least_exponent):
        text = int(np.searchsorted(firsts, start, side="right")) - 1
        found[text].append((start - firsts[text], length, period))
    for each in found:
        each.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple]) -> bytes:
    """The words without those that a run repeats, joined by a space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def _sliced(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, words in enumerate(texts):
        if i > at and size + len(words) > SLICE_WORDS:
            yield at, i
            at, size = i, 0
        size += len(words)
    if at < len(texts):
        yield at, len(texts)


def _finding(least_length: int, least_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            sizes = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy())
            at = 0
            while at < batch.num_rows:  # words of part of a batch at a time are Python objects
                behind = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, behind + 8 * SLICE_WORDS, side="right")))
                texts = [(t or b"").split() for t in raw.slice(at, end - at).to_pylist()]
                for a, b in _sliced(texts):
                    found = runs_of(texts[a:b], least_length, least_exponent)
                    flat = [r for runs in found for r in runs]
                    columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
                    offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(at + a, b - a),
                            pa.array([len(words) for words in texts[a:b]], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_RUN))),
                            pa.array([collapsed(w, r) for w, r in zip(texts[a:b], found)], pa.binary()).cast(pa.string()),
                        ],
                        names=["doc_id", "n_words", "runs", "collapsed"],
                    )
                at = end

    return run


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_length: int = LEAST_LENGTH,
    least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """Of each row: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text
    without the words that a run repeats. A run has ``least_length`` words and ``least_exponent`` (3 or more) times its
    smallest period at least."""
    if least_exponent < 3:
        raise ValueError("least_exponent must be 3 or more")
    texts = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    added = StructType.fromDDL("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    schema = StructType([texts.schema["doc_id"], StructField("n_words", LongType()), *added.fields])
    return texts.mapInArrow(_finding(least_length, least_exponent), schema)
