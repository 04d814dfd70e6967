"""Jaccard join on word shingles: MinHash values compared step by step with Bayesian pruning, survivors verified.

A word is a run of ASCII letters, ASCII digits and characters outside ASCII, in lower case. A text is the set of its
runs of five words; a text of one to four words is a set of one element, a text without words has none and no links.
Texts with the same set are one class, so copies are never compared with each other. Classes that agree in one of
``BANDS`` groups of ``ROWS`` MinHash values are candidates (a pair at 0.8 is missed with probability
(1 - 0.8^6)^32 = 6e-5, one at 0.85 with 3e-7). In each bucket a second sketch is compared ``STEP`` values at a time; a
pair is dropped as soon as the posterior probability of reaching the threshold, from a uniform prior, is below
``TOLERANCE``. The others connect texts into rough groups, and within these every pair that the sketches don't rule
out is verified on the full sets.

A bucket or group larger than ``TILE`` is cut into tiles that meet in tasks of their own, so no task holds one whole.
Of the pairs of a group as many leave a task as connect it, besides the exact number of links of each text.

Defined results: a null text has no words; a null doc_id is left out when the least id of a class is taken, a class
whose ids are all null is named by null. Repeated rows are members of the same class. An empty table gives empty
results. Other columns are ignored by ``classes``; ``near_dedup`` carries them, tells rows apart by id and text, so that
an id may stand for several texts, and keeps of a group one row without doc_id beside the one with the least id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaflow.llm.links import connected
from seaflow.llm.storage import written
from seaflow.llm.touched import with_touched

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, SKETCH, STEP = 32, 6, 64, 16
TOLERANCE = 1e-4
TILE = 256
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLIER = _rng.integers(0, 1 << 31, BANDS * ROWS + SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDEND = _rng.integers(0, 1 << 32, BANDS * ROWS + SKETCH, dtype=np.uint32)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_IS_WORD = np.array([chr(c).isalnum() or c >= 128 for c in range(256)]) & np.array(
    [c >= 128 or chr(c).isascii() for c in range(256)]
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    at = 0
    while at < len(texts):
        chunk, size = [], 0
        while at < len(texts) and (not chunk or size < CHUNK_BYTES):
            chunk.append((texts[at] or "").lower().encode("utf-8", "replace"))
            size += len(chunk[-1])
            at += 1
        raw = np.frombuffer(b"\n".join(chunk) + b"\n", dtype=np.uint8)
        ends_of_docs = np.cumsum([len(x) + 1 for x in chunk])
        inside = _IS_WORD[raw]
        edges = np.diff(np.concatenate(([0], inside.view(np.int8))))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        first = np.searchsorted(starts, np.concatenate(([0], ends_of_docs)))
        if len(starts):
            places = np.flatnonzero(inside)
            lengths = ends - starts
            word_at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            within = np.arange(len(places)) - np.repeat(word_at, lengths)
            powers = _powers(_P, int(lengths.max()))
            h = _mixed(np.add.reduceat(_BYTE[raw[places]] * powers[within], word_at))
            q = _powers(_Q, words)
            if len(h) >= words:
                runs = sum(h[j : len(h) - words + 1 + j] * q[j] for j in range(words))
                runs = _mixed(runs)
        for d in range(len(chunk)):
            lo, hi = first[d], first[d + 1]
            if hi - lo >= words:
                yield np.unique(runs[lo : hi - words + 1])
            elif hi > lo:
                yield _mixed(np.sum(h[lo:hi] * q[: hi - lo], keepdims=True) + np.uint64(hi - lo))
            else:
                yield np.empty(0, dtype=np.uint64)


def _minhashes(values: np.ndarray) -> np.ndarray:
    top = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MULTIPLIER), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(top), 4096):
        part = top[None, at : at + 4096] * _MULTIPLIER[:, None]
        part += _ADDEND[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _sketch(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum outside the bands, mixed first: the top bits of minima are 0 for most texts."""
    return _mixed(least[BANDS * ROWS :].astype(np.uint64)).astype(np.uint8)


_SIGNATURES = "doc_id long, text_key binary, class_key binary, n int, bands array<long>, sketch binary"


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    q = _powers(_Q, ROWS)
    for batch in batches:
        keys, sizes, bands, sketches = [], [], [], []
        for values in shingle_sets(batch.column(2).to_pylist()):
            keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
            sizes.append(len(values))
            if len(values):
                least = _minhashes(values)
                rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                bands.append(_mixed((rows * q).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                sketches.append(_sketch(least).tobytes())
            else:
                bands.append(np.empty(0, dtype=np.int64))
                sketches.append(b"")
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
        flat = np.concatenate(bands) if bands else np.empty(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(keys, pa.binary()),
                pa.array(sizes, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array(sketches, pa.binary()),
            ],
            names=["doc_id", "text_key", "class_key", "n", "bands", "sketch"],
        )


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After each number of compared values, the matches below which a pair is dropped.

    Two sketch values of a byte agree with probability s = J + (1 - J) / 256. With a uniform prior and m of n
    matches, P(s >= s0) is that of at most m successes in n + 1 trials at s0.
    """
    s0 = threshold + (1 - threshold) / 256
    found = {}
    for n in range(STEP, SKETCH + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * s0**m * (1 - s0) ** (n + 1 - m)
        found[n] = m
    return found


def _tiles(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by ``key`` as frames of whole tiles, with the first row of each. A tile has 2 TILE rows at most."""
    rest = None
    for rows in batches:
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        new = np.zeros(len(rows), dtype=bool)
        new[:1] = True
        for name in key:
            column = rows[name].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        whole = starts[-1] if len(starts) else 0
        if whole:
            yield rows.iloc[:whole], starts[:-1]
        rest = rows.iloc[whole:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.array([0])


def _survivors(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one tile that survive the pruning, for each distance between the rows."""
    need = least_matches()
    sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(-1, SKETCH)
    n, chunk = rows["n"].to_numpy(), rows["chunk"].to_numpy()
    across = (rows["i"] != rows["j"]).to_numpy()
    end = np.repeat(np.append(starts[1:], len(rows)), np.diff(np.append(starts, len(rows))))
    at, step = np.arange(len(rows)), 1
    while len(at := at[at + step < end[at]]):
        x, y = at, at + step
        fits = np.minimum(n[x], n[y]) >= THRESHOLD * np.maximum(n[x], n[y])
        fits &= ~across[x] | (chunk[x] != chunk[y])
        x, y = x[fits], y[fits]
        matches = np.zeros(len(x), dtype=np.int64)
        for seen in range(0, SKETCH, STEP):
            matches += (sketch[x, seen : seen + STEP] == sketch[y, seen : seen + STEP]).sum(axis=1)
            stays = matches >= need[seen + STEP]
            x, y, matches = x[stays], y[stays], matches[stays]
        if len(x):
            yield x, y
        step += 1


class _Forest:
    """Keeps of the pairs it is shown those that connect two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.kept: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def add(self, x: int, y: int) -> None:
        a, b = self._root(x), self._root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.kept.append((x, y))


def _candidate_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the surviving pairs of each tile, enough to connect what they connect."""
    for rows, starts in _tiles(batches, ["band", "i", "j"]):
        forest = _Forest(len(rows))
        for x, y in _survivors(rows, starts):
            for p, q in zip(x.tolist(), y.tolist()):
                forest.add(p, q)
        keys = rows["class_key"].to_numpy()
        found = list({(min(keys[p], keys[q]), max(keys[p], keys[q])) for p, q in forest.kept})
        yield pd.DataFrame({"a": [p for p, _ in found], "b": [q for _, q in found]}, dtype=object)


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x and y."""
    if len(x) < 2000:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x, y)], dtype=np.int64)
    used, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    shared = np.zeros((len(used), len(used)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1, 8192):  # exact: counts stay below 2^24
        lo, hi = np.searchsorted(column, (at, at + 8192))
        block = np.zeros((len(used), 8192), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        shared += block @ block.T
    return shared[place[: len(x)], place[len(x) :]].astype(np.int64)


def _verifying(all_pairs: bool):
    """Exact links of each tile: a row (a, b, jaccard) for enough of them to connect what they connect, or for all;
    and a row (a, null, number of links) for each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _tiles(batches, ["root", "i", "j"]):
            sets = list(rows["shingles"])
            keys = rows["class_key"].to_numpy()
            size = np.array([len(s) for s in sets])
            tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
            forest, links, count = _Forest(len(rows)), [], np.zeros(len(rows), dtype=np.int64)
            pairs = list(_survivors(rows, starts))
            if pairs:
                x, y = (np.concatenate(side) for side in zip(*pairs))
                order = np.argsort(tile[x], kind="stable")
                x, y = x[order], y[order]
                bounds = np.flatnonzero(np.diff(tile[x], prepend=-1, append=len(starts)))
                common = np.concatenate([_common(sets, x[a:b], y[a:b]) for a, b in zip(bounds, bounds[1:])])
                jaccard = common / (size[x] + size[y] - common)
                linked = jaccard >= THRESHOLD
                x, y, jaccard = x[linked], y[linked], jaccard[linked]
                np.add.at(count, x, 1)
                np.add.at(count, y, 1)
                for n, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
                    before = len(forest.kept)
                    forest.add(p, q)
                    if all_pairs or len(forest.kept) > before:
                        links.append((min(keys[p], keys[q]), max(keys[p], keys[q]), float(jaccard[n])))
            links += [(keys[p], None, float(count[p])) for p in np.flatnonzero(count)]
            yield pd.DataFrame(links, columns=["a", "b", "value"])

    return run


def _dealt(rows: DataFrame, group: str, members: DataFrame) -> DataFrame:
    """``rows`` with the tiles of their group: i and j, the chunks that meet, and chunk, the row's own."""
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    own = rows.join(members, group).withColumn("tiles", tiles)
    own = own.withColumn("chunk", F.pmod(F.xxhash64("class_key"), F.col("tiles")).cast("int"))
    met = own.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    met = met.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    return met.drop("count", "tiles", "other").repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def candidates(signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) of class keys that share a band and survive the pruning: of each bucket as many as connect it."""
    rows = signatures.filter("n > 0")
    light = rows.select("class_key", F.explode(F.array_distinct("bands")).alias("band")).distinct()
    shared = light.groupBy("band").count().filter("count > 1")
    crowded = light.join(shared.select("band"), "band", "left_semi")
    sketches = rows.groupBy("class_key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    full = _dealt(crowded.join(sketches, "class_key"), "band", shared)
    return full.mapInPandas(_candidate_forest, "a binary, b binary").distinct()


def join(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", all_pairs: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, text_key, class_key, n, class_id, n_copies), links (a, b, jaccard) between class keys, a < b, and the
    number of links of each class (class_key, n_links).

    Links are exact and complete within what candidates connect, but of a large group only as many are returned as
    connect it, unless ``all_pairs`` asks for every one, whose number grows with the square of the group.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    keyed = plain.select("doc_id", _text_key(F.col("text")).alias("text_key"), "text")
    signatures = written(keyed.mapInArrow(_signature_batches, _SIGNATURES), "minhash")
    classes = signatures.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    members = signatures.select("doc_id", "text_key", "class_key", "n").join(classes, "class_key")
    groups = written(
        connected(written(candidates(signatures), "candidates")).withColumnRenamed("node", "class_key"), "rough"
    )
    sketches = signatures.groupBy("class_key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # A text for each class asked for: by the least id, or by the class itself where no row of it has an id.
    asked = groups.join(classes.select("class_key", "class_id"), "class_key")
    texts = (
        plain.join(asked.filter("class_id is not null").selectExpr("class_key", "class_id as doc_id"), "doc_id")
        .select("class_key", "text")
        .mapInArrow(_checked_set_batches, "class_key binary, shingles array<long>")
    )
    nameless = asked.filter("class_id is null").select("class_key")
    loose = (
        plain.filter("doc_id is null")
        .mapInArrow(_keyed_set_batches, "class_key binary, shingles array<long>")
        .join(nameless, "class_key", "left_semi")
    )
    sets = texts.unionByName(loose).groupBy("class_key").agg(F.first("shingles").alias("shingles"))
    full = sets.join(sketches, "class_key").join(groups, "class_key")
    dealt = _dealt(full, "root", groups.groupBy("root").count())
    found = written(dealt.mapInPandas(_verifying(all_pairs), "a binary, b binary, value double"), "jaccard")
    links = found.filter("b is not null").withColumnRenamed("value", "jaccard")
    counts = found.filter("b is null").groupBy(F.col("a").alias("class_key")).agg(
        F.sum("value").cast("long").alias("n_links")
    )
    return members, links, counts


def _keyed(sets: list[np.ndarray]) -> list[bytes]:
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]


def _as_batch(keys: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
        names=["class_key", "shingles"],
    )


def _keyed_set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1).to_pylist()))
        yield _as_batch(_keyed(sets), sets)


def _checked_set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the class asked for; an id that stands for several texts brings the others too, which go."""
    for batch in batches:
        asked = batch.column(0).to_pylist()
        sets = list(shingle_sets(batch.column(1).to_pylist()))
        right = [n for n, key in enumerate(_keyed(sets)) if key == asked[n]]
        yield _as_batch([asked[n] for n in right], [sets[n] for n in right])


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (least id of all texts that links connect with it), copy_of (least id of the texts
    with the same shingles), n_copies of those, n_links (other texts it is linked with)."""
    members, links, counts = join(docs, id_column, text_column)
    roots = connected(links.select("a", "b").distinct())
    named = members.join(roots.withColumnRenamed("node", "class_key"), "class_key", "left")
    least = (
        named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least_id"))
    )
    return (
        named.join(least, "root", "left")
        .join(counts, "class_key", "left")
        .selectExpr(
            "doc_id",
            "if(n = 0, doc_id, coalesce(least_id, class_id)) as class_id",
            "if(n = 0, doc_id, class_id) as copy_of",
            "if(n = 0, 1L, n_copies) as n_copies",
            "coalesce(n_links, 0L) as n_links",
        )
    )


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each group keeps the text with the least id, and of its rows without id one; texts
    without words all stay. Rows that repeat both id and text are kept or dropped alike."""
    members, links, _ = join(docs, id_column, text_column)
    roots = connected(links.select("a", "b").distinct()).withColumnRenamed("node", "class_key")
    rows = (
        members.filter("n > 0")
        .join(roots, "class_key", "left")
        .selectExpr("coalesce(root, class_key) as root", "doc_id", "text_key", "doc_id is null as nameless")
    )
    # One line for each text of a group under each id, however often it is repeated.
    texts = written(
        rows.groupBy("root", "nameless", "doc_id", "text_key").agg(F.count("*").alias("times")), "near-texts"
    )
    # Groups of one text take no further part, unless that text is repeated without id.
    sizes = texts.groupBy("root", "nameless").agg(
        F.count("*").alias("n_texts"), F.max("times").alias("times"), F.min("doc_id").alias("least_id")
    )
    sizes = sizes.filter("n_texts > 1 or (nameless and times > 1)").drop("times")
    crowded = texts.join(sizes, ["root", "nameless"])
    # The texts under the least id; without id, all that the group has.
    first = crowded.filter("doc_id <=> least_id").groupBy("root", "nameless").agg(F.min("text_key").alias("least_key"))
    fates = (
        crowded.join(first, ["root", "nameless"])
        .select(
            F.col("doc_id").alias("fate_id"),
            F.col("text_key").alias("fate_key"),
            (F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("text_key") == F.col("least_key"))).alias("stays"),
            (F.col("nameless") & (F.col("times") > 1)).alias("again"),
        )
        .filter("not stays or again")
    )
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_column].cast("long").alias("id"),
        _text_key(docs[text_column]).alias("key"),
    )
    fates = written(fates, "near-fates")
    marked = with_touched(packed, [F.col("id"), F.col("key")], fates, ["fate_id", "fate_key"])
    same = F.col("id").eqNullSafe(fates["fate_id"]) & (F.col("key") == fates["fate_key"])
    joined = marked.filter("touched").join(fates, same, "left").filter("stays is null or stays")
    left = written(joined.select("row", "key", "stays"), "near-touched")
    again = left.filter("stays").groupBy("key").agg(F.first("row").alias("row")).select("row")
    once = marked.filter("not touched").select("row").unionByName(left.filter("stays is null").select("row"))
    return once.unionByName(again).select("row.*")
