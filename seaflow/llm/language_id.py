"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter per language is kept bit-sliced: slot ``i`` of the table is a mask of the languages whose filter has bit
``i`` set, so the AND of the slots of an n-gram's hashes gives all languages that contain it at once. A text goes to
the language with the most n-grams in its filter, after the hits expected from false positives are taken off.

The filters hold, for each language, the n-grams that are about as frequent there as anywhere else (``SHARE`` of the
highest rate), counted over a sample of at most ``sample_per_language`` labelled rows of each language (chosen by a
hash of the id; the bound keeps the model's size independent of the input). Prediction reads the text alone, whole.

An n-gram is three neighbouring characters in lower case whose middle is a letter, everything that is no letter read
as a space. Defined results: a text that is null or has no letter gives ``und`` with score 0, as does every text when
nothing was learned; ``recognised`` rejects texts that show no learned language, and keeps every text with a letter
where nothing was learned; of languages with equal counts the first by name wins. Rows with null lang teach nothing, rows
with null text are predicted as ``und``. Repeated rows are predicted alike; an empty table gives an empty result. Other
columns are carried by ``with_language`` and may have any name but those it adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seaflow.llm.sampling import least_hashes

SAMPLE_PER_LANGUAGE = 1500
SHARE, LEAST_COUNT = 0.3, 3
LEAST_SHARE, DEVIATIONS = 0.25, 2.5  # from which a text shows a language
BITS = 1 << 20
HASHES = 2
SLICE = 64  # languages in one word of the table
UNKNOWN = "und"
CHUNK_CHARS = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _ngrams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of texts: index of the first, the hashes of all n-grams, the end of each text among them."""
    at = 0
    while at < len(texts):
        first, chunk, size = at, [], 0
        while at < len(texts) and (not chunk or size < CHUNK_CHARS):
            chunk.append((texts[at] or "").lower())
            size += len(chunk[-1])
            at += 1
        codes = np.frombuffer((" ".join(["", *chunk, ""])).encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = _letters()[codes]
        codes = np.where(letter, codes, 32).astype(np.uint64)
        middle = np.flatnonzero(letter)
        h = (codes[middle - 1] << np.uint64(42)) | (codes[middle] << np.uint64(21)) | codes[middle + 1]
        ends = np.searchsorted(middle, np.cumsum([len(x) + 1 for x in chunk]))
        yield first, h, ends


def _slots(grams: np.ndarray) -> Iterator[np.ndarray]:
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    for n in range(HASHES):
        yield ((h >> np.uint64(22 * n)) & np.uint64(BITS - 1)).astype(np.int64)


@dataclass
class Filters:
    """Languages in order of name, and for each slice of them the table of masks."""

    languages: list[str]
    tables: list[np.ndarray]
    coverage: np.ndarray  # share of all n-grams of a language's sample that its filter holds

    @staticmethod
    def of(grams: dict[str, np.ndarray], coverage: dict[str, float] | None = None) -> Filters:
        languages = sorted(grams)
        tables = []
        for at in range(0, len(languages), SLICE):
            table = np.zeros(BITS, dtype=np.uint64)
            for bit, language in enumerate(languages[at : at + SLICE]):
                for slots in _slots(grams[language]):
                    table[slots] |= np.uint64(1 << bit)
            tables.append(table)
        return Filters(languages, tables, np.array([(coverage or {}).get(name, 1.0) for name in languages]))

    def false_positives(self) -> np.ndarray:
        """Probability that a foreign n-gram is found, by language: the fill to the power of the hashes."""
        fills = []
        for n in range(len(self.languages)):
            table = self.tables[n // SLICE]
            fills.append(((table >> np.uint64(n % SLICE)) & np.uint64(1)).mean())
        return np.array(fills) ** HASHES

    def _counts(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Of each text with a letter: its index, its n-grams, and how many of them each filter holds."""
        for first, grams, ends in _ngrams(texts):
            slots = list(_slots(grams))
            total = np.diff(np.concatenate(([0], ends)))
            hits = np.empty((len(ends), len(self.languages)))
            for n in range(len(self.languages)):
                if n % SLICE == 0:
                    table = self.tables[n // SLICE]
                    mask = table[slots[0]]
                    for more in slots[1:]:
                        mask &= table[more]
                found = np.concatenate(([0], np.cumsum((mask >> np.uint64(n % SLICE)) & np.uint64(1), dtype=np.int64)))
                hits[:, n] = np.diff(np.concatenate(([0], found[ends])))
            for k in np.flatnonzero(total):
                yield first + k, int(total[k]), hits[k]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        by_chance = self.false_positives()
        for k, total, hits in self._counts(texts):
            rate = np.maximum(0.0, (hits / total - by_chance) / (1 - by_chance))
            best = int(rate.argmax())
            names[k] = self.languages[best]
            scores[k] = rate[best] / rate.sum() if rate[best] > 0 else 0.0
        return names, scores

    def recognised(self, texts: list[str | None]) -> np.ndarray:
        """Whether a text shows a learned language.

        Some language's corrected count must be above 0 and at most ``DEVIATIONS`` standard deviations below that of a
        text of which ``LEAST_SHARE`` is in that language. Where nothing was learned every text with a letter is.
        """
        found = np.zeros(len(texts), dtype=bool)
        if not self.languages:
            return np.array([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)
        by_chance = self.false_positives()
        least = LEAST_SHARE * self.coverage
        for k, total, hits in self._counts(texts):
            corrected = (hits - total * by_chance) / (1 - by_chance)
            margin = DEVIATIONS * np.sqrt(total * least * (1 - least))
            found[k] = ((corrected > 0) & (corrected >= total * least - margin)).any()
        return found


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that take no part in learning."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for language in sorted(set(languages)):
            own = [t for t, x in zip(texts, languages) if x == language]
            grams = np.concatenate([g for _, g, _ in _ngrams(own)])
            values, counts = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)],
                names=["lang", "gram", "n"],
            )


def learn(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, id_column: str = "doc_id") -> Filters:
    """Filters from the rows of ``docs`` with a language, text and id that are not held out."""
    usable = docs.filter(~held_out(id_column) & F.col("lang").isNotNull() & F.col(id_column).isNotNull())
    ids = usable.select(F.col(id_column).alias("sampled_id"), "lang")
    chosen = least_hashes(ids, "lang", "sampled_id", sample_per_language).select("sampled_id").distinct()
    # At most sample_per_language ids of each language.
    sample = usable.join(F.broadcast(chosen), usable[id_column] == chosen["sampled_id"], "left_semi")
    counts = sample.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _count_batches, "lang string, gram long, n long"
    )
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    highest = F.max("rate").over(Window.partitionBy("gram"))
    typical = (
        counts.withColumn("rate", rate)
        .withColumn("highest", highest)
        .filter((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= SHARE * F.col("highest")))
        .select("lang", "gram", "rate")
    )
    found = typical.toPandas()
    return Filters.of(
        {name: rows["gram"].to_numpy(dtype=np.int64).view(np.uint64) for name, rows in found.groupby("lang")},
        {name: float(rows["rate"].sum()) for name, rows in found.groupby("lang")},
    )


def _predicting(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores)],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return run


def with_language(docs: DataFrame, model: Filters, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_column].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*packed.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])
    return packed.mapInArrow(_predicting(shared), schema).select("row.*", "lang_pred", "score")


def _recognising(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = model.value.recognised(batch.column(1).to_pylist())
            yield batch.select([0]).filter(pa.array(stays))

    return run


def recognised(docs: DataFrame, model: Filters, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text shows a learned language; where nothing was learned, those with a letter."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_column].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return packed.mapInArrow(_recognising(shared), StructType(packed.schema.fields[:1])).select("row.*")
