"""Toxicity: a support vector machine on a gapped-subsequence string kernel, with Nystroem landmarks.

A text is cut into sentences, at line ends and at full stops, exclamation and question marks before a blank. A sentence is
seen as its tokens and the pairs of tokens that follow each other in it. A token is what blanks separate, in lower case,
with everything but letters and digits taken out, and with runs of single characters joined ("i d.i-o t" is one token).
The kernel of two of them is that of their subsequences of ``ORDER`` = 3 characters within ``SPAN`` neighbouring ones, each
weighted with ``DECAY`` per skipped character, divided by the norms of the weights; inserted characters thus cost a little,
not the match. A sentence's decision value is the greatest of its tokens and, if phrases were learned, its pairs.

Training takes a bounded sample of labelled documents (``sample_per_label`` of each label, by a hash of the id, texts
that occur twice once). Labels are those of documents, so labelled sentences are derived first: tokens whose share among
toxic documents is ``RATIO`` times that among clean ones are taken greedily by the number of toxic documents they explain
that none before them does, and those that ``SHARE`` of the toxic documents hold which are not copies of each other (copies
agree in the least hash of their tokens). In documents that no token explains, pairs are taken likewise, from ``SHARE`` of the
toxic documents on: phrases whose words are harmless by themselves. Sentences of toxic documents that hold one of either are
the toxic ones. The machine is trained on what makes them so against tokens (and, where there are phrases, pairs) of clean
sentences, ``CLEAN_TOKENS`` of each kind at most, in the space that landmarks span (Nystroem), with the clean ones it gets
most wrong added in rounds. A document's score is the logistic fit, over the sample, of the greatest decision value among
its sentences.

The decision function is linear in the subsequences, so its kernel sums over all landmarks are folded into one table
over triples of characters; a text is scored whole, in a few passes over its characters.

Defined results: texts that are null or without token have the lowest decision value. An insult of fewer than three
characters is found as part of a phrase only. Null labels and ids teach
nothing, rows that repeat an id are scored alike; with no label of one kind every score is 0.
An empty table gives an empty result. Other columns are carried by ``scored`` and may have any name but score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seaflow.llm.language_id import held_out
from seaflow.llm.sampling import least_hashes

ORDER, SPAN, DECAY = 3, 6, 0.6
SAMPLE_PER_LABEL = 3000
LANDMARKS, CLEAN_TOKENS, LEAST_DOCUMENTS = 256, 20_000, 3
SHARE, RATIO = 0.01, 20
SENTENCE_END = ".!?\u3002\uff01\uff1f"
LINE_END = "\n\r\x0b\x0c\u2028\u2029"
SENTENCES = re.compile(rf"(?<=[{SENTENCE_END}])\s+|[{LINE_END}]+")
ROUNDS, HARD = 3, 400
LETTERS = 62  # characters told apart; all others share one more
NO_TOKEN = -4.0
CUT = 0.3  # score from which a text counts as toxic
CHUNK_CHARS = 1 << 18


@dataclass
class Alphabet:
    """Number of each character, from 1; 0 for what is left out of tokens."""

    number: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Alphabet:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
        kept = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
        values, counts = np.unique(codes[kept[codes]], return_counts=True)
        number = np.where(kept, LETTERS + 1, 0).astype(np.uint8)
        for n, value in enumerate(values[np.argsort(-counts, kind="stable")][:LETTERS], 1):
            number[value] = n
        return Alphabet(number)


def _tokens(
    texts: list[str | None], alphabet: Alphabet
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all tokens one after the other, the start of each token, the tokens before each text, and whether
    the token after a token is in the same sentence."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n\n".join(["", *lowered, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    blank = np.isin(codes, (9, 10, 11, 12, 13, 32, 133, 160, 0x2028, 0x2029, 0x3000))
    number = alphabet.number[codes]
    edge = np.diff(np.concatenate((blank.view(np.int8), [1])), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    if not len(starts):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.empty(0, bool)
    ends = ends[ends > starts[0]][: len(starts)]
    letters = np.concatenate(([0], np.cumsum(number > 0)))
    size = letters[ends] - letters[starts]
    whole = size > 0
    starts, ends, size = starts[whole], ends[whole], size[whole]
    # Single characters, one blank apart, are one token; texts are two line ends apart.
    joined = np.zeros(len(starts), dtype=bool)
    joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (starts[1:] - ends[:-1] == 1)
    first = np.flatnonzero(~joined)
    text_starts = np.cumsum([2] + [len(x) + 2 for x in lowered])
    per_text = np.searchsorted(starts[first], text_starts)
    stop = np.isin(codes, [ord(c) for c in SENTENCE_END])
    stop[:-1] &= blank[1:]
    ended = np.cumsum(stop | np.isin(codes, [ord(c) for c in LINE_END]))[starts[first]]
    follows = np.append(ended[1:] == ended[:-1], False)
    return number[number > 0], letters[starts[first]], per_text, follows


def _triples(
    chars: np.ndarray, token: np.ndarray, apart: int = 0
) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each pair of distances: weight, places where the triple lies in one token (``apart`` 1: reaches from a token
    into the next), and the triple's number."""
    base = LETTERS + 2
    wide = chars.astype(np.int32)
    for span in range(2, SPAN):
        reach = token[span:] - token[:-span] if len(token) > span else np.empty(0, np.int64)
        inside = np.flatnonzero(reach == apart)
        if not len(inside):
            continue
        outer = wide[inside] * (base * base) + wide[inside + span]
        for middle in range(1, span):
            yield DECAY ** (span - 2), inside, outer + wide[inside + middle] * base


def _sums(
    chars: np.ndarray, starts: np.ndarray, table: np.ndarray, apart: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table over the weighted triples that begin in each token, and that of the squared weights."""
    if not len(starts):
        return np.empty(0), np.empty(0)
    token = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(chars))))
    value, square = np.zeros(len(chars)), np.zeros(len(chars))
    for weight, places, number in _triples(chars, token, apart):
        value[places] += weight * table[number]
        square[places] += weight * weight
    return np.add.reduceat(value, starts), np.add.reduceat(square, starts)


def _features(tokens: list[str], alphabet: Alphabet, triples: np.ndarray) -> np.ndarray:
    """The normed weights of the given triples (sorted) in each token, a row each."""
    rows = np.zeros((len(tokens), len(triples)), dtype=np.float32)
    for n, text in enumerate(tokens):
        norm = 0.0
        for weight, places, number in _triples(*_alone(text, alphabet)):
            at = np.searchsorted(triples, number)
            at[at == len(triples)] = 0
            known = triples[at] == number
            np.add.at(rows[n], at[known], weight)
            norm += weight * weight * len(places)
        if norm:
            rows[n] /= np.sqrt(norm)
    return rows


def _alone(text: str, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    chars = alphabet.number[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    chars = chars[chars > 0]
    return chars, np.zeros(len(chars), dtype=np.int64)


@dataclass
class Model:
    alphabet: Alphabet
    table: np.ndarray  # weight of each triple
    bias: float
    slope: float  # of the logistic fit
    offset: float
    phrases: bool = False  # whether pairs of tokens count

    def decide(self, texts: list[str | None]) -> np.ndarray:
        """The greatest decision value among the sentences of each text."""
        found = np.full(len(texts), NO_TOKEN)
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and (at == first or size < CHUNK_CHARS):
                size += len(texts[at] or "")
                at += 1
            chars, starts, per_text, follows = _tokens(texts[first:at], self.alphabet)
            if not len(starts):
                continue
            value, square = _sums(chars, starts, self.table)
            decision = value / np.maximum(np.sqrt(square), 1.0) + self.bias
            if self.phrases:
                across, more = _sums(chars, starts, self.table, apart=1)
                pair = np.flatnonzero(follows)
                norm = np.sqrt(square[pair] + square[pair + 1] + more[pair])
                joint = (value[pair] + value[pair + 1] + across[pair]) / np.maximum(norm, 1.0) + self.bias
                decision[pair] = np.maximum(decision[pair], joint)
            for n in range(first, at):
                own = decision[per_text[n - first] : per_text[n - first + 1]]
                if len(own):
                    found[n] = max(NO_TOKEN, own.max())
        return found

    def calibrate(self, y: np.ndarray, x: np.ndarray, share: dict[int, float], varied: list[str]) -> None:
        """Fits the logistic curve to documents (label y, value x, weight by label) and to varied toxic tokens, which
        together weigh a quarter of the toxic documents."""
        weight = np.where(y == 1, share[1], share[0])
        if varied:
            weight = np.append(weight, np.full(len(varied), weight[y == 1].sum() / 4 / len(varied)))
            x, y = np.append(x, self.decide(varied)), np.append(y, np.ones(len(varied)))
        self.slope, self.offset = _logistic(x, y, weight / weight.mean())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.decide(texts) + self.offset)))


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps."""
    z1 = np.hstack((z, np.ones((len(z), 1))))
    ridge = np.eye(z1.shape[1])
    ridge[-1, -1] = 1e-3
    u = np.zeros(z1.shape[1])
    for _ in range(30):
        active = y * (z1 @ u) < 1
        za, wa = z1[active], c * weight[active]
        following = np.linalg.solve(ridge + (za * wa[:, None]).T @ za, (za * wa[:, None]).T @ y[active])
        if np.allclose(following, u, atol=1e-8):
            break
        u = following
    return u[:-1], float(u[-1])


def _with_insertions(toxic: list[str], clean: list[str]) -> list[str]:
    """Each longer toxic token with one character of clean tokens put into it, at two places."""
    rng = np.random.default_rng(7)
    letters = sorted(set("".join(clean[:1000])))
    found = []
    for token in toxic:
        if len(token) >= 5:
            for at in (len(token) // 3, 2 * len(token) // 3):
                found.append(token[:at] + letters[rng.integers(len(letters))] + token[at:])
    return found


def _fit_tokens(toxic: list[str], clean: list[str], alphabet: Alphabet) -> tuple[np.ndarray, float]:
    """The table of triples and the bias, from tokens of both sides."""
    marks = toxic[: LANDMARKS // 2] + clean[: LANDMARKS - min(len(toxic), LANDMARKS // 2)]
    parts = [number for m in marks for _, _, number in _triples(*_alone(m, alphabet))]
    triples = np.unique(np.concatenate(parts))
    phi = _features(marks, alphabet, triples)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # of the inverse kernel matrix of the landmarks
    basis = (root.T @ phi).astype(np.float32)  # each new dimension as weights of triples
    positive = _features(toxic + _with_insertions(toxic, clean), alphabet, triples) @ basis.T
    every = np.vstack(
        [_features(clean[n : n + 1000], alphabet, triples) @ basis.T for n in range(0, len(clean), 1000)]
    )
    chosen = np.arange(min(len(clean), 4 * HARD))
    for _ in range(ROUNDS):
        z = np.vstack((positive, every[chosen]))
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(chosen))))
        weight = np.concatenate((np.full(len(positive), len(chosen) / max(1, len(positive))), np.ones(len(chosen))))
        u, bias = _machine(z, y, weight / weight.mean())
        hardest = np.argsort(-(every @ u), kind="stable")[:HARD]
        if np.isin(hardest, chosen).all():
            break
        chosen = np.union1d(chosen, hardest)
    table = np.zeros((LETTERS + 2) ** ORDER)
    table[triples] = u @ basis
    return table, bias


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's fit: smoothed targets, weighted to the share of labels in the whole table."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y <= 0).sum() + 2))
    design = np.stack((x, np.ones(len(x))), axis=1)
    a = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        gradient = design.T @ (weight * (target - p)) - 1e-3 * a
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        a = a + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a[0], 0.0)), float(a[1])


def _token_texts(text: str) -> set[str]:
    """The tokens of one text as strings."""
    found, single = set(), []
    for word in [*text.lower().split(), "  "]:
        bare = "".join(filter(str.isalnum, word))
        if len(bare) == 1:
            single.append(bare)
            continue
        if single:
            found.add("".join(single))
            single = []
        if bare:
            found.add(bare)
    return found


def _pair_texts(text: str) -> set[str]:
    """The pairs of tokens that follow each other in a sentence, a blank between them."""
    found = set()
    for sentence in SENTENCES.split(text.lower()):
        bare = ["".join(filter(str.isalnum, word)) for word in sentence.split()]
        bare = [word for word in bare if word]
        found.update(f"{a} {b}" for a, b in zip(bare, bare[1:]))
    return found


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, kin, label, token = [], [], [], []
        for document, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = _token_texts(text)
            least = min((zlib.crc32(t.encode("utf-8", "replace")) for t in words), default=0)
            found = sorted(words | _pair_texts(text))
            own += [document] * len(found)
            kin += [least] * len(found)
            label += [toxic] * len(found)
            token += found
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own, pa.int64()),
                pa.array(kin, pa.int64()),
                pa.array(label, pa.int32()),
                pa.array(token, pa.string()),
            ],
            names=["document", "kin", "toxic", "token"],
        )


def _explaining(rows: pd.DataFrame, least: float = LEAST_DOCUMENTS) -> list[str]:
    """Tokens or pairs that explain toxic documents, each at least ``least`` that none before it does."""
    holders = {t: set(d) for t, d in rows.groupby("token")["document"]}
    found: list[str] = []
    while holders:
        best = max(holders, key=lambda t: (len(holders[t]), t))
        if len(holders[best]) < least:
            break
        found.append(best)
        explained = holders.pop(best)
        holders = {t: rest for t, d in holders.items() if len(rest := d - explained) >= least}
    return found


def _sample(docs: DataFrame, labels: DataFrame, sample_per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled rows that are not held out, a bounded number of each label, and how many there are of each."""
    usable = labels.filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = least_hashes(usable, "toxic", "doc_id", sample_per_label)
    # At most sample_per_label rows of each of two labels.
    small = F.broadcast(chosen.select(F.col("doc_id").alias("sampled_id"), "toxic"))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(small, F.col("doc_id") == F.col("sampled_id"))
    once = rows.groupBy(F.xxhash64("text").alias("document"), "toxic").agg(F.first("text").alias("text"))
    return once.select("document", "toxic", "text"), totals


def _clean(counts: DataFrame, *first: Column) -> list[str]:
    """Tokens or pairs of clean sentences, CLEAN_TOKENS at most, in order of ``first`` and of a hash."""
    known = counts.filter((F.col("clean") > 0) & (F.char_length("token") >= ORDER))
    chosen = known.orderBy(*first, F.xxhash64("token"), "token").limit(CLEAN_TOKENS).select("token")
    return [r["token"] for r in chosen.collect()]


def learn(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """The model, or None where the sample lacks one of the labels."""
    sample, totals = _sample(docs, labels, sample_per_label)
    sample = sample.persist()
    try:
        tokens = sample.mapInArrow(_token_batches, "document long, kin long, toxic int, token string").persist()
        try:
            counts = tokens.groupBy("token").agg(
                F.sum("toxic").alias("toxic"),
                F.sum(1 - F.col("toxic")).alias("clean"),
                F.countDistinct(F.when(F.col("toxic") == 1, F.col("kin"))).alias("kinds"),
            )
            sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
            n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
            telling = (F.col("toxic") >= LEAST_DOCUMENTS) & (
                F.col("toxic") * n_clean >= RATIO * F.col("clean") * n_toxic
            )
            is_pair = F.col("token").contains(" ")
            share = max(LEAST_DOCUMENTS, SHARE * n_toxic)

            def held_by_toxic(chosen: Column) -> pd.DataFrame:
                which = counts.filter(chosen & (F.char_length("token") >= ORDER)).select("token")
                return tokens.filter("toxic = 1").join(which, "token").select("token", "document").toPandas()

            rows = held_by_toxic(telling & ~is_pair)
            toxic = _explaining(rows)
            common = counts.filter(telling & ~is_pair & (F.col("kinds") >= share)).select("token").collect()
            toxic += sorted({r["token"] for r in common if len(r["token"]) >= ORDER} - set(toxic))
            explained = set(rows["document"][rows["token"].isin(toxic)])
            rows = held_by_toxic(telling & is_pair & (F.col("toxic") >= share))
            phrases = _explaining(rows[~rows["document"].isin(explained)], share)
            clean = _clean(counts.filter(~telling & ~is_pair))
            if phrases:
                words = sorted({word for phrase in phrases for word in phrase.split()})
                near = F.split("token", " ")[0].isin(words) | F.split("token", " ")[1].isin(words)
                clean += _clean(counts.filter(~telling & is_pair), F.when(near, 0).otherwise(1))
            toxic = phrases + toxic
            if not toxic or not clean:
                return None
            alphabet = Alphabet.of([*toxic, *clean])
            table, bias = _fit_tokens(toxic, clean, alphabet)
            model = Model(alphabet, table, bias, 1.0, 0.0, bool(phrases))
            shared = docs.sparkSession.sparkContext.broadcast(model)
            values = sample.select("toxic", "text").mapInArrow(_deciding(shared), "toxic int, value double").toPandas()
        finally:
            tokens.unpersist()
    finally:
        sample.unpersist()
    share = {k: totals[k] / max(1, (values["toxic"] == k).sum()) for k in (0, 1)}
    model.calibrate(values["toxic"].to_numpy(), values["value"].to_numpy(), share, _with_insertions(toxic, clean))
    return model


def _deciding(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.decide(batch.column(1).to_pylist()))], names=["toxic", "value"]
            )

    return run


def _scoring(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["row", "score"])

    return run


def scored(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``docs`` with score, from 0 to 1."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_column].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([packed.schema.fields[0], *StructType.fromDDL("score double").fields])
    return packed.mapInArrow(_scoring(shared), schema).select("row.*", "score")
