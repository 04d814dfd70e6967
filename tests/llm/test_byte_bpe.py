import random
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows  # noqa: E402

from seaflow.llm import byte_bpe as B  # noqa: E402

RANKS = B.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = [
    None,
    "",
    " ",
    "\n\n  \t x  y  ",
    "It's they'LL we're I'd 'sfoo ''s",
    "naïve Größe ñandú жар 日本語テキスト 한국어 🙂👩‍👩‍👧 é",
    "1234567890 ½ ² ٣ 12,345.67",
    "<|endoftext|> not special",
    "====----____!!!???",
    "x" * 300 + " " + "ab" * 200,
    " ".join(random.Random(1).choices(["alpha", "betagamma", "deltaepsilonzeta", "ετα", "...", "7"], k=20_000)),
    "twice",
]
CASES = list(enumerate(TEXTS)) + [(11, "twice"), (None, "no id")]


def test_the_pattern_is_that_of_the_vocabulary():
    assert B.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("dictionary_size", [1, 5, 10_000])
def test_like_the_library(spark, dictionary_size):
    docs = clashing(documents(spark, CASES), "carried", "segments", "rare", "rare_at", "words")
    found = rows(B.encoded(docs, RANKS, dictionary_size=dictionary_size))
    assert len(found) == len(CASES)
    texts = dict(CASES)
    for r in found:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == LIBRARY.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_random_characters(spark):
    rng = random.Random(3)
    alphabets = ["abcdefgh ", "aàáâ éè", "\t\n\r  .,'", "".join(map(chr, range(0x4E00, 0x4E40))), "🙂🙃0123 "]
    cases = [(i, "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60)))) for i in range(300)]
    for r in rows(B.encoded(documents(spark, cases), RANKS, dictionary_size=50)):
        assert r["ids"] == LIBRARY.encode_ordinary(cases[r["doc_id"]][1])
        assert bytes(r["decoded"]).decode() == cases[r["doc_id"]][1]


def test_round_trip_carries_columns_and_empty_tables(spark):
    docs = clashing(documents(spark, CASES[:5]), "carried", "row")
    found = B.round_trip(docs, RANKS, dictionary_size=10)
    assert found.columns == [*docs.columns, "ids", "decoded"]
    assert found.count() == 5
    assert B.encoded(documents(spark, []), RANKS, dictionary_size=10).count() == 0


def test_very_long_words(spark):
    rng = random.Random(8)
    words = [
        "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)),
        "a" * 100_001,
        "=" * 5_000 + "-=" * 3_000,
        "".join(rng.choices("ab", k=3_000)),
        "".join(rng.choices("人民共和国中文字的一是不了", k=2_000)),
        "สวัสดีครับ" * 300,
        "x" * 300 + " " + "ab" * 200,
    ]
    docs = documents(spark, list(enumerate(words))).repartition(len(words))
    for r in rows(B.encoded(docs, RANKS, dictionary_size=1)):
        assert r["ids"] == LIBRARY.encode_ordinary(words[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == words[r["doc_id"]]


def test_ranks_that_overtake(spark):
    """A pair that a merge makes may have a lesser rank than the merge itself: then places are merged one by one."""
    rng = random.Random(5)
    for trial in range(6):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 300:
            tokens.add(bytes(rng.choices(b"abc", k=rng.randint(2, 5))))
        order = sorted(tokens, key=len)[:256] + rng.sample(sorted(tokens, key=len)[256:], len(tokens) - 256)
        ranks = {token: n for n, token in enumerate(order)}
        library = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})
        cases = [(n, "".join(rng.choices("abc", k=rng.randint(2, 700)))) for n in range(8)]
        for r in rows(B.encoded(documents(spark, cases), ranks, dictionary_size=1)):
            assert r["ids"] == library.encode_ordinary(cases[r["doc_id"]][1])


def test_plans_hold_no_vocabulary(spark):
    """The driver keeps the texts of plans; nor may a row hold the vocabulary on its way."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    found = plan(B.round_trip(documents(spark, CASES), RANKS, dictionary_size=10))
    assert max(RANKS, key=len).hex().upper() not in found
    assert len(found) < 100_000
    assert " AS known" not in found and " AS pieces" not in found
    words = spark.createDataFrame([("some",), ("words",)], "word string")
    assert "Exchange" not in plan(B._folded_words(words, B.Ranks(spark, RANKS)))


def test_merges_look_up_pairs_of_ids(spark):
    """No step searches the state by array_position or slices it: together with keys of text that took about twice as long."""
    rng = random.Random(11)
    words = ["a", "\x00\x00b", "é", "ÿþ", *("".join(rng.choices("thearinño\x01ß", k=k)) for k in range(2, 100))]
    vocabulary = B.Ranks(spark, RANKS)
    rows_ = vocabulary.beside(spark.createDataFrame([(w,) for w in words], "word string"))
    found = rows_.select("word", B._merged(F.encode("word", "UTF-8"), F.col("known")).alias("ids"))
    text = found._jdf.queryExecution().analyzed().toString()
    assert "array_min" in text and "array_position" not in text and "slice" not in text
    for r in found.collect():
        if r["word"].encode() not in RANKS:
            assert r["ids"] == LIBRARY._encode_single_piece(r["word"].encode())


def test_a_byte_without_a_rank(spark):
    """Bytes without a rank stand by themselves or in a token that has one; no other id is changed."""
    ranks = {bytes([b]): b for b in range(256) if b != ord("q")} | {b"qu": 300, b"ab": 301}
    vocabulary = B.Ranks(spark, ranks)
    words = vocabulary.beside(spark.createDataFrame([("abq",), ("aqu",), ("abab",)], "word string"))
    found = {r["word"]: r["ids"] for r in words.select("word", vocabulary.fold(F.array("word"))[0].alias("ids")).collect()}
    assert found == {"abq": [301, B.NO_RANK], "aqu": [97, 300], "abab": [301, 301]}
