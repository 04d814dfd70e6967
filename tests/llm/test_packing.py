import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows, save  # noqa: E402

from seaflow.llm import packing as P  # noqa: E402
from seaflow.llm.queries import QUERIES  # noqa: E402
from seaflow.llm.storage import new_path  # noqa: E402

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
    DEFINITION = file.read()
LIBRARY = Tokenizer.from_str(DEFINITION)

# Letters that change by case or composition, special strings, every kind of white space.
SIGNS = "a B é É ẞ ß é ẖ H̱ T̈ İ Σ ς <|endoftext|> <|ENDOFTEXT|>   　 ́ , . ! 's 'LL 1 23 漢字 ＡＢ 🙂 - ǅ K \x1c \x85 ÷ × The THE, word. ü abc### {} ~ \x00".split(" ")
SIGNS += [" ", "  ", "\n", "\t", "\x0b"]


def odd_texts(n, longest=30):
    rng = random.Random(n)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def check(found, cases, most=4096):
    """Pieces of unique doc_ids cover the ids of the library, each a sequence of its own of a power of two."""
    pieces: dict = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["start"])):
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= most and r["offset"] == 0
        pieces.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in found}) == len(found)
    assert set(pieces) == {i for i, _ in cases}
    for doc_id, text in cases:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in pieces[doc_id]:
            own = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r.get("ids", own) == own and r.get("ids_crc32", zlib.crc32(own)) == zlib.crc32(own)
            at += r["length"]
        assert at == len(ids)
        lengths = [r["length"] for r in pieces[doc_id]]
        assert lengths == sorted(lengths, reverse=True)
        assert len(set(lengths) - {most}) == len([x for x in lengths if x != most])


def test_pieces_hold_what_the_library_encodes(spark, monkeypatch):
    cases = [*enumerate(odd_texts(400)), (1000, None), (1001, ""), (1002, " \n"), (1003, "long words, " * 30_000)]
    frame = clashing(documents(spark, cases), "length", "ids", "start", "offset")
    check(rows(P.pack(frame, DEFINITION, end_id=2)), cases)
    check(rows(P.pack(frame, DEFINITION, end_id=2, most=8)), cases, most=8)


def test_repeated_rows_and_forgotten_words(spark, monkeypatch):
    cases = [(7, "twice the same"), (7, "twice the same"), (None, "no id")]
    found = rows(P.pack(documents(spark, cases), DEFINITION, end_id=2))
    assert len({r["sequence_id"] for r in found}) == len(found)
    assert sum(r["length"] for r in found if r["doc_id"] == 7) == 8
    monkeypatch.setattr(P, "KEPT_WORDS", 10)
    monkeypatch.setattr(P, "SLICE_WORDS", 50)
    known = P._Words(DEFINITION)
    for text in odd_texts(60):
        words = text.encode().split()
        slots = known.of(P.pa.array([w.decode() for w in words], P.pa.string()))
        ids = [i for s in slots for i in known.ids[known.ends[s] : known.ends[s + 1]].tolist()]
        assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert P.pack(documents(spark, []), DEFINITION, end_id=2).count() == 0


def test_files_by_bucket(spark):
    cases = [(i, "word " * (3 * i)) for i in range(40)]
    path = new_path(spark, "packed")
    P.write(P.pack(documents(spark, cases), DEFINITION, end_id=2), path)
    found = spark.read.parquet(path)
    assert found.filter("bucket <> length").isEmpty()
    bounds = rows(found.groupBy("length").agg({"sequence_id": "min", "doc_id": "max"}).orderBy("length"))
    ordered = sorted(rows(found), key=lambda r: r["sequence_id"])
    assert [r["length"] for r in ordered] == sorted(r["length"] for r in ordered) and len(bounds) > 3


def test_refuses_other_tokenizers():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        other = file.read()
    with pytest.raises(ValueError):
        P._Words(other)
    with pytest.raises(ValueError):
        P.pack(None, DEFINITION, end_id=2, most=1000)


def test_query(spark, tmp_path):
    cases = [*enumerate(odd_texts(200, 300)), (500, None)]
    path = save(tmp_path, documents=documents(spark, cases))
    found = rows(QUERIES["op12_packing"](spark, path))
    assert list(found[0]) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(found, cases)
