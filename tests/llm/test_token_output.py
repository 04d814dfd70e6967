import sys
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows  # noqa: E402

from seaflow.llm import token_output as T  # noqa: E402
from seaflow.llm.storage import new_path  # noqa: E402

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
    DEFINITION = file.read()
LIBRARY = Tokenizer.from_str(DEFINITION)
CASES = [(i, f"text number {i} " * (i % 7) + "Größe 🙂\n") for i in range(60)]
CASES += [(-5, None), (100, ""), (101, "long words " * 30_000), (70, "<|endoftext|>"), (71, "a <|endoftext|> b  <|endoftext|><|endoftext|>  c <|endoftext"), (72, "x  <|endoftext|>y\n"), (7, "again"), (None, "no id")]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def write(spark, cases):
    path = new_path(spark, "test")
    T.write(clashing(documents(spark, cases), "tie", "ids", "shard", "words"), path, DEFINITION, end_id=2)
    return path


def test_reads_back_what_the_library_encodes(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 100)
    path = write(spark, CASES)
    found = rows(T.read(spark, path))
    assert len(found) == len(CASES)
    texts: dict = {}
    for i, t in CASES:
        texts.setdefault(i, []).append(ids(t))
    for r in found:
        assert r["ids"] in texts[r["doc_id"]]
    found.sort(key=lambda r: r["start"])
    assert [r["start"] for r in found] == list(np.cumsum([0] + [len(r["ids"]) for r in found[:-1]]))
    order = [r["doc_id"] for r in found]
    assert order[0] is None and order[1:] == sorted(order[1:])
    sums = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in rows(T.checksums(spark, path))}
    for r in found:
        raw = np.array(r["ids"], dtype="<u4").tobytes()
        assert sums[r["doc_id"], r["start"]] == (len(r["ids"]), zlib.crc32(raw))


def test_looks_up_documents(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 100)
    path = write(spark, CASES)
    asked = spark.createDataFrame([(7,), (101,), (-5,), (7,), (999,)], "doc_id long")
    found = {(r["doc_id"], r["start"]): r["ids"] for r in rows(T.look_up(spark, path, asked))}
    want = {(r["doc_id"], r["start"]): r["ids"] for r in rows(T.read(spark, path)) if r["doc_id"] in (7, 101, -5)}
    assert found == want and len(found) == 4


def test_empty_table(spark):
    assert T.read(spark, write(spark, [])).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, limit in ((1, 1), (1, 10**9), (5, 5), (1000, 1000), (1000, 10**7), (3000, 2**33)):
        values = np.sort(rng.integers(1, limit + 1, n))
        coded = T.EliasFano.of(values, limit)
        assert (coded.select(np.arange(n)) == values).all()
        some = rng.integers(0, n, 40)
        assert (coded.select(some) == values[some]).all() and coded.select(np.array([n - 1])) == values[-1:]
        starts, ends = coded.stretches(np.arange(n))
        assert (ends == values).all() and starts.tolist() == [0, *values[:-1].tolist()]
        if n >= 1000:
            bits = 8 * (coded.low.nbytes + coded.high.nbytes + coded.directory.nbytes)
            assert bits < n * (3 + np.log2(limit / n)) * 1.1 + 64
