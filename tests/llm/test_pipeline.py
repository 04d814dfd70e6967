import importlib
import random
import re
import sys

sys.path[:0] = [__file__.rsplit("/", 1)[0], __file__.rsplit("/", 2)[0]]
import duckdb  # noqa: E402
import oracle  # noqa: E402
import pytest  # noqa: E402
import test_byte_bpe  # noqa: E402
import test_decontamination  # noqa: E402
import test_language_id  # noqa: E402
import test_ngram_join  # noqa: E402
from frames import documents, rows, save  # noqa: E402

import corpus_pipeline  # noqa: E402
from seaflow.llm import decontamination, queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def corpus():
    rng = random.Random(11)
    items = [(i, " ".join(test_ngram_join.text(rng, 15))) for i in range(4)]
    found = []
    for n in range(60):
        own = test_ngram_join.text(rng, 90)
        if n % 6 == 0:
            own[20:20] = rng.choice(items)[1].upper().split()
        found.append(" ".join(own))
        if n % 4 == 0:
            own[rng.randrange(len(own))] = "changed"
            found.append(" ".join(own))
        if n % 5 == 0:
            found.append(found[-1].replace(" ", "\n ", 3))
    found += [None, "", "12 34 !", "short one", "short  one", "Größe 🙂 word"]
    return list(enumerate(found)), items


def plain_version(docs, items):
    """Ids of the documents that stay, by plain loops over all of them."""
    kept = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    kept = [
        (i, t)
        for i, t in kept
        if (i, t) == min(((j, u) for j, u in kept if bare(u) == bare(t)), key=lambda d: (-len(d[1]), d[0]))
    ]
    near = {i: c for i, c, _ in test_ngram_join.brute(kept)}
    kept = [(i, t) for i, t in kept if near[i] == i]

    def leaks(text):
        body = decontamination.plain(text)
        for _, item in items:
            item = decontamination.plain(item)
            budget = (len(item) - 2) // decontamination.CHARS_PER_EDIT
            if len(item) > 2 and test_decontamination.distance(item, body) <= budget:
                return True
        return False

    return {i: t for i, t in kept if not leaks(t)}


def test_the_whole_like_a_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "DICTIONARY_SIZE", 500)
    docs, items = corpus()
    table = documents(spark, [(i, t, "xx") for i, t in docs])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = rows(corpus_pipeline.run(spark, save(tmp_path, documents=table, benchmark=benchmark)))
    expected = plain_version(docs, items)
    assert sorted(r["doc_id"] for r in found) == sorted(expected)
    assert 40 < len(expected) < len(docs) - 20
    for r in found:
        assert r["ids"] == test_byte_bpe.LIBRARY.encode_ordinary(expected[r["doc_id"]])
        assert r["n_tokens"] == len(r["ids"])


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = documents(spark, [(1, "some text", "xx"), (2, None, None)])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    path = save(tmp_path, benchmark=benchmark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name


def test_language_stage_rejects_what_shows_no_learned_language(spark):
    rng = random.Random(5)
    cases = test_language_id.corpus()
    unknown = ["ⴰⴱⴳⴷ ⴻⴼⴽⵀ " * 4, "".join(rng.choice("bcdfghjlmnpqrstvwxyz ") for _ in range(400)), "123 !", None]
    mixed = [test_language_id.prose("aa", 900) + " " + test_language_id.prose("cc", 901)]
    docs = documents(spark, cases + [(1000 + n, t, None) for n, t in enumerate(unknown)] + [(2000, mixed[0], None)])
    found = {r["doc_id"] for r in rows(corpus_pipeline.identify(spark, docs, ""))}
    assert found == {i for i, _, _ in cases} | {2000}


def test_language_stage_keeps_documents_where_nothing_was_learned(spark):
    texts = [(i, t) for i, t, _ in test_language_id.corpus(40)]
    for label in (lambda i: None, lambda i: "aa" if test_language_id.held(i) else None):
        docs = documents(spark, [(i, t, label(i)) for i, t in texts] + [(99, "12 !", None)])
        assert {r["doc_id"] for r in rows(corpus_pipeline.identify(spark, docs, ""))} == {i for i, _ in texts}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_like_their_sql(spark, name, monkeypatch):
    monkeypatch.setitem(oracle.SPARK_TO_DUCK, "boolean", "BOOLEAN")
    assert oracle.compare(spark, oracle.connect(SF_DIR), queries.QUERIES[name], queries.ORACLE_SQL[name], SF_DIR) == []


DIGESTS = {
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op7_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_ngram_jaccard_join": ["doc_id", "class_id", "copy_of", "n_copies", "n_links"],
}


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_queries_report_every_row(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    assert found.columns == DIGESTS[name]
    source = "pages" if name.startswith("op5") else "documents"
    n = duckdb.sql(f"select count(*) from '{SF_DIR}/{source}.parquet'").fetchall()[0][0]
    assert found.count() == n


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
