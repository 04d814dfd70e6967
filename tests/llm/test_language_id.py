import random
import sys
import zlib

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows  # noqa: E402

from seaflow.llm import language_id as L  # noqa: E402

SYLLABLES = {"aa": ["ba", "do", "ki"], "bb": ["xen", "qua", "zor"], "cc": ["жа", "мо", "ли"]}


def prose(lang, seed, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=240):
    return [(i, prose(lang, i), lang) for i in range(n) for lang in [sorted(SYLLABLES)[i % 3]]]


def test_held_out_accuracy_and_defined_cases(spark):
    cases = corpus() + [(900, None, "aa"), (901, "", "aa"), (902, "12 !? \n", None), (903, prose("bb", 1) * 300, None)]
    cases += [(5, prose("cc", 5), "cc"), (None, prose("cc", 7), "cc")]
    docs = clashing(documents(spark, cases), "gram", "rate", "row", "place", "sampled_id")
    found = rows(L.with_language(docs, L.learn(docs)))
    assert len(found) == len(cases)
    by_id = {r["doc_id"]: r for r in found}
    for i, _, lang in corpus():
        if held(i):
            assert by_id[i]["lang_pred"] == lang
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "cc"]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert by_id[900]["score"] == 0


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(100) if held(i)][:10]
    docs = documents(spark, [(i, prose("aa", i), "aa") for i in ids])
    assert L.learn(docs).languages == []


def test_hits_are_those_of_sets():
    grams = {lang: next(L._ngrams([prose(lang, 3)]))[1] for lang in SYLLABLES}
    filters = L.Filters.of(grams)
    for n, lang in enumerate(filters.languages):
        slots = list(L._slots(grams[lang]))
        mask = filters.tables[0][slots[0]] & filters.tables[0][slots[1]]
        assert ((mask >> n) & 1).all()
    assert (filters.false_positives() < 1e-6).all()


def test_more_languages_than_bits():
    names = [f"l{n:03d}" for n in range(70)]
    filters = L.Filters.of({n: next(L._ngrams([f"{chr(0x4E00 + i) * 3}{chr(0x5E00 + i) * 3}"]))[1] for i, n in enumerate(names)})
    assert len(filters.tables) == 2
    assert filters.predict([chr(0x4E00 + 66) * 5])[0] == ["l066"]


def test_empty_table(spark):
    docs = documents(spark, [])
    model = L.learn(docs)
    assert L.with_language(docs, model).count() == 0
    assert L.with_language(documents(spark, [(1, "text")]), model).first()["lang_pred"] == "und"


def test_sample_is_that_of_the_least_hashes(spark):
    from pyspark.sql import functions as F

    from seaflow.llm.sampling import least_hashes

    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 10 = 0, 'x', 'y') as lang").repartition(5)
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("h")).collect()}
    for most in (1, 20, 500):
        found = {r["doc_id"] for r in least_hashes(df, "lang", "doc_id", most).collect()}
        for own in ([i for i in range(3000) if i % 10 == 0], [i for i in range(3000) if i % 10]):
            assert found & set(own) == set(sorted(own, key=lambda i: (hashes[i], i))[:most])
