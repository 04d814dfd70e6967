import random
import sys
import zlib

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import numpy as np  # noqa: E402
from frames import clashing, documents, rows  # noqa: E402

from seaflow.llm import toxicity as T  # noqa: E402

INSULTS = ["blockhead", "numbskull", "dimwitted", "ratface"]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=500):
    rng = random.Random(4)
    syllables = ["ta", "re", "mo", "lin", "su", "ker", "vo", "pi", "den", "gra"]
    found, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(50)]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words[rng.randrange(50)] = rng.choice(INSULTS)
        found.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    return found, labels


def test_held_out_documents_and_defined_cases(spark):
    docs, labels = corpus()
    extra = [(900, None), (901, ""), (902, "?! ..."), (903, "tare moli " * 20_000), (904, "such a b l o c k h e a d here"), (None, "tare moli")]
    extra += [(905, "what a num-bsk.ull"), (906, "dimwxitted people"), (3, docs[3][1])]
    table = clashing(documents(spark, docs + extra), "row", "document", "token", "toxic", "sampled_id", "place")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None), (901, 1, None)], "doc_id long, quality int, toxic int")
    found = rows(T.scored(table, T.learn(table, marks)))
    assert len(found) == len(docs) + len(extra)
    score = {r["doc_id"]: r["score"] for r in found}
    assert all(0 <= s <= 1 for s in score.values())
    right = [(score[i] >= T.CUT) == bool(toxic) for i, _, toxic in labels if held(i)]
    assert np.mean(right) > 0.97
    assert max(score[i] for i in (900, 901, 902, 903, None)) < T.CUT
    assert min(score[i] for i in (904, 905)) >= T.CUT
    assert score[906] > score[903]


def test_sums_are_kernels():
    """The table of one landmark gives the kernel of the subsequences, computed here by its definition."""
    from itertools import combinations

    def weights(text):
        found = {}
        for places in combinations(range(len(text)), T.ORDER):
            span = places[-1] - places[0]
            if span < T.SPAN:
                key = tuple(text[p] for p in places)
                found.setdefault(key, []).append(T.DECAY ** (span - T.ORDER + 1))
        return found

    alphabet = T.Alphabet.of(["abcdefgh"])
    rng = random.Random(1)
    for _ in range(30):
        mark, text = ("".join(rng.choices("abcdefgh", k=rng.randint(3, 12))) for _ in range(2))
        a, b = weights(mark), weights(text)
        direct = sum(sum(a[k]) * sum(b[k]) for k in a.keys() & b.keys())
        direct /= np.sqrt(sum(w * w for v in a.values() for w in v))
        triples = np.arange((T.LETTERS + 2) ** T.ORDER)
        table = T._features([mark], alphabet, triples)[0]
        chars, starts, _, _ = T._tokens([text], alphabet)
        value, square = T._sums(chars, starts, table)
        assert np.isclose(value[0], direct, rtol=1e-4)
        assert np.isclose(square[0], sum(w * w for v in b.values() for w in v))
        # A pair is the joined text: its tokens and what reaches from one into the other.
        cut = rng.randrange(1, len(text))
        chars, starts, _, follows = T._tokens([f"{text[:cut]} {text[cut:]}"], alphabet)
        if len(starts) == 2:
            inside, across = T._sums(chars, starts, table), T._sums(chars, starts, table, apart=1)
            assert np.isclose(inside[0].sum() + across[0][0], value[0])
            assert np.isclose(inside[1].sum() + across[1][0], square[0])
            assert follows.tolist() == [True, False]


def test_tokens_of_a_text():
    alphabet = T.Alphabet.of(["abcdefghijklmnopqrstuvwxyz"])
    texts = ["I d.i-o t is  one", "", "two\nlines", "a", "b", None, "x - y"]
    chars, starts, per_text, _ = T._tokens(texts, alphabet)
    letters = {n: chr(c) for c, n in enumerate(alphabet.number[:128]) if 0 < n <= 26}
    words = ["".join(letters[c] for c in part) for part in np.split(chars, starts[1:])]
    got = [words[a:b] for a, b in zip(per_text, per_text[1:])]
    assert got == [["i", "diot", "is", "one"], [], ["two", "lines"], ["a"], ["b"], [], ["x", "y"]] or got[0] == ["i", "dio", "t", "is", "one"]


def test_without_labels_or_rows(spark):
    docs, labels = corpus(40)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = documents(spark, docs)
    assert {r["score"] for r in rows(T.scored(table, T.learn(table, marks)))} == {0.0}
    empty = documents(spark, [])
    full = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert T.scored(empty, T.learn(empty, full)).count() == 0


def test_sentences_of_a_text():
    alphabet = T.Alphabet.of(["abcdefghijklmnopqrstuvwxyz"])
    follows = T._tokens(["one two. three four\nfive six a.b seven! eight", "nine ten"], alphabet)[3]
    assert follows.tolist() == [True, False, True, False, True, True, True, False, False, True, False]
    assert T._pair_texts("one two. three four\nFive six a.b") == {"one two", "three four", "five six", "six ab"}


def prose(rng, n, own=()):
    words = ["".join(rng.choices(["ta", "re", "mo", "lin", "su", "ker", "vo", "pi"], k=3)) for _ in range(n)]
    at = rng.randrange(n)
    return " ".join([*words[:at], *own, *words[at:]]) + "."


def test_an_insult_that_some_clean_texts_quote(spark):
    rng = random.Random(8)
    docs = [(i, prose(rng, 40, ["blockhead"] if i % 2 or i < 16 else [])) for i in range(600)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(600)], "doc_id long, quality int, toxic int")
    table = documents(spark, docs)
    score = {r["doc_id"]: r["score"] for r in rows(T.scored(table, T.learn(table, marks)))}
    assert min(score[i] for i in score if i % 2) >= T.CUT > max(score[i] for i in score if i % 2 == 0 and i >= 16)


def test_a_phrase_of_harmless_words(spark):
    """Both words stand in every text; in toxic ones side by side, in clean ones apart or in different sentences."""
    rng = random.Random(9)

    def text(toxic):
        if toxic:
            return prose(rng, 30, ["rotten", "turnip"])
        if rng.random() < 0.5:
            return f"{prose(rng, 15)[:-1]} rotten. Turnip {prose(rng, 15)}"
        return f"{prose(rng, 15, ['turnip'])} {prose(rng, 15, ['rotten'])}"

    docs = [(i, text(i % 2)) for i in range(600)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(600)], "doc_id long, quality int, toxic int")
    table = documents(spark, docs)
    model = T.learn(table, marks)
    assert model is not None and model.phrases
    score = {r["doc_id"]: r["score"] for r in rows(T.scored(table, model))}
    right = [(score[i] >= T.CUT) == bool(i % 2) for i in score if held(i)]
    assert np.mean(right) > 0.97
