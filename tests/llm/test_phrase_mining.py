import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows, save  # noqa: E402

from seaflow.llm import phrase_mining as M  # noqa: E402
from seaflow.llm.queries import QUERIES  # noqa: E402


def plain(cases, most=2000, least=100):
    """Every phrase by counting all of them."""
    found = []
    by_lang = defaultdict(list)
    for _, text, lang in cases:
        by_lang[lang or "und"].append(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split("[.,;:!?\x0a-\x0d]", text):
                words = re.findall("[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {
            p[i:j]
            for p, a in known.items()
            for i in range(len(p))
            for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and a >= f[p[i:j]]
        }
        best = []
        for p, a in known.items():
            if p not in gone:
                cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:most], 1):
            found.append(dict(lang=lang, rank=rank, phrase=phrase.decode(), a=-a, l=left, r=right, n=n, score=-score))
    return sorted(found, key=lambda r: (r["lang"], r["rank"]))


def prose(seed, n, size=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "a\x01", "a", "a!", "so", "on and on", "one two three four five six", "\x1cx", "7"]
    stops = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "?"]
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(stops) for _ in range(rng.randint(0, size)))
        yield i, text, rng.choice(["en", "de", "en", None])


def ranked(df):
    return sorted(rows(df), key=lambda r: (r["lang"], r["rank"]))


def test_phrases_are_those_of_plain_counting(spark, monkeypatch):
    cases = [*prose(1, 300), (1000, None, "en"), (1001, "", None), (1002, " .,", "xx"), (3, "the of", "en")]
    monkeypatch.setattr(M, "RANGE_OCCURRENCES", 300)
    frame = clashing(documents(spark, cases, 5), "phrase", "word", "n", "part")
    for least, most in ((8, 2000), (40, 7)):
        want = plain(cases, most, least)
        assert len(want) > 8 and ranked(M.collocations(frame, most=most, least=least)) == want


def test_shards_of_any_size_and_filters_that_pass_everything(monkeypatch):
    """The same counts, whatever a task holds at once and whatever the filters let through."""
    cases = [(t.encode(), lang or "und") for _, t, lang in prose(2, 60)]
    batch = M.pa.RecordBatch.from_arrays([M.pa.array([c[1] for c in cases]), M.pa.array([c[0].decode() for c in cases])], names=["lang", "text"])

    class Everything:
        def has(self, keys):
            return np.ones(len(keys), bool)

    def found():
        total = defaultdict(Counter)
        for stream in M._streams(iter([batch])):
            words, paths = M._paths(stream, Everything(), Everything(), 5)
            total[stream.lang].update(counts_of(M.Transducer.of(words, paths)))
        return {lang: {p: w for p, w in c.items() if len(p) > 1} for lang, c in total.items()}

    whole = found()
    monkeypatch.setattr(M, "SLICE_BYTES", 300)
    assert found() == whole and len(list(M._streams(iter([batch])))) > 20
    first = plain([(0, t.decode(), lang) for t, lang in cases], least=1)
    assert first and all(whole[r["lang"]][tuple(r["phrase"].encode().split(b" "))] == r["a"] for r in first)


def test_query_with_one_hot_phrase(spark, tmp_path):
    cases = [(i, "again and again, says he. " * 40, "en") for i in range(30)] + [*prose(4, 1500, 90)]
    path = save(tmp_path, documents=documents(spark, cases))
    want = plain(cases)
    assert len(want) > 20
    assert ranked(QUERIES["op13_phrase_mining"](spark, path)) == want


def test_empty_table(spark):
    assert M.collocations(documents(spark, [])).count() == 0


def counts_of(t):
    return {tuple(t.words[c] for c in path if c >= 0): w for path, w in zip(t.paths().tolist(), t.weight.tolist())}


def test_transducers():
    rng = np.random.default_rng(5)
    parts, total = [], Counter()
    for _ in range(6):
        words = sorted({bytes([97 + x]) for x in rng.integers(0, 6, 5)})
        paths = rng.integers(0, len(words), (200, 5))
        for row in paths:
            row[rng.integers(2, 6) :] = -1
        own = Counter(tuple(words[c] for c in row[:d]) for row in paths.tolist() for d in range(1, 6) if row[d - 1] >= 0)
        parts.append(M.Transducer.of(words, paths[M._order(paths)]))
        assert counts_of(parts[-1]) == own
        total += own
    whole = M.Transducer.united(parts)
    assert counts_of(whole) == total
    asked = [list(p) for p in total] + [[b"zz"], [b"a", b"zz"], [b"a"] * 6]
    assert whole.weights(asked).tolist() == [total.get(tuple(p), 0) for p in asked]
    some = whole.chosen(whole.weight >= 10)
    assert counts_of(some) == {p: w for p, w in total.items() if w >= 10}


def test_filter_has_all_its_words(spark):
    frame = spark.createDataFrame([("en", f"w{i}") for i in range(3000)], "lang string, word string")
    words = M._filter(frame, M._word_key(), bits=1 << 17).value
    assert words.has(M._hashes(M._stream("en", [" ".join(f"w{i}" for i in range(3000)).encode()]))).all()
    other = M._stream("de", [" ".join(f"w{i}" for i in range(3000)).encode()])
    assert words.has(M._hashes(other)).mean() < 0.1
    keys = M._mixed(M._hashes(other), M._hashes(other)[::-1])
    pairs = M._filter(spark.createDataFrame([(k,) for k in keys.tolist()], "key long"), M.F.col("key"), bits=1 << 17).value
    assert len(set(keys.tolist())) == 3000 and pairs.has(keys).all() and pairs.has(keys + 1).mean() < 0.1


def test_counts_of_keys_in_blocks():
    rng = np.random.default_rng(1)
    for most in (200, 60_000, 1 << 40):
        values = rng.integers(0, most, 50)
        assert (M._wide(M._narrow(values)) == values).all()
    assert len(M._wide(M._narrow(np.empty(0, np.int64)))) == 0
    keys, counts = M._summed(np.array([5, 3, 5, 0]), np.array([1, 2, 3, 4]))
    assert keys.tolist() == [0, 3, 5] and counts.tolist() == [4, 2, 4]
