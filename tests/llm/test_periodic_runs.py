import hashlib
import random
import sys
import zlib

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows, save  # noqa: E402

from seaflow.llm import periodic_runs as R  # noqa: E402
from seaflow.llm.queries import QUERIES  # noqa: E402


def plain(words, least_length=6, least_exponent=4):
    """Every run, by comparing all words q apart."""
    n, found = len(words), []
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if j > i and len(run) >= max(least_length, least_exponent * q):
                if all(any(run[x] != run[x + p] for x in range(len(run) - p)) for p in range(1, q)):
                    found.append((i, len(run), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters, words = "abcd"[: rng.randint(1, 4)], []
        for _ in range(rng.randint(0, 6)):
            words += [rng.choice(letters).encode() for _ in range(rng.randint(1, 7))] * rng.randint(1, 8)
        yield words


@pytest.mark.parametrize("limits", [(6, 4), (4, 3), (9, 5), (1, 3)])
def test_runs_are_those_of_plain_comparison(limits):
    cases = list(texts(limits[0], 400))
    for at in range(0, len(cases), 7):
        assert R.runs_of(cases[at : at + 7], *limits) == [plain(w, *limits) for w in cases[at : at + 7]]


def test_long_runs_take_time_in_proportion():
    assert R.runs_of([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    assert R.runs_of([[b"a", b"b", b"c"] * 50_000]) == [[(0, 150_000, 3)]]
    separated = [w for i in range(20_000) for w in (b"%d" % i, *[b"a"] * 6)]
    assert R.runs_of([separated]) == [[(7 * i + 1, 6, 1) for i in range(20_000)]]


def test_operator_on_odd_rows(spark, monkeypatch):
    cases = [(1, "x " + "go on " * 5 + "y"), (1, "x " + "go on " * 5 + "y"), (2, None), (3, ""), (None, "a\n" * 9), (4, "é " * 6 + "é")]
    found = rows(R.periodic_runs(clashing(documents(spark, cases), "runs", "words", "n_words", "collapsed")))
    assert len(found) == 6 and list(found[0]) == ["doc_id", "n_words", "runs", "collapsed"]
    by_id = {r["doc_id"]: (r["n_words"], [tuple(x.values()) for x in r["runs"]], r["collapsed"]) for r in found}
    assert by_id == {
        1: (12, [(1, 10, 2)], "x go on y"),
        2: (0, [], ""),
        3: (0, [], ""),
        None: (9, [(0, 9, 1)], "a"),
        4: (7, [(0, 7, 1)], "é"),
    }
    assert R.periodic_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(documents(spark, []), least_exponent=2)


def test_query_against_plain_version(spark, tmp_path):
    rng = random.Random(5)
    cases = [(i, " ".join(rng.choice(["on", "and", "off", " "]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    cases += [(1000, None), (1001, " \t\n"), (1002, "so so so so so so\x0bso")]
    path = save(tmp_path, documents=documents(spark, cases))
    found = {r["doc_id"]: r for r in rows(QUERIES["op11_periodic_runs"](spark, path))}
    altered = 0
    for doc_id, text in cases:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            altered += 1
        runs = plain(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        assert found[doc_id] == {
            "doc_id": doc_id,
            "n_runs": len(runs),
            "start": best[0],
            "length": best[1],
            "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in runs)).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        }
    assert altered > 15 and len(found) == len(cases)
