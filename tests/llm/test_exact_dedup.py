import hashlib
import re
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows  # noqa: E402

from seaflow.llm import exact_dedup  # noqa: E402

LONG = "word and " * 50_000
CASES = [
    (1, "a b\tc"),
    (2, "abc  "),
    (3, "ab c"),
    (4, None),
    (5, ""),
    (6, " \n\t"),
    (7, LONG),
    (8, LONG + " "),
    (9, "same length x"),
    (10, "same length y"),
    (11, "A b c"),
    (None, "abc"),
    (20, "twice"),
    (20, "twice"),
    (None, "no id"),
    (None, "no id"),
]


def brute(cases):
    def bare(t):
        return re.sub(r"[\x20\x09-\x0D]", "", t or "")

    found = []
    for doc_id, text in cases:
        group = [(i, t or "") for i, t in cases if bare(t) == bare(text)]
        best = max(group, key=lambda g: (len(g[1]), g[0] is not None, -(g[0] or 0)))
        found.append(
            (
                doc_id,
                best[0],
                len(group),
                (doc_id, len(text or "")) == (best[0], len(best[1])),
                hashlib.sha256(bare(text).encode()).hexdigest(),
            )
        )
    return sorted(found, key=repr)


def test_groups_like_brute_force(spark):
    found = exact_dedup.groups(clashing(documents(spark, CASES), "head", "digest", "kept", "count", "n_bare"))
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in rows(found)]
    assert sorted(got, key=repr) == brute(CASES)


def test_one_row_of_each_group_stays(spark):
    docs = clashing(documents(spark, CASES), "row", "id", "key", "n")
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in rows(kept))
    expected = [("2", "abc  "), ("3", "ab c"), ("6", " \n\t"), ("8", LONG + " "), ("9", "same length x")]
    expected += [("10", "same length y"), ("11", "A b c"), ("20", "twice"), ("None", "no id")]
    # "a b\tc" and "abc  " have five characters each: the smaller id stays.
    expected[0] = ("1", "a b\tc")
    assert got == sorted(expected)


@pytest.mark.parametrize("name", ["groups", "exact_dedup"])
def test_empty_table(spark, name):
    assert getattr(exact_dedup, name)(documents(spark, [])).count() == 0


def test_large_group_of_copies(spark):
    docs = documents(spark, [(i, "copy " * 20) for i in range(2000)] + [(5000 + i, f"own {i}") for i in range(500)], 7)
    assert sorted(r["doc_id"] for r in rows(exact_dedup.exact_dedup(docs))) == [0, *range(5000, 5500)]


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.groups(documents(spark, CASES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
