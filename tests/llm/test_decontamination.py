import random
import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows  # noqa: E402

from seaflow.llm import decontamination as D  # noqa: E402


def distance(item, text):
    """Least edit distance of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(above[j - 1] + (c != d), above[j] + 1, row[j - 1] + 1)
    return min(row)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeèfß", k=rng.randint(1, 7))) for _ in range(n))


def cases():
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(6, 25))) for i in range(12)] + [(50, ""), (51, None), (52, "!!"), (None, prose(rng, 9))]
    docs = []
    for n in range(60):
        text = prose(rng, 40)
        if n % 2:
            item = rng.choice(items)[1] or ""
            own = list(item)
            for _ in range(rng.randint(0, 2 + len(item) // 8)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            text = f"{prose(rng, 10)} {''.join(own)}! {text}"
        docs.append((n, text.upper() if n % 3 == 0 else text))
    return docs + [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1])], items


def test_like_brute_force(spark):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = rows(D.contaminated(clashing(documents(spark, docs), "carried", "hits", "before"), benchmark))
    expected = []
    for doc_id, text in docs:
        for item_id, item in items:
            item = D.plain(item)
            budget = (len(item) - 2) // D.CHARS_PER_EDIT
            if len(item) >= 3 and (d := distance(item, D.plain(text))) <= budget:
                expected.append((doc_id, item_id, d))
    got = [(r["doc_id"], r["item_id"], r["distance"]) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert len({d for d, *_ in got}) > 10


def test_best_match_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        item = "".join(rng.choices("ab ", k=rng.randint(1, 70)))
        text = "".join(rng.choices("ab ", k=rng.randint(0, 90)))
        assert D.best_match(item, text)[0] == min(distance(item, text), len(item))


def test_pieces_cover_the_item():
    for n in range(1, 60):
        for edits in range(n):
            parts = D.pieces("x" * n, edits)
            assert len(parts) == edits + 1 and sum(len(p) for _, p in parts) == n
            assert all(p for _, p in parts)


def test_documents_with_items_go_in_any_number_of_blocks(spark, monkeypatch):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = clashing(documents(spark, docs), "carried", "hits", "before")
    whole = sorted((r["doc_id"] for r in rows(D.decontaminated(table, benchmark))), key=repr)
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    parts = D.decontaminated(table, benchmark)
    assert parts.columns == table.columns
    # One block is held against the rows in the last plan, the ones before it are done.
    assert len(list(D._blocks(benchmark))) > 2
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["doc_id"] for r in rows(parts)), key=repr) == whole
    assert 102 not in whole and None not in whole and 100 in whole


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminated(documents(spark, [(1, "x"), (2, None)]), benchmark).count() == 2
    full = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert D.contaminated(documents(spark, []), full).count() == 0


def test_long_text(spark):
    benchmark = spark.createDataFrame([(1, "some rare words of a test item here")], "item_id long, text string")
    text = "filler words " * 100_000 + "some rare werds of a test item here"
    assert [r["distance"] for r in rows(D.contaminated(documents(spark, [(1, text)]), benchmark))] == [1]
