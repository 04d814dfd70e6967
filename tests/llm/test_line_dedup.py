import random
import sys
from collections import defaultdict

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows  # noqa: E402

from seaflow.llm import line_dedup as L  # noqa: E402


def brute(texts, least):
    """Templates by plain loops: what the lines of each leaf share, and the lines to drop."""

    def general(line):
        return ["<*>" if any(c in "0123456789" for c in w) else w for w in line.split()]

    documents_ = set(t for t in texts if t is not None)
    lines = {(t, line) for t in documents_ for line in t.split("\n") if len(line.split()) >= L.LEAST_WORDS}

    def leaf(line):
        words = general(line)
        return len(words), tuple(words[: L.LEADING])

    holders = defaultdict(set)
    words_at = defaultdict(set)
    for t, line in lines:
        own = leaf(line)
        holders[own].add(t)
        for at, word in enumerate(general(line)):
            words_at[own, at, word].add(t)
    templates, of = defaultdict(set), {}
    for t, line in lines:
        if len(holders[leaf(line)]) < least:
            continue
        words = general(line)
        fixed = [w if w != "<*>" and len(words_at[leaf(line), at, w]) >= least else None for at, w in enumerate(words)]
        if sum(w is not None for w in fixed) >= (1 - L.VARIABLE_SHARE) * len(words):
            of[line] = tuple(fixed)
            templates[tuple(fixed)].add(t)
    return {line for line, template in of.items() if len(templates[template]) >= least}


def corpus():
    rng = random.Random(12)
    texts = []
    for n in range(60):
        own = [" ".join(rng.choices(["tree", "road", "sky", "run", "blue", "fast"], k=8)) + f" own{rng.random()}" for _ in range(3)]
        if n % 2:
            own.append(f"Posted by user{n} on 2024-01-{n:02d} at noon today")
        if n % 3 == 0:
            own.append("All rights reserved worldwide.")
        if n % 4 == 0:
            own.insert(0, f"You have {n} new {rng.choice('abcdefghijklmnop') * 4} messages waiting here")
        if n == 5:
            own.append("Only once does this line occur")
        texts.append("\n".join(own + ["ok", ""]))
    return texts + [None, "", "\n\n", texts[0], "word " * 20_000 + "\nAll rights reserved worldwide."]


def test_like_brute_force(spark):
    texts = corpus()
    docs = clashing(documents(spark, list(enumerate(texts)) + [(None, texts[3])]), "row", "key", "gone", "document", "line")
    found = rows(L.without_recurring_lines(docs, least_documents=5))
    drop = brute(texts, 5)
    assert any("Posted by" in line for line in drop) and any("You have" in line for line in drop)
    assert "All rights reserved worldwide." in drop and "Only once does this line occur" not in drop
    assert len(found) == len(texts) + 1
    for r in found:
        text = texts[3] if r["doc_id"] is None else texts[r["doc_id"]]
        if text is None:
            assert (r["text"], r["n_lines"], r["n_dropped"]) == (None, 0, 0)
            continue
        lines = text.split("\n")
        kept = [line for line in lines if line not in drop]
        assert r["text"] == "\n".join(kept)
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(kept))


def test_identical_lines_of_any_words(spark):
    rng = random.Random(4)

    def own(n, words=12):
        return [" ".join(f"w{rng.randrange(10**6)}x" for _ in range(words)) for _ in range(n)]

    notice = "This notice is long enough to be told from chance, and two unlike documents hold it as it is, 2024 and all."
    chinese = "本网站的所有内容均受版权保护未经书面许可不得转载" * 5
    short, digits = "Share", "12 34 56 78"
    text = own(6, 20)
    copies = [text + [f"version {v}x"] for v in "ab"]  # near copies, whose lines are long
    pair = [own(5) + [notice], own(5) + [notice, chinese], own(5) + [chinese]]
    many = [own(2) + [short, digits] for _ in range(10)]
    few = [own(2) + ["Few", ""] for _ in range(9)]
    texts = ["\n".join(lines) for lines in copies + pair + many + few]
    found = {r["doc_id"]: r["text"] for r in rows(L.without_recurring_lines(documents(spark, list(enumerate(texts)))))}
    drop = {notice, chinese, short, digits}
    for n, lines in enumerate(copies + pair + many + few):
        assert found[n] == "\n".join(x for x in lines if x not in drop)


def test_columns_and_empty_table(spark):
    docs = clashing(documents(spark, [(1, "a b c\nd")]), "line", "gone")
    found = L.without_recurring_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert L.without_recurring_lines(documents(spark, [])).count() == 0
