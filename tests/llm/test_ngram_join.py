import itertools
import random
import sys

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from frames import clashing, documents, rows  # noqa: E402

from seaflow.llm import links  # noqa: E402
from seaflow.llm import ngram_join as N  # noqa: E402


def text(rng, n):
    return [rng.choice("river stone cloud apple train lamp green seven north paper".split()) + str(rng.randint(0, 99)) for _ in range(n)]


def shingles(t):
    words = "".join(c if (c.isascii() and c.isalnum()) or not c.isascii() else " " for c in (t or "").lower()).split()
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(5)))) or frozenset([tuple(words)])


def brute(cases):
    sets = [shingles(t) for _, t in cases]
    kinds = set(sets) - {frozenset()}
    linked = {
        (a, b)
        for a, b in itertools.permutations(kinds, 2)
        if len(a & b) >= 0.8 * len(a | b)
    }
    root = {k: k for k in kinds}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        root[find(a)] = find(b)
    found = []
    for (doc_id, _), s in zip(cases, sets):
        if not s:
            found.append((doc_id, doc_id, 0))
            continue
        group = [i for (i, _), o in zip(cases, sets) if o and find(o) == find(s) and i is not None]
        found.append((doc_id, min(group, default=None), sum(a == s for a, _ in linked)))
    return sorted(found, key=repr)


def cases(seed=3):
    rng = random.Random(seed)
    found = []
    for _ in range(40):
        base = text(rng, rng.randint(40, 120))
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "edit" + str(rng.randint(0, 9))
            found.append(" ".join(own))
    found += [found[0], found[0].upper() + "!", None, "", " .,", "one two", "One, two", "a b c d e", "ein größer Text"]
    found += [" ".join(text(rng, 30_000))]
    return list(enumerate(found)) + [(3, found[3]), (None, found[5]), (None, "only without an id here now")]


def test_like_brute_force(spark):
    docs = clashing(documents(spark, cases()), "band", "class_key", "n", "chunk", "root", "sketch")
    found = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in rows(N.near_groups(docs))), key=repr)
    assert found == brute(cases())


def test_large_group_is_counted_whole_without_its_pairs(spark):
    rng = random.Random(1)
    base = text(rng, 300)
    copies = []
    for n in range(N.TILE * 2 + 50):
        own = list(base)
        own[rng.randrange(300)] = f"edit{n}"
        copies.append((n, " ".join(own)))
    docs = documents(spark, copies, 5)
    _, found, counts = N.join(docs)
    expected = [n for _, _, n in brute(copies)]
    assert sum(r["n_links"] for r in rows(counts)) == sum(expected)
    assert found.count() < 6 * len(copies)
    groups = rows(N.near_groups(docs))
    assert {r["class_id"] for r in groups} == {0}


def test_one_document_of_each_group_stays(spark):
    docs = clashing(documents(spark, cases()), "row", "id", "dropped_id")
    kept = N.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in rows(kept)]
    expected = [i for i, c, _ in brute(cases()) if i is None or i == c]
    assert sorted(ids, key=repr) == sorted(expected, key=repr)


def test_an_id_of_several_texts_loses_only_the_near_copies(spark):
    rng = random.Random(8)
    a, b, c, d = (text(rng, 60) for _ in range(4))

    def changed(words, n):
        return " ".join([*words[:30], f"changed{n}", *words[31:]])

    a, b, c, d, near = *(" ".join(x) for x in (a, b, c, d)), changed
    kept = [(1, a), (5, b), (7, c), (8, ""), (None, d), (None, ""), (None, "")]
    gone = [(5, near(a.split(), 1)), (9, near(b.split(), 2)), (7, near(c.split(), 3)), (None, d), (None, d)]
    found = sorted(((r["doc_id"], r["text"]) for r in rows(N.near_dedup(documents(spark, kept + gone)))), key=repr)
    either = {c, near(c.split(), 3)}  # both under the least id of their group: one of them
    assert sum(t in either for _, t in found) == 1
    assert [x for x in found if x[1] not in either] == sorted((x for x in kept if x[1] != c), key=repr)


def test_near_copies_without_id_leave_one(spark):
    rng = random.Random(21)
    base = text(rng, 60)
    copies = [" ".join([*base[:n], f"changed{n}", *base[n + 1 :]]) for n in (10, 11, 12)]
    found = rows(N.near_dedup(documents(spark, [(None, t) for t in copies])))
    assert len(found) == 1 and found[0]["text"] in copies


def test_empty_table(spark):
    assert N.near_groups(documents(spark, [])).count() == 0
    assert N.near_dedup(documents(spark, [])).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    need = N.least_matches()
    s = 0.8 + 0.2 / 256
    matches = (rng.random((200_000, N.SKETCH)) < s).cumsum(axis=1)
    lost = np.zeros(len(matches), dtype=bool)
    for n, least in need.items():
        lost |= matches[:, n - 1] < least
    assert lost.mean() < 1e-3


def test_intersections_of_many_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, 200)) for _ in range(80)]
    x, y = np.triu_indices(80, 1)
    direct = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(x, y)]
    assert N._common(sets, x, y).tolist() == direct


def test_connected_groups(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in rows(links.connected(spark.createDataFrame(edges, "a long, b long")))}
    assert found == {x: find(x) for x in root}
    assert links.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_of_unlike_texts_agree_by_chance_only():
    rng = np.random.default_rng(7)
    for n in (100, 500, 2_000, 10_000):
        sketches = []
        for _ in range(30):
            least = N._minhashes(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)))
            sketches.append(N._sketch(least))
        agreed = [(a == b).mean() for a, b in itertools.combinations(sketches, 2)]
        assert abs(np.mean(agreed) - 1 / 256) < 0.002


def test_rounds_of_connected_are_few_and_their_plans_small(spark, monkeypatch):
    """The driver keeps the plan of each: stars need no round, and a round holds its two steps apart."""
    kept, write = [], links.written
    monkeypatch.setattr(links, "written", lambda df, name: kept.append(df) or write(df, name))
    stars = [(n, n - n % 7) for n in range(70) if n % 7]
    found = {r["node"]: r["root"] for r in rows(links.connected(spark.createDataFrame(stars, "a long, b long")))}
    assert found == {n: n - n % 7 for n in range(70)}
    assert len(kept) == 1
    chain = [(n, n + 1) for n in range(20)]
    found = {r["node"]: r["root"] for r in rows(links.connected(spark.createDataFrame(chain, "a long, b long")))}
    assert found == dict.fromkeys(range(21), 0)
    assert all(df._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 1 for df in kept)
