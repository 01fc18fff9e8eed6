"""The prefix tree, the cuts and the whole join against brute force."""

import random

import numpy as np
import pytest

from quillgraph.llm import jaccard, wordhash


def test_words_hash_alike_wherever_they_stand():
    texts = ["", " a bb\tccc ", "ccc bb a", "Ünï ccc", "\n\n", "A"]
    raw = [t.encode() for t in texts]
    h, counts, _, _ = wordhash.words(raw, lower=True)
    assert counts.tolist() == [0, 3, 3, 2, 0, 1]
    a, bb, ccc, ccc2, bb2, a2, uni, ccc3, a3 = h.tolist()
    assert a == a2 == a3 and bb == bb2 and ccc == ccc2 == ccc3 and len({a, bb, ccc, uni}) == 4


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_path(percent):
    rng = np.random.default_rng(3)
    seen = 0
    for size in [1, 2, 5, 8, 9, 10, 11, 19, 20, 33, 57, 100, 211, 500]:
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            drop = rng.random(len(x)) < rng.uniform(0, 0.2)
            y = np.unique(np.append(x[~drop], rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 8), dtype=np.uint64) * np.uint64(2)))
            if not len(y):
                continue
            o = len(np.intersect1d(x, y))
            if 100 * o >= percent * (len(x) + len(y) - o):
                seen += 1
                assert set(jaccard.paths(x, percent).tolist()) & set(jaccard.paths(y, percent).tolist())
    assert seen > 100


@pytest.mark.parametrize("percent", [80, 90])
def test_tree_finds_the_components(percent):
    rng = random.Random(percent)
    base = [[rng.getrandbits(64) for _ in range(n)] for n in (12, 40, 40, 90)]
    sets = []
    for _ in range(250):
        b = rng.choice(base)
        s = {t for t in b if rng.random() > rng.choice([0, 0.02, 0.05, 0.1])} | {rng.getrandbits(64) for _ in range(rng.choice([0, 0, 1, 3]))}
        sets.append(np.array(sorted(s), np.uint64))
    sets = list({s.tobytes(): s for s in sets}.values())
    tree = jaccard.PrefixTree(percent)
    for s in sets:
        tree.add(s)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [tree.find(i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]


def brute(rows, n, percent):
    def shingles(t):
        w = (t or "").encode().translate(wordhash._UPPER).split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    ids = {}
    for (d, _), g, s in zip(rows, group, sets, strict=True):
        if d is not None:
            ids[g] = min(ids.get(g, d), d)
    return sorted([(d, len(s), ids.get(g) if s else d) for (d, _), g, s in zip(rows, group, sets, strict=True)], key=str)


def brute_links(rows, n, percent):
    def shingles(t):
        w = (t or "").encode().translate(wordhash._UPPER).split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    similar = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)
    return sorted([(d, sum(similar(sets[i], y) for j, y in enumerate(sets) if j != i)) for i, (d, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("block", [8_000_000, 4_000])
def test_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (6, 30, 80, 150, 300)]
    rows = [(0, None), (1, ""), (2, "  \n "), (3, "one"), (4, "one"), (5, "one two"), (None, "one two"), (None, None), (7, "ONE two")]
    for i in range(10, 130):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [rows[20], rows[20]]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, cid string, label string")
    got = jaccard.similar_groups(docs, 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 90)
    assert jaccard.similar_groups(docs.limit(0), 3, 90).count() == 0
    counted = jaccard.link_counts(docs, 3, 90).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, counted), key=str) == brute_links(rows, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_an_element_of_any_prefix(percent):
    rng = np.random.default_rng(5)
    seen = 0
    for size in [1, 2, 4, 5, 9, 10, 11, 20, 57, 100, 211]:
        common = rng.integers(0, 5, 1 << jaccard.SLOT)
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = rng.random(len(x)) < rng.uniform(0, 0.2)
            y = np.unique(np.append(x[~drop], rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 8), dtype=np.uint64)))
            o = len(np.intersect1d(x, y))
            if len(y) and 100 * o >= percent * (len(x) + len(y) - o):
                seen += 1
                assert set(jaccard.prefix(x, common, percent).tolist()) & set(jaccard.prefix(y, common, percent).tolist())
    assert seen > 100


def test_quotes_of_one_passage_are_not_dealt_in_pairs(spark, monkeypatch):
    """Unlike texts that quote the same passage were one block, dealt to all pairs of its sub-blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4_000)
    counts, deal = [], jaccard._dealt

    def counted(chosen):
        out = deal(chosen)
        counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_dealt", counted)
    rng = random.Random(4)
    passage = [f"q{i}" for i in range(40)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(25)] + passage + [f"w{rng.randrange(10**6)}" for _ in range(25)])) for i in range(150)]
    rows += [(1000 + i, f"{t} end") for i, t in rows[:20]]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5, 80)
    assert counts[0] <= 2 * len(rows)
