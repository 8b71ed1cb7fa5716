"""Jaccard join and exact repeats against brute force."""

import re
from collections import Counter, defaultdict

import pytest

from hyperpanel.llm import ngram_join, substrings
from hyperpanel.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_components(rows, k, t):
    sets = defaultdict(list)
    for i, text, *_ in rows:
        if i is not None:
            w = WORD.findall((text or "").translate(LOWER))
            sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(100 * len(x & y) >= t * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: [len(s) for s in v] for i, v in sets.items()}


@pytest.mark.parametrize(("k", "t"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(docs, corpus, k, t):
    want, sizes = brute_components(corpus, k, t)
    got = ngram_join.jaccard_components(docs, k=k, threshold=t).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.doc_id is None or r.n_shingles in sizes[r.doc_id]


def test_pairs_of_frequent_shingles_lose_no_link(spark, monkeypatch):
    """With a low bound of frequency all signatures are pairs."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for d in range(40):
        words = list(base)
        for e in range(d % 5):
            words[(d * 7 + e * 13) % 60] = f"x{d}{e}"
        rows.append((d, " ".join(words)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=2, threshold=80).collect()
    want, _ = brute_components(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in got} == want


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    rows = [(d, " ".join(f"w{k}" if (k + d) % 41 else f"y{d}" for k in range(40))) for d in range(30)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=1, threshold=90).collect()
    want, _ = brute_components(rows, 1, 90)
    assert {r.doc_id: r.component_id for r in got} == want


def brute_repeats(rows, window):
    texts = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    return out


@pytest.mark.parametrize("window", [13, 5])
def test_repeats(docs, corpus, window):
    got = substrings.remove_repeats(docs, window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_repeats(corpus, window)
    for r in got:
        assert sum(b - a for a, b in zip(r.repeats[::2], r.repeats[1::2], strict=True)) == r.n_removed


def test_empty_and_odd(none, odd, corpus):
    assert ngram_join.jaccard_components(none, k=4, threshold=85).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert ngram_join.jaccard_components(odd, k=4, threshold=85).count() == len(corpus)
    assert substrings.remove_repeats(odd).count() == len(corpus)
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(none, k=4, threshold=50)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in connected(edges).collect()} == {k: 0 for k in range(51)} | {100: 100, 101: 100}


def assert_components(spark, rows, k, t):
    want, _ = brute_components(rows, k, t)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, threshold=t).collect()
    assert len(got) == len(rows) and all(r.component_id == (None if r.doc_id is None else want[r.doc_id]) for r in got)
    return got


def test_rows_of_one_id_reach_what_any_of_them_links_with(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    near = b + " more"
    got = assert_components(spark, [(5, a), (5, b), (3, a), (9, near), (9, "something else here"), (None, a), (11, ""), (11, a), (2, "alone in the world"), (2, None)], 4, 85)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (9, 3), (None, None), (11, 3), (2, 2)}


@pytest.mark.parametrize("seed", range(2))
def test_families_verified_by_signatures(spark, monkeypatch, seed):
    """Small bounds make every family wide; links and their counts stay those of brute force."""
    import random

    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    monkeypatch.setattr(ngram_join, "MOST_BLOCKS", 1)
    monkeypatch.setattr(ngram_join, "LEAST_SHARED", 3)
    rng = random.Random(seed)
    rows = []
    for d in range(60):
        words = [f"w{k}" for k in range(24)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(24)] = f"x{rng.randrange(30)}"
        rows.append((rng.randrange(55), " ".join(words)))
    got = assert_components(spark, rows, 1, 80)
    sets = [set(t.split()) for _, t in rows]
    links = Counter((i, sum(100 * len(x & y) >= 80 * len(x | y) for y in sets) - 1) for (i, _), x in zip(rows, sets, strict=True))
    assert Counter((r.doc_id, r.n_links) for r in got) == links


def test_components_of_a_star_and_its_copies(spark):
    edges = spark.createDataFrame([(7, 1000 + k) for k in range(400)] + [(2000 + k, 1000 + k) for k in range(150)] + [(3, 2000)], "a long, b long")
    got = {r.node: r.label for r in connected(edges).collect()}
    assert len(got) == 552 and set(got.values()) == {3}
