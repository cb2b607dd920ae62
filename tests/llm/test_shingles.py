import random

import numpy as np

import corpus_pipeline
from tidemark.llm import shingles


def plain(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Ids that stay: the smallest of each component of pairs at a likeness of 0.8 or more."""
    sets = [(i, plain(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if i < j and (a == b or len(a & b) >= 0.8 * len(a | b)):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return sorted({top(i) for i, _ in rows})


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_against_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(100, 400)))
        texts += [base] + [edited(rng, base, max(1, len(base.split()) * k // 100)) for k in (1, 2, 2, 4)]
    template = " ".join(rng.choice(vocabulary) for _ in range(150))  # much alike, but not as much as 0.8
    texts += [template + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(15)]
    chain = [" ".join(f"c{i}" for i in range(10 * k, 10 * k + 200)) for k in range(6)]  # each is near the next one only
    texts += chain + ["short one", "Short  ONE", "漢字" * 50, "漢字" * 50]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n int")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(r.doc_id for r in out.collect())
    assert got == brute(rows) and len(got) < 120


def test_recall_of_bands_at_the_least_likeness():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        h = rng.integers(0, 1 << 64, 220, np.uint64)
        a, b = h[:200], h[22:]  # 178 of 220 in common: 0.81
        met += bool((shingles.bands(np.sort(a)) == shingles.bands(np.sort(b))).any())
    assert met >= 398


def test_defined_cases(spark):
    rows = [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (None, "a b c d e f", 4), (None, "solo text of null id alone", 5), (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set int")
    assert sorted((r.doc_id or -1, r.set) for r in shingles.near_dedup(docs).collect()) == [(-1, 5), (3, 2), (7, 6)]
    assert shingles.near_dedup(docs.limit(0)).count() == 0


def test_across_finds_all_alike_pairs_of_different_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 120, np.uint64)
    sets = {}
    for i in range(1, 120):  # edits take shingles away, put own or shared ones in, and change the size
        part = rng.permutation(base)[: 120 - rng.integers(0, 25)]
        own = rng.integers(0, 1 << 64, rng.integers(0, 20), np.uint64)
        sets[i] = np.unique(np.concatenate([part, own, base[:5] + np.uint64(rng.integers(0, 3))]))
    component = {i: int(rng.choice([1, 1, 1, 1, i])) for i in sets}
    want = {(i, j) for i in sets for j in sets if i < j and component[i] != component[j] and shingles.likeness(sets[i], sets[j]) >= 0.8}
    frame = spark.createDataFrame([(i, component[i], len(h), h.tobytes()) for i, h in sets.items()], "set long, component long, n int, hashes binary")
    assert len(want) > 50
    for many in (1 << 16, 16):  # few slots make the order less sharp only
        got = {(min(r), max(r)) for r in shingles.across(frame, 0.8, many).collect()}
        assert got >= want and all(component[i] != component[j] for i, j in got)
    assert shingles.across(frame.limit(0), 0.8).count() == 0
