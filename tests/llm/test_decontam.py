import itertools
import random
import re

import numpy as np

from tidemark.llm import decontam


def words(text):
    return re.findall(r"\w+", (text or "").lower().replace("_", " "))


def brute(docs, items, window=13, least=1):
    """Every alignment of every document and item, without seeds."""
    out = set()
    for d, t in docs:
        for i, u in items:
            a, b = words(t), words(u)
            size = min(window, len(b))
            if len(b) >= least and any(
                sum(x == y for x, y in zip(a[s : s + size], b[k : k + size])) >= 0.8 * size
                for s in range(len(a) - size + 1) for k in range(len(b) - size + 1)
            ):
                out.add((d, i))
    return out


def make():
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in "the of and wor ré niß".split() for b in "a en ist tion ly".split()]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(9, 40)))) for i in range(12)] + [(50, "too short an item"), (51, None), (52, ""), (3, " ".join(text(20)))]
    docs = []
    for i in range(60):
        body = text(rng.randrange(0, 120))
        if i % 3 == 0:
            leak = words(items[i % 12][1])
            for k in range(0, len(leak), 9):
                if i % 2:
                    leak[k] = "other"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() + "," for w in leak]
        docs.append((i, " ".join(body)))
    return docs + [(70, None), (71, ""), (72, "..."), (0, docs[0][1]), (None, docs[3][1]), (80, items[0][1])], items


def test_word_hashes_follow_words():
    texts = ["The, the THE", "Été été", "a1 1a", "", "x" * 5000 + " the"]
    got = list(decontam.word_hashes(texts))
    assert len(set(got[0].tolist())) == 1 and len(set(got[1].tolist())) == 1 and got[2][0] != got[2][1] and len(got[3]) == 0 and got[4][1] == got[0][0]


def test_seeds_ignore_masked_words():
    a = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x123456789)
    b = a.copy()
    b[4] = 5
    x, y = decontam.seed_hashes(a), decontam.seed_hashes(b)
    assert x[0][0] == y[0][0] and x[1][0] != y[1][0] and x[2][0] == y[2][0]


def test_masks_hit_every_choice_of_substituted_words():
    for n in range(1, 14):
        masks = decontam.MASKS if n >= decontam.SHORT else decontam.short_masks(n, 0.8)
        assert n < decontam.SHORT or all("0" in m for m in masks)
        for k in range(int(0.2 * n + 1e-9) + 1):
            for bad in itertools.combinations(range(n), k):
                assert any(all(m[j] == "0" or s + j not in bad for j in range(len(m))) for m in masks for s in range(n - len(m) + 1)), (n, bad)


def test_recall_with_substituted_words(spark):
    """Items of 1 to 30 words with as many substitutions as 0.8 allows, anywhere: all alignments are found."""
    rng = random.Random(12)
    items = [(n, " ".join(f"w{n}q{j}" for j in range(n))) for n in range(1, 31)]
    docs, i = [], 0
    for n, text in items:
        for _ in range(6):
            leak = text.split()
            for at in rng.sample(range(n), int(0.2 * min(n, 13))):
                leak[at] = "other"
            docs.append((i, " ".join(["pad"] * rng.randrange(4) + leak + ["end"] * rng.randrange(4))))
            i += 1
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_met=3)
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) >= len(docs) - 10


def test_against_all_alignments(spark, tmp_path):
    docs, items = make()
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tie int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontam.op7_decontam(spark, str(tmp_path)).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(want) > 15
    for r in got:
        assert r.n_same >= 0.8 * r.n_words


def test_stage_drops_overlaps_only(spark):
    docs, items = make()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tie int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.decontaminate(frame, bench)
    bad = {d for d, _ in brute(docs, items)}
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert decontam.decontaminate(frame, bench.limit(0)).count() == len(docs)
    assert decontam.overlaps(frame.limit(0), bench).count() == 0
