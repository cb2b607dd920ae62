import random

import numpy as np
import xxhash

from tidemark.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if bin(prints[x] ^ prints[y]).count("1") <= 4:
                a, b = sorted((top(x), top(y)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_fingerprint_edge_texts():
    for t in (None, "", " \t\n", "one", "a b c", "É É x B c d e", "w " * 40000, "Aé bC \x0b d E f g h"):
        assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t), t


def test_matches_spark_hash(spark):
    got = spark.sql("select xxhash64('one two three four') h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)


def test_forest_finds_all_pairs():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    points = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for b in base for _ in range(60)})
    group = np.sort(np.array([rng.randrange(3) for _ in points]))
    p = np.array(points, np.uint64)
    rng.shuffle(points)
    got = {(a, b) for x, y in simhash.BKForest(group, p).within(4, most=50) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(len(p)) for j in range(len(p)) if i != j and group[i] == group[j] and bin(int(p[i]) ^ int(p[j])).count("1") <= 4}
    assert got == want


def test_links_in_tiles_and_every_block_plan(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(4)]
    points = {b for b in base}
    for b in base:
        for _ in range(40):
            points.add(b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 9))}))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    want = brute_groups({i: f % (1 << 64) for i, f in enumerate(signed)})
    for size, limit in ((4096, 16384), (1, 16), (0, 8)):
        edges = simhash.links(df.select("fp"), 4, size, limit)
        found = simhash.connected_components(edges)
        root = {r.node: r.component for r in found.collect()}
        same = {}
        for i, f in enumerate(signed):
            same.setdefault(root.get(f, f), set()).add(i)
        brute = {}
        for i, c in want.items():
            brute.setdefault(c, set()).add(i)
        assert sorted(map(sorted, same.values())) == sorted(map(sorted, brute.values()))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randrange(3, 400))]
        rows.append((len(rows) * 3, " ".join(text)))
        if i % 3 == 0:
            rows.append((len(rows) * 3, " ".join(text)))
            text[len(text) // 2] = "changed"
            rows.append((len(rows) * 3, " ".join(text).upper()))
    rows += [(1, None), (2, ""), (4, " \n"), (4, " \n")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, str(tmp_path)).collect()]
    want = brute_groups({i: brute_fingerprint(t) for i, t in rows})
    assert sorted(got) == sorted((i, f"{brute_fingerprint(t):016x}", want[i]) for i, t in rows)


def test_dedup_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e", 1), (3, "a b c d e", 2), (3, "a b c d e", 2), (9, "other words entirely here now", 3), (None, "a b c d e", 4), (None, "solo text of null id alone", 5), (7, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.fp) for r in got.collect()) == [(-1, 5), (3, 2), (7, 6), (9, 3)]
    assert simhash.near_dedup(docs.limit(0)).count() == 0
