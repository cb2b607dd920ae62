import hashlib
import random
import re

import pytest
import xxhash

from tidemark.llm import winnow


def murmur_of_long(value, seed=42):
    """Murmur3, 32 bits, over the two halves of a long."""
    h = seed
    for k in (value & 0xFFFFFFFF, value >> 32 & 0xFFFFFFFF):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h = ((h ^ k) << 13 | (h ^ k) >> 19) & 0xFFFFFFFF
        h = h * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= 8
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * by & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def brute(text):
    """(hash, position) of each choice."""
    units = re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)
    h = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    grams = []
    for i in range(max(1, len(h) - 4) if h else 0):
        r = 0
        for k in range(5):
            r = (r << 7 ^ (h[i + k] if i + k < len(h) else 0)) & (1 << 64) - 1
        grams.append(murmur_of_long(r))
    out = []
    for i in range(max(1, len(grams) - 7) if grams else 0):
        w = list(enumerate(grams[i : i + 8], i))
        best = min(w, key=lambda x: (x[1], -x[0]))
        if (best[1], best[0]) not in out:
            out.append((best[1], best[0]))
    return out


def share(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def rows(n=70):
    rng = random.Random(2)
    out = []
    for i in range(n):
        t = " ".join(rng.choice(["the", "of", "à", "ion😀", "x" * 40, "b", "c", "\n"]) for _ in range(rng.randrange(0, 60)))
        out.append((i * 17 % 501 - 90, t))
    return out + [(1000, None), (1001, ""), (1002, "a b c d e f"), (1002, "a b c d e f"), (1003, "same same " * 300), (1003, "z"), (None, "null id"), (None, None), (1004, "日本語" * 50)]


@pytest.mark.parametrize("buckets", [None, 2, 1])
def test_against_plain_python(spark, tmp_path, buckets):
    table = rows()
    spark.createDataFrame([(*r, 0) for r in table], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    if buckets is None:
        got = winnow.op5_winnowing(spark, str(tmp_path)).collect()
    else:
        found = winnow.fingerprints(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text"), buckets=buckets)
        got = winnow.digested(found).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in table))
    want = []
    for k, (some, i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = brute(t), brute(edited), brute(following)
        hexes = lambda s: " ".join(f"{h & 0xFFFFFFFF:08x}" for h, _ in s)
        want.append((i if some else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexes(a), hexes(b), round(share(a, b), 9), round(share(a, c), 9)))
    key = lambda r: tuple(map(str, r))
    assert sorted([(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=key) == sorted(want, key=key)


def test_positions_and_guarantee(spark):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(12)]  # gram + window - 1 units
    texts = [" ".join([f"x{rng.random()}" for _ in range(rng.randrange(20))] + common + [f"y{rng.random()}" for _ in range(9)]) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", winnow.selections(winnow.F.col("text")).alias("s"))
    got = df.select("text", winnow.F.transform("s", winnow.hash_of).alias("h"), winnow.F.transform("s", winnow.position_of).alias("p")).collect()
    for r in got:
        assert list(zip(r.h, r.p)) == brute(r.text)
    assert set.intersection(*(set(r.h) for r in got))


def test_no_python_in_the_plan(spark, tmp_path):
    docs = spark.createDataFrame(rows(5), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = winnow.op5_winnowing(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert winnow.fingerprints(docs.limit(0)).count() == 0
