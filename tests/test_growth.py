"""Steps whose work or memory grew faster than the input, or was done several times over."""

import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.shared import parted
from tidemark.operators import batching as B, compare as C, curves as V, dimension as D, graph as G
from tidemark.operators.selection import identity_digest
from tidemark.registry import QUERIES, load
from tidemark.sources import archives as A
from tidemark.sources.corpus import rows_digest

load()


def test_dealt_values_are_found_without_ranking_all(spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.batching.rank_within", None)  # every replicate of every row was put in order
    rng = random.Random(2)
    keys = rng.sample(range(10**6), 3000)
    value = {k: float(rng.randrange(50)) for k in keys}
    near = [(float(p), rng.random(), k) for p in (1, 2) for k in rng.sample(keys, 40)]
    got = V.dealt_curve(spark.createDataFrame(near, "point double, _w double, key long"), spark.createDataFrame(list(value.items()), "key long, v double"), "key", "v", 3, "s")
    got = {(r.point, r._r): r.value for r in got.collect()}
    at = {k: i for i, k in enumerate(sorted(keys))}
    for rep in (1, 2, 3):
        dealt = sorted(keys, key=lambda k: hashlib.sha256(f"s\0{k}:{rep}".encode()).hexdigest())
        for point in (1.0, 2.0):
            rows = [(w, value[dealt[at[k]]]) for p, w, k in near if p == point]
            assert abs(got.pop((point, rep)) - sum(w * v for w, v in rows) / sum(w for w, _ in rows)) < 1e-9
    assert not got


def test_tags_are_read_once_for_a_record(spark):
    records = ['[Event "a"]\n[Site "x"]\n[Site "y \\" [Site z"]\n\n[Site "body"]', '[Event "a\n[Site "]\n[Site "b"]\n\n1.', "[Event]\n\n", '[Site ""]', ""]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")
    rows = frame.select("i", A.header(F.col("record"), "Site").alias("one"), A.headers(F.col("record"), {}).alias("all")).collect()
    assert len(rows) == len(records) and all(r.one == r.all.get("Site") for r in rows) and sum(r.one is not None for r in rows) >= 3
    plan = QUERIES["src_inline_annotations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate posexplode")
    assert "regexp_extract_all" not in above and "regexp_extract_all" in below  # they were read for every step


def test_digests_keep_their_values_with_fewer_conversions(spark):
    def plain(texts):
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        sums = [sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes) for i in range(8)]
        return hashlib.sha256("|".join(map(str, [len(hashes), *sums])).encode()).hexdigest()

    rows = [(i % 700, "x" * (i % 3)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "b long, a string").repartition(3)
    assert frame.agg(rows_digest("b", "a").alias("d")).first().d == plain(json.dumps({"a": a, "b": b}, separators=(",", ":")) for b, a in rows)
    assert tuple(identity_digest(frame, "b").first()) == (plain(map(str, range(700))), 700)
    assert identity_digest(frame.filter("false"), "b").first().digest == hashlib.sha256("|".join(["0"] * 9).encode()).hexdigest()
    for made in (frame.agg(rows_digest("b", "a")), identity_digest(frame, "b")):  # eight parts were converted one by one
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert ", 16, -10" in plan and ", 16, 10" not in plan


def test_labels_are_made_distinct_in_tasks_set_by_the_input(spark, tmp_path):
    rng = random.Random(4)
    label = [(k, rng.choice(["a", "b", None]), k % 3) for k in range(30)]
    rows = [(p, d, k, *label[k][1:]) for p in range(80) for d, k in enumerate(rng.sample(range(30), rng.randrange(1, 7)))]
    rows += [(p, 9, rows[0][2], "z", 7) for p in (1, 2)]
    spark.createDataFrame(rows, "path int, depth int, key int, name string, kind int").write.parquet(f"{tmp_path}/paths")
    paths = spark.read.parquet(f"{tmp_path}/paths")
    got = D.continuations(paths, "path", "key", "depth", ["name", "kind"])
    ends = {p: max((r for r in rows if r[0] == p), key=lambda r: r[1]) for p in range(80)}
    want = set()
    for key in {r[2] for r in rows}:
        through = [ends[p] for p in {r[0] for r in rows if r[2] == key}]
        want.add((key, max(e[1] for e in through), len({e[3] for e in through} - {None}), len({e[4] for e in through})))
    assert {tuple(r) for r in got.collect()} == want
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()  # labels met in a fixed number of tasks
    joined = paths.join(paths.withColumnRenamed("path", "other"), "key")
    size = sum(f.stat().st_size for f in (tmp_path / "paths").glob("*.parquet"))
    assert parted(joined, "key", size=size // 8).rdd.getNumPartitions() <= 20  # by what is read, not by the product


def test_orders_are_evaluated_once_for_a_row(spark, monkeypatch):
    seen, real = [], B.checkpointed
    monkeypatch.setattr(B, "checkpointed", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    rows = spark.createDataFrame([(i % 3, i) for i in range(200)] + [(1, None)], "g int, k long")
    order = [F.sha2(F.col("k").cast("string"), 256), "k"]
    drawn = lambda r: (r[1] is not None, hashlib.sha256(str(r[1]).encode()).hexdigest())
    for got, groups in ((B.rank_within(rows, ["g"], order, "n"), 3), (B.global_rank(rows, order, "n"), 1)):
        assert got.columns == ["g", "k", "n"]
        found = [tuple(r) for r in got.collect()]
        for g in range(groups):
            mine = [r for r in found if groups == 1 or r[0] == g]
            assert [r[2] for r in sorted(mine, key=drawn)] == list(range(1, len(mine) + 1))
    for plan in seen:  # the hash of a row was made anew at every comparison of the sort
        assert not any("sha2" in line for line in plan.splitlines() if "Sort " in line or "Repartition" in line)


def test_edges_are_folded_before_they_are_shuffled(spark, monkeypatch):
    rng = random.Random(15)
    for n in (1, 2, 30, 400):
        for m in (0, 1, n, 4 * n):
            pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
            least = {x: x for x in range(n)}
            for _ in range(n):
                before = dict(least)
                for x, y in pairs:
                    least[x] = least[y] = min(least[x], least[y])
                if least == before:
                    break
            node, root = G.forest(*(np.array([p[i] for p in pairs], np.int64) for i in range(2)))
            assert dict(zip(node.tolist(), root.tolist())) == {x: y for x, y in least.items() if x != y}
    pairs = [(rng.randrange(40), 100 + rng.randrange(40)) for _ in range(3000)] + [(200 + i, 201 + i) for i in range(9)] + [(7, 7), (None, 5), (300, None)]
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    assert G.forests(frame).count() <= 3 * 89  # every edge went through each round's shuffles
    nodes = frame.select(F.col("a").alias("node")).union(frame.select("b"))
    got = {r.node: r.component for r in C.classes(frame, nodes).collect()}
    assert got == {x: 0 if x < 200 else 200 if x < 300 else 300 for p in pairs for x in p if x is not None} | {None: None}


def test_chains_keep_only_what_lies_near_their_pairs(spark, monkeypatch, tmp_path):
    # two pairs, of two and of four hops (the fifth way on is the first that leads there), and 3,000 edges far from both
    near = [(1, 100), (1, 101), (2, 110), (2, 111), *[(2, 112 + i) for i in range(5)], (3, 116), (3, 120)]
    far = [(10**6 + i % 300, 2 * 10**6 + i * 7 % 2000) for i in range(3000)]
    spark.createDataFrame(near * 3 + far, "a long, b long").repartition(3).write.parquet(f"{tmp_path}/edges")
    kept, real = [], C.keep
    monkeypatch.setattr(C, "keep", lambda d, name: kept.append(real(d, name)) or kept[-1])
    got = C.shortest_chains(spark.createDataFrame([(100, 101), (110, 120)], "source long, target long"), spark.read.parquet(f"{tmp_path}/edges"))
    assert {(r.source, r.hop, r.node) for r in got.collect()} == {(s, i, n) for s, way in ((100, [100, 1, 101]), (110, [110, 2, 116, 3, 120])) for i, n in enumerate(way)}
    assert max(d.count() for d in kept) <= 64  # all edges were made distinct, turned both ways, and kept


def test_marked_rows_are_those_of_the_nodes_and_few_others(spark):
    got = {r.id for r in G.marked(spark.range(20000), "id", spark.range(0, 20000, 40).withColumnRenamed("id", "n")).collect()}
    assert set(range(0, 20000, 40)) <= got and len(got) <= 510
    assert G.marked(spark.range(9), "id", spark.range(0)).count() == 0
