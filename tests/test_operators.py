"""Rules that hold whatever the data: stability, nesting, equivalence and recovery."""

import hashlib
import math
import random

import pytest
from pyspark.sql import Window as W, functions as F

from tidemark.functions import hashing as H, parsing as P
from tidemark.operators import batching as B, compare as C, graph as G, ladder as L, selection as X, uncertainty as Y, windows as O
from tidemark.operators.measures import Registry, measurements
from tidemark.sources import archives as A, stores as S


def test_ids_are_those_of_the_digest(spark):
    got = spark.range(50).select("id", H.derive_id(F.lit("src"), F.col("id")).alias("u")).collect()
    for r in got:
        assert int(r.u) == int.from_bytes(hashlib.sha256(b"src\0" + str(r.id).encode()).digest()[:8], "big")


def test_splits_do_not_move_as_a_corpus_grows(spark):
    split = lambda n: {r.id: r.s for r in spark.range(n).select("id", H.split_of("s", F.col("id"), 0.2, 0.1).alias("s")).collect()}
    small, large = split(200), split(900)
    assert all(large[i] == s for i, s in small.items()) and set(large.values()) == {"train", "validation", "test"}


def test_shares_are_nested(spark):
    share = lambda f: {r.id for r in spark.range(2000).filter(H.in_share("s", F.col("id"), f)).collect()}
    assert share(0.1) < share(0.3) < share(0.9) and len(share(1.0)) == 2000 and not share(0.0)


@pytest.mark.parametrize("text,value,status", [("12", 12, "present"), (None, None, "unavailable"), ("?", None, "unavailable"), ("-1", None, "rejected"), ("x", None, "rejected"), (" 7 ", 7, "present"), ("99999999999", None, "rejected")])
def test_optional_int(spark, text, value, status):
    r = spark.createDataFrame([(text,)], "t string").select(P.optional_int(F.col("t")).alias("p")).first().p
    assert (r.value, r.status) == (value, status)


@pytest.mark.parametrize("text,ms,tick", [("0:03:00", 180000, 1000), ("1:00:00.5", 3600500, 100), ("0:00:01.25", 1250, 10), ("0:60:00", None, 1000), ("bad", None, 1000), ("0:0:1", None, 1000)])
def test_clock(spark, text, ms, tick):
    r = spark.createDataFrame([(text,)], "t string").select(P.clock_ms(F.col("t")).alias("ms"), P.clock_precision_ms(F.col("t")).alias("tick")).first()
    assert (r.ms, r.tick) == (ms, tick)


def test_first_reason_is_the_first_rule(spark):
    rows = X.screened(spark.range(6), ("even", F.col("id") % 2 == 0), ("small", F.col("id") < 4), ("null", F.lit(None).cast("boolean")))
    assert [r.reason for r in rows.orderBy("id").collect()] == ["even", "small", "even", "small", "even", None]


def test_bands_must_rise():
    with pytest.raises(ValueError):
        P.named_band(None, [("a", 5), ("b", 5)])


def test_restored_readings_with_holes(spark):
    rng = random.Random(1)
    rows = [(s, i, rng.randrange(1000) if rng.random() < 0.7 else None) for s in range(60) for i in range(1, rng.randrange(2, 25))]
    frame = spark.createDataFrame(rows, "s int, step int, clock long")
    stored = frame.select("s", "step", O.delta(F.col("clock"), W.partitionBy("s").orderBy("step")).alias("d"))
    back = {(r.s, r.step): r.clock for r in O.restored(stored, "s", "step", "d", "clock").collect()}
    assert back == {(s, i): c for s, i, c in rows}


def test_packing_equals_a_loop(spark):
    rng = random.Random(2)
    lengths = [rng.randrange(0, 30) for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "id long, n long")
    got = sorted((r.batch, r.id, r.from_step, r.to_step) for r in B.packed(frame.repartition(7), [F.col("id")], "n", 16).collect())
    want, at = [], 0
    for i, n in enumerate(lengths):
        taken = 0
        while taken < n:
            part = min(n - taken, 16 - at % 16)
            want.append((at // 16, i, taken, taken + part))
            taken, at = taken + part, at + part
    assert got == sorted(want)


def test_global_rank_whatever_the_partitions(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    rank = lambda d: {r.id: r.k for r in B.global_rank(d, [F.col("v"), F.col("id")], "k").collect()}
    assert rank(rows) == rank(rows.repartition(9, "v")) == rank(rows.coalesce(1))


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(500, n) for n in range(501, 600)]
    parent = {n: n for e in edges for n in e}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for e in edges if e[0] != e[1] for n in e}
    assert G.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fit_recovers_strengths(spark):
    true = {s: math.exp(s / 3) for s in range(5)}
    rows = [(a, b, round(1e6 * true[a] / (true[a] + true[b])), 0, round(1e6 * true[b] / (true[a] + true[b]))) for a in true for b in true if a < b]
    pairs = spark.createDataFrame([(*r, float(r[2])) for r in rows], "a int, b int, wins long, draws long, losses long, points double")
    got = {r.seat: r.strength for r in L.bradley_terry(pairs, 200).collect()}
    mean = math.exp(sum(map(math.log, true.values())) / 5)
    assert all(got[s] == pytest.approx(true[s] / mean, rel=1e-3) for s in true)


def test_poisson_weights(spark):
    u = spark.range(20000).select(Y.poisson_weight(H.hash_fraction("p", F.col("id"))).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert u[0] == pytest.approx(1, abs=0.03) and u[1] == pytest.approx(1, abs=0.06)


def test_zero_spread_has_no_bound(spark):
    rows = spark.createDataFrame([(0.0, 3), (1.0, 3), (1.0, 99)], "s double, dof int")
    got = [r.bound for r in Y.bounded(rows, "s", "dof").orderBy("s", "dof").collect()]
    assert got[0] is None and got[1] == pytest.approx(math.sqrt(3 / 0.35184632)) and got[2] is None


def test_headers_and_records(spark, tmp_path):
    text = '[Event "a"]\n[Site "x"]\n[Site "y"]\n\nbody { [%clk 0:01:00] }\n\n[Event "b"]\n\nrest\n'
    (tmp_path / "t.pgn").write_text(text)
    rows = A.framed_records(spark, f"file://{tmp_path}").select(A.headers(F.col("record"), {"Date": "?", "Event": "?"}).alias("h"), A.annotations(F.col("record"), "clk").alias("c")).collect()
    found = sorted((r.h["Event"], r.h.get("Site"), r.h["Date"], list(r.c)) for r in rows)
    assert found == [("a", "y", "?", ["0:01:00"]), ("b", None, "?", [])]


def test_conflicting_records_are_refused(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id long, d string")
    same = S.append_results(spark.createDataFrame([(2, "b"), (3, "c")], "id long, d string"), store, "id", "d").collect()
    assert [r.id for r in same] == [3]
    with pytest.raises(Exception, match="conflicting record"):
        S.append_results(spark.createDataFrame([(2, "z")], "id long, d string"), store, "id", "d").collect()


def test_gate_fails_the_job(spark):
    with pytest.raises(Exception, match="bad"):
        X.require(spark.range(3), bad=F.col("id") == 1).collect()
    with pytest.raises(Exception, match="no rows"):
        X.require(spark.range(0), bad=F.col("id") == 1).collect()


def test_identity_does_not_depend_on_order(spark):
    d = lambda f: X.identity_digest(f, "id").first().digest
    assert d(spark.range(300)) == d(spark.range(300).orderBy(F.desc("id")).repartition(5)) != d(spark.range(299))


def test_unregistered_metric_is_refused(spark):
    registry = Registry()
    registry.register("a", family="f", direction="up", version=1)
    with pytest.raises(ValueError):
        registry.register("a", family="f", direction="up", version=1)
    with pytest.raises(ValueError):
        measurements(spark.range(1), ["id"], ["b"], "id", registry)


def test_chain_lengths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (8, 9)], "a long, b long")
    got = {r.node: r.hops for r in C.chain_length(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 5: 1, 3: 2, 4: 2}


def test_chains_longer_than_32_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(35)], "a long, b long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.hops for r in C.chain_length(edges, start).collect()} == {i: i for i in range(36)}
    with pytest.raises(RuntimeError):
        C.chain_length(edges, start, 3)


def test_strengths_by_joins_equal_those_in_one_task(spark):
    rng = random.Random(3)
    rows = [(rep, a, b, rng.randrange(6), rng.randrange(3), rng.randrange(6)) for rep in (1, 2) for a in range(7) for b in range(a + 1, 7)]
    rows += [(1, 7, 8, 3, 0, 0), (2, 9, 9, 0, 0, 0)]
    pairs = spark.createDataFrame([(*r, r[3] + 0.5 * r[4]) for r in rows], "rep int, a int, b int, wins int, draws int, losses int, points double")
    for keys in (("rep",), ()):
        one, other = ({(r[0], r.seat): r.strength for r in L.bradley_terry(pairs, 7, keys, most_pairs=m).collect()} for m in (1000, 0))
        assert one.keys() == other.keys() and all(abs(one[k] / other[k] - 1) < 1e-9 for k in one)


def test_rating_at_the_ends(spark):
    fit = lambda scores: L.fitted_rating(spark.createDataFrame([(1500, s) for s in scores], "r int, s double"), "r", "s", -1000.0, 3000.0, 0.5).collect()
    assert [r.rating for r in fit([0.0, 0.0])] == [-1000.0] and [r.rating for r in fit([1.0, 1.0])] == [3000.0]
    assert abs(fit([1.0, 0.0])[0].rating - 1500) < 1e-6


def test_header_block_alone_is_read(spark, tmp_path):
    record = '[Event "a"]\n[Site "x"]\n[Event "b \\"q\\""]\n\ns1 { [Site "evil"] } s2'
    (h,) = spark.createDataFrame([(record,)], "record string").select(A.headers(F.col("record"), {"Date": "?", "Site": "?"})).first()
    assert h == {"Date": "?", "Site": "x", "Event": 'b \\"q\\"'}
    (none,) = spark.createDataFrame([("no tags",)], "record string").select(A.headers(F.col("record"), {})).first()
    assert none == {}


def test_archives_of_every_suffix(spark, tmp_path):
    import bz2
    import gzip

    import zstandard

    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.pgn.bz2").write_bytes(bz2.compress(b"three\n"))
    (tmp_path / "c.gz").write_bytes(gzip.compress("vier é\n".encode()))
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "d.pgn.zst").write_bytes(pack("five\r\nsix é".encode()) + pack(b"\nseven\n"))
    (tmp_path / "latest").write_text("eight")
    got = sorted((r.archive, r.value) for r in A.text_lines(spark, f"file://{tmp_path}").collect())
    assert got == [("a.txt", "one"), ("a.txt", "two"), ("b.pgn.bz2", "three"), ("c.gz", "vier é"), ("d.pgn.zst", "five"), ("d.pgn.zst", "seven"), ("d.pgn.zst", "six é"), ("latest", "eight")]


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    from tidemark.streaming import streams as Z

    drop, corpus, progress = (f"file://{tmp_path}/{n}" for n in ("drop", "corpus", "progress"))
    add = lambda rows: spark.createDataFrame(rows, "id int, archive int").coalesce(1).write.mode("append").parquet(drop)
    add([(i, 2017) for i in range(10)])
    add([(i, 2017 + i % 2) for i in range(10, 20)])  # the archive goes on in another file
    run = lambda prepare=lambda rows: rows: Z.incremental_archives(Z.files(spark, drop, spark.read.parquet(drop).schema), corpus, "archive", progress, prepare)
    done = []

    def fails_in_the_second(rows):
        done.append(1)
        if len(done) == 2:
            raise ValueError("lost")
        return rows

    with pytest.raises(Exception, match="lost"):
        run(fails_in_the_second)
    assert spark.read.parquet(f"{corpus}/batch=*").count() == 10
    want = sorted((i, 2017 if i < 10 else 2017 + i % 2) for i in range(20))
    for _ in range(2):  # goes on, and then has nothing to do
        assert sorted((r.id, r.archive) for r in run().collect()) == want
    add([(20, 2017)])
    assert sorted((r.id, r.archive) for r in run().collect()) == [*want, (20, 2017)]


def test_leakage_under_a_recorded_recipe(spark, tmp_path):
    from tidemark.plans.pools import check_leakage, write_recipe

    path = f"file://{tmp_path}/recipe"
    write_recipe(spark, path, seed="s", validation=0.2, test=0.1)
    same = check_leakage(spark.range(1000), "id", path, seed="s", validation=0.2, test=0.1).first()
    assert same.state == "verified" and 600 < same.leaked < 800 and same.held == 1000
    for other in ({"seed": "t"}, {"validation": 0.3}, {"test": 0.2}):
        r = check_leakage(spark.range(10), "id", path, **{"seed": "s", "validation": 0.2, "test": 0.1} | other).first()
        assert r.state == "unverified" and r.leaked is None


def test_nested_settings_become_dotted_keys(spark):
    from tidemark.functions.parsing import flattened

    rows = [('{"b": {"y": 1, "x": {"z": [1, 2]}}, "a": "t", "n": null}',), (None,), ("{}",), ("no json",)]
    got = [sorted(map(tuple, r[0])) for r in spark.createDataFrame(rows, "j string").select(flattened(F.col("j"))).collect()]
    assert got == [[("a", "t"), ("b.x.z", "[1,2]"), ("b.y", "1")], [], [], []]


def test_best_within_against_brute_force(spark):
    rng = random.Random(5)
    points = [(rng.randrange(20) * 1.0, rng.randrange(5), i) for i in range(200)]
    budgets = [-1, 0, 3, 3, 8, 30]
    out = C.best_within(spark.createDataFrame(points, "cost double, quality int, label int"), spark.createDataFrame([(b,) for b in budgets], "budget int"), "cost", "budget", "quality", "label")
    want = {b: max(((q, -c, i) for c, q, i in points if c <= b), default=(None, None, None)) for b in budgets}
    assert {r.budget: (r.quality, None if r.cost is None else -r.cost, r.label) for r in out.collect()} == want
    assert out.count() == len(want)


def test_rank_within_a_hot_group(spark):
    from tidemark.operators.batching import rank_within

    rows = [(1 if i < 90 else i % 3, (i * 37) % 100) for i in range(100)] + [(None, 5), (None, 1)]
    got = {(r.g, r.k): r.n for r in rank_within(spark.createDataFrame(rows, "g int, k int"), ["g"], [F.col("k")], "n").collect()}
    assert got == {(g, k): sorted(x for h, x in rows if h == g).index(k) + 1 for g, k in rows}


def test_planning_windows_against_a_reader(spark):
    lengths = [(i, None if i % 13 == 0 else (i * 37) % 50) for i in range(97)]
    rows = spark.createDataFrame(lengths, "id long, n int").repartition(5)
    windows = B.planning_windows(rows, [F.col("id")], 20)
    for drop_last in (False, True):
        want = set()
        for w in range(0, 97, 20):
            buckets, batches = {}, []
            for i, n in lengths[w : w + 20]:
                held = buckets.setdefault(-1 if n is None else n // 10, [])
                held.append(i)
                if len(held) == 3:
                    batches.append(held[:])
                    held.clear()
            batches += [buckets[k] for k in sorted(buckets) if buckets[k] and not drop_last]
            want |= {(i, w // 20, b, s) for b, batch in enumerate(batches) for s, i in enumerate(batch)}
        got = B.window_batches(windows, F.floor(F.col("n") / 10), 3, drop_last=drop_last)
        assert {(r.id, r.window, r.batch, r.slot) for r in got.collect()} == want
        want = set()
        for w in range(0, 97, 20):
            laid = [(i, s) for i, n in lengths[w : w + 20] for s in range(n or 0)]
            cut = [laid[at : at + 16] for at in range(0, len(laid), 16)]
            want |= {(i, w // 20, b, s) for b, batch in enumerate(cut) if len(batch) == 16 or not drop_last for i, s in batch}
        got = B.window_packed(windows, "n", 16, drop_last=drop_last).collect()
        assert {(r.id, r.window, r.batch, s) for r in got for s in range(r.from_step, r.to_step)} == want
        assert sum(r.to_step - r.from_step for r in got) == len(want)
    assert B.window_batches(B.planning_windows(rows.limit(0), [F.col("id")], 20), F.col("n"), 3).count() == 0


def test_first_and_more(spark):
    rows = spark.range(30).repartition(4)
    for n, more in ((29, True), (30, False), (31, False)):
        got = X.first_and_more(rows, "id", n).collect()
        assert [tuple(r) for r in got] == [(i, more) for i in range(min(n, 30))]
    assert X.first_and_more(rows.limit(0), "id", 3).count() == 0
