"""Order statistics, curves, masses and chains against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare as C, curves as V, dimension as D, quantiles as Q
from tidemark.operators.measures import played


def test_nth_values_of_hot_and_odd_groups(spark):
    rng = random.Random(3)
    groups = {"hot": [rng.gauss(0, 1e6) for _ in range(9000)], "ties": [5.0] * 700 + [6.0] * 3, None: [1e-300, 1e300, -1e308, 1.7e308, 0.0, 3.0], "odd": [math.nan, math.inf, -math.inf, 1.0, math.inf], "one": [2.5],
              "powers": [2.0**-i for i in range(60)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    wanted = [(k, n) for k, vs in groups.items() for n in {0, len(vs) // 2, len(vs) - 1, len(vs)}] + [("none", 0)]
    got = {(r.k, r.n): r.nth for r in Q.nth_values(frame, spark.createDataFrame(wanted, "k string, n int"), ["k"], "v", "n").collect()}
    key = lambda x: (math.isnan(x), x)
    want = {(k, n): sorted(groups[k], key=key)[n] for k, n in wanted if k in groups and n < len(groups[k])}
    assert got.keys() == want.keys()
    assert all(got[k] == v or (math.isnan(v) and math.isnan(got[k])) for k, v in want.items())


def test_percentiles_are_those_of_spark(spark):
    rng = random.Random(5)
    frame = spark.createDataFrame([(i % 3, rng.choice([rng.random(), 0.5, None])) for i in range(3000)], "k int, v double")
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r.k: (r.p10, r.p50, r.p99) for r in Q.percentiles(frame, ["k"], "v", shares).collect()}
    want = {r.k: tuple(r.p) for r in frame.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares.values()))).alias("p")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    whole = Q.percentiles(frame, [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(frame.agg(F.percentile("v", F.lit(0.5))).first()[0])


def test_neighbours_for_any_k(spark):
    rng = random.Random(7)
    xs = [rng.randrange(4000) / 4 for _ in range(12_000)]
    frame, grid = spark.createDataFrame([(x,) for x in xs], "x double"), spark.createDataFrame([(0.0,), (500.25,)], "point double")
    for k in (1, 5000, 12_000):
        got = {r.point: r.n for r in C.within_radius(frame, grid, "x", k).groupBy("point").agg(F.count("*").alias("n")).collect()}
        for p, n in got.items():
            reach = sorted(abs(x - p) for x in xs)[k - 1]
            assert n == sum(abs(x - p) <= reach + 1e-9 for x in xs)
        assert len(got) == 2
    assert C.within_radius(frame, grid, "x", 12_001).count() == 0
    plan = C.within_radius(frame, grid, "x", 5000)._jdf.queryExecution().toString()
    assert "Window" not in plan


# masses


def walk(moves, start, plies, threshold, committed):
    """State by state over lists."""
    out, now = {}, dict(start)
    add = lambda kind, s, m: out.__setitem__((kind, s), out.get((kind, s), 0.0) + m)
    for _ in range(plies):
        new = {}
        for s, m in now.items():
            if m < threshold:
                add("pruned" if s in committed else "unsettled", s, m)
                continue
            left = 1.0
            for t, p in moves.get(s, {}).items():
                new[t] = new.get(t, 0.0) + m * p
                left -= p
            if m * left > 1e-15:
                add("terminal", s, m * left)
        now = new
    for s, m in now.items():
        add("settled", s, m)
    return out


def ledger_of(frame):
    rows = [r for r in frame.collect() if r.mass > 1e-15]
    assert len({(r.kind, r.state) for r in rows}) == len(rows)
    return {(r.kind, r.state): r.mass for r in rows}


def as_table(spark, moves):
    return spark.createDataFrame([(s, t, p) for s, d in moves.items() for t, p in d.items()], "state string, next string, p double")


def test_mass_of_states_that_end_is_kept(spark):
    moves = {"a": {"b": 0.5, "c": 0.5}, "b": {"a": 1.0}}
    got = ledger_of(D.path_mass(as_table(spark, moves), spark.createDataFrame([("a", 1.0)], "state string, mass double"), 3, 0.0001))
    assert got == pytest.approx({("terminal", "c"): 0.5, ("settled", "b"): 0.25, ("settled", "c"): 0.25})
    assert got == pytest.approx(walk(moves, {"a": 1.0}, 3, 0.0001, set()))


@pytest.mark.parametrize("threshold", [0.05, 1.0])
def test_masses_sum_to_one_at_any_threshold(spark, threshold):
    rng = random.Random(11)
    names = [f"s{i}" for i in range(9)]
    moves = {}
    for s in names[:7]:
        parts = [rng.random() for _ in range(4)]
        total = sum(parts) / rng.choice([1.0, 0.8])
        d = {}
        for t, p in zip(rng.sample(names, 4), parts):
            d[t] = p / total
        moves[s] = d
    start = {"s0": 0.6, "s1": 0.4}
    committed = spark.createDataFrame([("s2",), ("s3",)], "state string")
    frame = D.path_mass(as_table(spark, moves), spark.createDataFrame(list(start.items()), "state string, mass double"), 4, threshold, committed)
    got = ledger_of(frame)
    assert sum(got.values()) == pytest.approx(1.0)
    assert got == pytest.approx(walk(moves, start, 4, threshold, {"s2", "s3"}))


def test_too_much_mass_fails(spark):
    from pyspark.errors import PySparkException

    start = spark.createDataFrame([("a", 1.0)], "state string, mass double")
    with pytest.raises(PySparkException, match="more than 1"):
        D.path_mass(as_table(spark, {"a": {"b": 0.7, "c": 0.4}}), start, 2, 0.1).collect()
    with pytest.raises(ValueError):
        D.path_mass(as_table(spark, {"a": {"b": 1.0}}), start, 0, 0.1)


def test_policies_of_batches(spark):
    from pyspark.errors import PySparkException

    start = spark.createDataFrame([(i, 1 / 50) for i in range(50)], "state long, mass double")

    def calm(states):
        assert len(states) <= 7
        return [{s + 1: 0.5, s * 2: 0.25} for s in states]

    got = ledger_of(D.mass_ledger(start, played(calm, rows=7), 3, 0.0005))
    moves = {s: {s + 1: 0.5, s * 2: 0.25} if s + 1 != s * 2 else {s + 1: 0.25} for s in range(1000)}
    assert got == pytest.approx(walk(moves, {i: 1 / 50 for i in range(50)}, 3, 0.0005, set()))
    for bad in (lambda states: [{0: 1.2} for _ in states], lambda states: [{0: -0.1} for _ in states], lambda states: [{0: math.nan} for _ in states], lambda states: [{0: 1.0}]):
        with pytest.raises(PySparkException, match="distribution"):
            D.mass_ledger(start, played(bad), 1, 0.0005).collect()


# chains


def brute_chain(edges, source, target):
    around = {}
    for a, b in edges:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    level, seen = [[source]], {source}
    while level:
        ends = [p for p in level if p[-1] == target]
        if ends:
            return min(ends)
        new, fresh = [], set()
        for p in level:
            for n in around.get(p[-1], ()):
                if n not in seen:
                    new.append([*p, n])
                    fresh.add(n)
        seen |= fresh
        level = new
    return None


@pytest.mark.parametrize("seed", [1])
def test_shortest_chains(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(75)] + [(i, i + 1) for i in range(100, 112)] + [(5, 5), (200, 200)]
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)] + [(100, 112), (112, 100), (100, 3), (7, 7), (900, 901), (900, 900)]
    frame = spark.createDataFrame(edges + edges[:9], "a long, b long")
    got = {}
    for r in C.shortest_chains(spark.createDataFrame(pairs, "source long, target long"), frame).collect():
        got.setdefault((r.source, r.target), {})[r.hop] = r.node
    want = {(s, t): brute_chain(edges, s, t) for s, t in pairs}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("peeked", [1, 64])
def test_chains_are_found_without_the_widest_levels(spark, monkeypatch, peeked):
    # ends with 3 neighbours each, those with 150 more: chains of four hops, of three, and (past 64 ways) of more
    edges = [(0, i) for i in (1, 2, 3)] + [(9, i) for i in (4, 5, 6)] + [(i, 100 + m) for i in (1, 2, 3) for m in range(150)] + [(i, 100 + m) for i in (5, 6) for m in range(40, 100)]
    edges += [(20, 21), (21, 22), (22, 23)] + [(30, 31), (31, 300)] + [(31, 301 + m) for m in range(80)] + [(380, 32), (32, 33)]
    kept, real = [], C.keep
    monkeypatch.setattr(C, "PEEKED", peeked)
    monkeypatch.setattr(C, "keep", lambda d, name: kept.append((name, real(d, name))) or kept[-1][1])
    pairs = [(0, 9), (20, 23), (30, 33)]
    got = {}
    for r in C.shortest_chains(spark.createDataFrame(pairs[:2] if peeked == 64 else pairs, "source long, target long"), spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault((r.source, r.target), {})[r.hop] = r.node
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {(s, t): brute_chain(edges, s, t) for s, t in pairs if (s, t) in got} and len(got) == (2 if peeked == 64 else 3)
    if peeked == 64:
        assert max(d.count() for name, d in kept if name == "front") <= 4  # the levels of 150 nodes are not made


# curves


def draw(seed, key):
    return int(hashlib.sha256(f"{seed}\0{key}".encode()).hexdigest()[:16], 16) / 2**64


def poisson(u):
    total = term = math.exp(-1)
    for k in range(8):
        if u < total:
            return k
        term /= k + 1
        total += term
    return 8


def plain_levels(left, right, grid, k, replicates, seed, coverage):
    """The readings with numpy; observations are (key, stream, x, value)."""
    reach = [sorted(abs(o[2] - p) for o in left)[min(k, len(left)) - 1] for p in grid]

    def weights(side):
        out = []
        for p, r in zip(grid, reach):
            d = np.array([abs(o[2] - p) for o in side])
            inside = d <= r + 1e-9
            w = (1 - np.minimum(1.0, d / r) ** 3) ** 3 if r > 0 else np.ones(len(side))
            out.append((inside, w * inside))
        return out

    def curve(side, ws, counts, values=None):
        v = np.array([o[3] for o in side]) if values is None else values
        out = []
        for inside, w in ws:
            t = (counts * w).sum()
            n = (counts * inside).sum()
            out.append((counts * w * v).sum() / t if t > 0 else (counts * inside * v).sum() / n if n > 0 else np.nan)
        return np.array(out)

    wl, wr = weights(left), weights(right)
    ones = lambda s: np.ones(len(s))
    a, b = curve(left, wl, ones(left)), curve(right, wr, ones(right))
    counts = lambda s, name, r: np.array([poisson(draw(f"{seed}:{name}", f"{o[1]}:{r}")) for o in s])
    scale = [math.sqrt(n / (n - 1)) for n in (len({o[1] for o in s}) for s in (left, right))]
    rep = range(1, replicates + 1)
    la = np.array([curve(left, wl, counts(left, "left", r)) for r in rep])
    rb = np.array([curve(right, wr, counts(right, "right", r)) for r in rep])
    el, er = (la - a) * scale[0], (rb - b) * scale[1]
    order = sorted(range(len(right)), key=lambda i: right[i][0])
    flat = []
    for r in rep:
        dealt = sorted(range(len(right)), key=lambda i: (hashlib.sha256(f"{seed}:deal\0{right[i][0]}:{r}".encode()).hexdigest(), right[i][0]))
        values = np.empty(len(right))
        for place, source in zip(order, dealt):
            values[place] = right[source][3]
        flat.append(curve(right, wr, ones(right), values))
    flat = np.array(flat)
    above = lambda x: x.mean() + coverage * x.std(ddof=1)
    moved = np.abs(flat - flat.mean(1, keepdims=True))
    out = {("point", p): (abs(a[i] - b[i]), np.abs(a[i] - rb[:, i]).std(ddof=1) * scale[1], above(np.abs(el[:, i] - er[:, i])), above(moved[:, i])) for i, p in enumerate(grid)}
    var = lambda x: np.abs(x - x.mean(-1, keepdims=True)).mean(-1)
    out["conditional", None] = np.abs(a - b).mean(), np.abs(a - rb).mean(1).std(ddof=1) * scale[1], above(np.abs(el - er).mean(1)), None
    out["pooled", None] = abs(a.mean() - b.mean()), np.abs(a.mean() - rb.mean(1)).std(ddof=1) * scale[1], above(np.abs(el.mean(1) - er.mean(1))), None
    out["variation", None] = var(b), var(rb).std(ddof=1) * scale[1], None, above(var(flat))
    return out


GRID = [100.0, 300.0, 500.0, 700.0]


def sides(shape):
    rng = random.Random(8)
    left = [(i, f"h{i // 2}", rng.uniform(0, 800), 0.0) for i in range(160)]
    left = [(i, s, x, x / 100 + rng.gauss(0, 0.5)) for i, s, x, _ in left]
    right = [(1000 + i, f"m{i // 3}", rng.uniform(0, 800), 0.0) for i in range(150)]
    right = [(i, s, x, {"same": x / 100, "flat": 4.0, "mirrored": 8 - x / 100}[shape] + rng.gauss(0, 0.5)) for i, s, x, _ in right]
    return left, right


def levels(spark, left, right):
    frames = [spark.createDataFrame(s, "id long, stream string, x double, v double") for s in (left, right)]
    grid = spark.createDataFrame([(p,) for p in GRID], "point double")
    rows = V.curve_levels(*frames, grid, "x", "v", "stream", "id", 40, 12, "t").collect()
    return {(r.kind, r.point): (r.value, r.dispersion, r.level, r.flat) for r in rows}


@pytest.mark.parametrize("shape", ["same", "flat", "mirrored"])
def test_curve_levels(spark, shape):
    left, right = sides(shape)
    got, want = levels(spark, left, right), plain_levels(left, right, GRID, 40, 12, "t", 2.0)
    assert got.keys() == want.keys()
    for k in want:
        assert [x is None for x in got[k]] == [x is None for x in want[k]]
        assert [x for x in got[k] if x is not None] == pytest.approx([x for x in want[k] if x is not None], rel=1e-7, abs=1e-9)
    distance, moves = got["conditional", None], got["variation", None]
    # a flat model has found the mean and ignores the axis; a mirrored one moves as much as the reference, and apart from it
    assert (distance[0] > distance[2], moves[0] > moves[3]) == {"same": (False, True), "flat": (True, False), "mirrored": (True, True)}[shape]




# depths and seams


def test_half_divergence(spark):
    from pyspark.sql import functions as F

    half = lambda rows, floor=None: V.half_divergence(spark.createDataFrame(rows, "depth int, excess double, floor double"), floor).first().half
    rows = [(1, 0.1, 0.0), (2, 0.2, 0.0), (3, 0.6, 0.0), (4, 0.8, 0.0)]
    assert half(rows) == pytest.approx(2.5)
    assert half([(1, 0.5, 0.0), (2, 0.1, 0.0), (3, 0.6, 0.0)]) == 1.0  # the first crossing counts
    assert half([(1, 0.1, 0.0)]) is None and half([(1, 0.1, 0.0), (2, -0.2, 0.0)]) is None
    assert half([(d, e, 0.9) for d, e, _ in rows], F.col("floor")) is None


def test_settled_depth_and_divergence(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("b", 1, None), ("b", 2, "x"), ("b", 3, "z"), ("b", 4, "z"), ("c", 1, "x")], "s string, step int, label string")
    assert V.settled_depth(rows, "s", "step", "label").first().settled == 3
    assert V.settled_depth(rows.filter("s = 'c'"), "s", "step", "label").first().settled == 1
    got = {r.depth: r.distance for r in V.divergence_by_depth(rows.filter("step <= 3"), F.col("s") == "a", "step", "label").collect()}
    assert got == pytest.approx({1: 0.5, 2: 1.0, 3: 1.0})


def test_seams_of_one_long_series(spark):
    from tidemark.operators import windows as O

    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", None, "b"]), rng.randrange(50), rng.choice([1, 1, 2, None])) for i in range(600)]
    frame = spark.createDataFrame(rows, "id int, series string, at int, v int").repartition(5)
    got = {r.id: (r.starts, r.moved) for r in O.seams(frame, ["series"], ["at", "id"], "id", moved=F.col("v")).collect()}
    last, want = {}, {}
    for i, s, at, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = (s not in last, s in last and None not in (v, last[s]) and v != last[s])
        last[s] = v
    assert got == want
