"""Anchored ratings: both forms against plain rounds, seats that results bound on one side only."""

import math
import random

import pytest

from tidemark.operators import ladder as L

SCHEMA = "a int, b int, wins long, draws long, losses long, points double"


def results(seed=4, n=12):
    rng = random.Random(seed)
    true = [rng.gauss(0, 200) for _ in range(n)]
    rows = []
    for a in range(n):
        for b in range(a + 1, n):
            p = 1 / (1 + 10 ** ((true[b] - true[a]) / 400))
            w = sum(rng.random() < p for _ in range(30))
            d = rng.randrange(5)
            rows.append((a, b, w, d, 30 - w, w + d / 2))
    return rows


def plain(rows, rounds):
    seats = sorted({r[0] for r in rows} | {r[1] for r in rows})
    s = dict.fromkeys(seats, 1.0)
    low, top = 10.0**-3, 10.0**3
    for _ in range(rounds):
        new = {}
        for i in seats:
            games = [(r[2] + r[3] + r[4], r[5], r[1]) for r in rows if r[0] == i] + [(r[2] + r[3] + r[4], r[2] + r[3] + r[4] - r[5], r[0]) for r in rows if r[1] == i]
            points, load = sum(p for _, p, _ in games), sum(g / (s[i] + s[o]) for g, _, o in games)
            new[i] = min(max(points / load if points > 0 else low, low), top)
        mean = math.exp(sum(map(math.log, new.values())) / len(new))
        s = {i: min(max(v / mean, low), top) for i, v in new.items()}
    return {i: 400 * math.log10(v) for i, v in s.items()}


def test_ratings_settle_on_the_anchor(spark):
    rows = results(n=8)
    anchors = spark.createDataFrame([(1,), (4,), (77,)], "seat int")
    got = L.fitted_ratings(spark.createDataFrame(rows, SCHEMA), anchors, 1600.0, tolerance=1e-5).collect()
    want = plain(rows, 300)
    shift = 1600 - (want[1] + want[4]) / 2
    assert {r.seat: r.rating for r in got} == pytest.approx({i: v + shift for i, v in want.items()}, abs=0.05)
    assert all(r.settled and r.anchored and not r.separated and r.rounds < 100 for r in got)


def test_both_forms_take_the_same_rounds(spark):
    rows = results(9, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    one, other = (sorted(map(tuple, L.fitted_ratings(frame, None, tolerance=8.0, most_pairs=m).collect())) for m in (1000, 0))
    assert [r[0] for r in one] == [r[0] for r in other] and [r[1] for r in one] == pytest.approx([r[1] for r in other])
    assert [r[2:] for r in one] == [r[2:] for r in other] and not one[0][3]
    assert sum(r[1] for r in one) / len(one) == pytest.approx(1500.0)


def test_separated_seats_and_rounds_that_run_out(spark):
    rows = [*results(2, 5), (0, 50, 9, 0, 0, 9.0), (1, 51, 0, 0, 9, 0.0), (2, 52, 0, 0, 0, 0.0), (3, 3, 5, 0, 0, 5.0)]
    got = {r.seat: r for r in L.fitted_ratings(spark.createDataFrame(rows, SCHEMA), None, tolerance=1e-6, most_rounds=2000).collect()}
    assert {s for s, r in got.items() if r.separated} == {50, 51} and 52 not in got
    assert got[50].rating < min(got[i].rating for i in range(5)) and got[51].rating > max(got[i].rating for i in range(5))
    few = L.fitted_ratings(spark.createDataFrame(rows, SCHEMA), None, tolerance=1e-12, most_rounds=3).collect()
    assert not any(r.settled for r in few) and few[0].rounds == 3


def test_games_are_redrawn_by_hashes(spark):
    import hashlib

    rows = [(1, 2, 5, 2, 3, 6.0), (1, 3, 0, 4, 0, 2.0), (2, 3, 0, 0, 0, 0.0)]
    got = {(r.rep, r.a, r.b): (r.wins, r.draws, r.losses, r.points) for r in L.redrawn(spark.createDataFrame(rows, SCHEMA), 6, "s").collect()}
    want = {}
    for a, b, w, d, x, _ in rows:
        n = w + d + x
        for rep in range(1, 7) if n else ():
            u = [int(hashlib.sha256(f"s\0{a}:{b}:{rep}:{g}".encode()).hexdigest()[:16], 16) / 2**64 * n for g in range(1, n + 1)]
            wins, draws = sum(v < w for v in u), sum(w <= v < w + d for v in u)
            want[rep, a, b] = (wins, draws, n - wins - draws, wins + draws / 2)
    assert got == want


def test_games_of_one_pair_are_dealt_to_several_tasks(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, 2, 30_000, 15_000, 10_001, 37_500.0)], SCHEMA)
    games = L.dealt_games(frame, 2).groupBy("rep", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.countDistinct("game").alias("games"), F.max("game").alias("last")).collect()
    for rep in (1, 2):
        mine = [g for g in games if g.rep == rep]
        assert sum(g.n for g in mine) == sum(g.games for g in mine) == 55_001 == max(g.last for g in mine)
        assert len(mine) > 1 and max(g.n for g in mine) < 55_001
    assert {r.rep: r.wins + r.draws + r.losses for r in L.redrawn(frame, 2, "s").collect()} == {1: 55_001, 2: 55_001}
