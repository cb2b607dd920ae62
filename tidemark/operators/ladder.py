"""Strengths from results of pairs, and a rating from results against known ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import hashing
from tidemark.functions.scores import expected_score
from tidemark.functions.shared import checkpointed, keep
from tidemark.operators.metrics import seat_totals


def bradley_terry(pairs: DataFrame, rounds: int, keys: tuple[str, ...] = (), most_pairs: int = 200_000) -> DataFrame:
    """``(*keys, seat, strength)`` by minorization and maximization, geometric mean 1; a fixed number of rounds.

    Seats that won all or nothing have no strength and are set aside with their games. ``keys`` fit many tables, for
    instance one for each replicate, in parallel. A table has a row for each pair of seats, whatever the number of
    games. Tables of up to ``most_pairs`` pairs are fitted where their rows meet; if any has more, the rounds run as
    joins and sums over all tables, and no task holds one.
    """
    k = list(keys)
    n = F.col("wins") + F.col("draws") + F.col("losses")
    rows = keep(pairs.select(*k, "a", "b", n.cast("double").alias("g"), F.col("points").cast("double").alias("p")).filter("g > 0"), "results")  # read more than once
    largest = rows.groupBy(*k).count().agg(F.max("count")).first()[0] or 0
    return fitted_apart(rows, rounds, k) if largest <= most_pairs else fitted_by_joins(rows, rounds, k)


def fitted_apart(rows: DataFrame, rounds: int, k: list[str]) -> DataFrame:
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        seats, at = np.unique(np.concatenate([rows.a, rows.b]), return_inverse=True)
        n, a, b = len(seats), at[: len(rows)], at[len(rows) :]
        g, p = rows.g.to_numpy(), rows.p.to_numpy()
        both = lambda x, y: np.bincount(a, x, n) + np.bincount(b, y, n)
        won, played = both(p, g - p), both(g, g)
        scored = (won > 0) & (won < played)
        used = scored[a] & scored[b]
        a, b, g, p = a[used], b[used], g[used], p[used]
        points, strength = both(p, g - p)[scored], np.ones(n)
        for _ in range(rounds):
            x = g / (strength[a] + strength[b])
            strength[scored] = np.maximum(points / np.maximum(both(x, x)[scored], 1e-12), 1e-9)
            strength[scored] /= np.exp(np.log(strength[scored]).mean())
        out = pd.DataFrame({"seat": seats[scored], "strength": strength[scored]})
        return out.assign(**{c: rows[c].iloc[0] for c in k})[[*k, "seat", "strength"]] if len(out) else pd.DataFrame({c: [] for c in [*k, "seat", "strength"]})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in k], f"seat {kinds['a']}", "strength double"])
    return rows.groupBy(*k).applyInPandas(fit, schema)


def fitted_by_joins(rows: DataFrame, rounds: int, k: list[str], every: int = 5) -> DataFrame:
    """The same rounds over all tables at once; lineage is cut after ``every`` rounds. A common factor of a table's
    strengths cancels in a round, so it is taken out only then."""
    sides = rows.select(*k, F.col("a").alias("seat"), F.col("b").alias("other"), "g", "p").unionByName(rows.select(*k, F.col("b").alias("seat"), F.col("a").alias("other"), "g", (F.col("g") - F.col("p")).alias("p")))
    scored = sides.groupBy(*k, "seat").agg(F.sum("p").alias("won"), F.sum("g").alias("played")).filter("won > 0 and won < played").select(*k, "seat")
    sides = checkpointed(sides.join(scored, [*k, "seat"]).join(scored.withColumnRenamed("seat", "other"), [*k, "other"]))
    points = checkpointed(scored.join(sides.groupBy(*k, "seat").agg(F.sum("p").alias("points")), [*k, "seat"], "left").fillna(0.0, ["points"]))
    found = points.select(*k, "seat", F.lit(1.0).alias("strength"))
    for at in range(1, rounds + 1):
        met = sides.join(found, [*k, "seat"]).join(found.select(*k, F.col("seat").alias("other"), F.col("strength").alias("against")), [*k, "other"])
        load = met.groupBy(*k, "seat").agg(F.sum(F.col("g") / (F.col("strength") + F.col("against"))).alias("load"))
        found = points.join(load, [*k, "seat"], "left").select(*k, "seat", F.greatest(F.col("points") / F.greatest(F.coalesce("load", F.lit(0.0)), F.lit(1e-12)), F.lit(1e-9)).alias("strength"))
        if at % every == 0 or at == rounds:
            found = checkpointed(found)
            mean = found.groupBy(*k).agg(F.exp(F.avg(F.log("strength"))).alias("_m"))
            found = (found.join(mean, k) if k else found.crossJoin(F.broadcast(mean))).select(*k, "seat", (F.col("strength") / F.col("_m")).alias("strength"))
    return found


#: Points of rating for a factor of ten in strength.
SCALE = 400.0
EVERY = 5


def ratings_by_joins(rows: DataFrame, most_rounds: int, tolerance: float, spread: float) -> tuple[DataFrame, int, bool]:
    """``(seat, strength)``, the rounds it took and whether they settled; all rounds are joins and sums.

    A round reads the last one twice, so each is cut off by a checkpoint; after every ``EVERY`` rounds the greatest
    shift of a rating in the last round is read, one number.
    """
    top, low = 10.0 ** (spread / SCALE), 10.0 ** (-spread / SCALE)
    bound = lambda c: F.greatest(F.least(c, F.lit(top)), F.lit(low))
    sides = rows.select(F.col("a").alias("seat"), F.col("b").alias("other"), "g", "p").unionByName(rows.select(F.col("b").alias("seat"), F.col("a").alias("other"), "g", (F.col("g") - F.col("p")).alias("p")))
    sides = checkpointed(sides.groupBy("seat", "other").agg(F.sum("g").alias("g"), F.sum("p").alias("p")))
    points = checkpointed(sides.groupBy("seat").agg(F.sum("p").alias("points")))
    found = points.select("seat", F.lit(1.0).alias("strength"))
    for at in range(1, most_rounds + 1):
        before = found
        met = sides.join(found, "seat").join(found.select(F.col("seat").alias("other"), F.col("strength").alias("against")), "other")
        load = met.groupBy("seat").agg(F.sum(F.col("g") / (F.col("strength") + F.col("against"))).alias("load"))
        fresh = checkpointed(points.join(load, "seat").select("seat", bound(F.when((F.col("points") > 0) & (F.col("load") > 0), F.col("points") / F.col("load")).otherwise(F.lit(low))).alias("strength")))
        mean = fresh.agg(F.exp(F.avg(F.log("strength"))).alias("_m"))
        found = fresh.crossJoin(F.broadcast(mean)).select("seat", bound(F.col("strength") / F.col("_m")).alias("strength"))
        if at % EVERY == 0 or at == most_rounds:
            both = checkpointed(found.join(before.select("seat", F.col("strength").alias("_b")), "seat").withColumn("_shift", F.abs(F.log10("strength") - F.log10("_b")) * SCALE))
            found = both.select("seat", "strength")
            if (both.agg(F.max("_shift")).first()[0] or 0.0) < tolerance:
                return found, at, True
    return found, most_rounds, False


def ratings_apart(rows: DataFrame, most_rounds: int, tolerance: float, spread: float) -> tuple[DataFrame, int, bool]:
    """The same rounds where all pairs of seats meet in one task."""
    top, low = 10.0 ** (spread / SCALE), 10.0 ** (-spread / SCALE)
    kind = dict(rows.dtypes)["a"]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        seats, at = np.unique(np.concatenate([rows.a, rows.b]), return_inverse=True)
        n, a, b = len(seats), at[: len(rows)], at[len(rows) :]
        g, p = rows.g.to_numpy(), rows.p.to_numpy()
        both = lambda x, y: np.bincount(a, x, n) + np.bincount(b, y, n)
        points, strength, done, settled = both(p, g - p), np.ones(n), 0, False
        for done in range(1, most_rounds + 1):
            x = g / (strength[a] + strength[b])
            fresh = np.clip(np.where(points > 0, points / both(x, x), low), low, top)
            fresh = np.clip(fresh / np.exp(np.log(fresh).mean()), low, top)
            shift, strength = np.abs(np.log10(fresh) - np.log10(strength)).max() * SCALE, fresh
            if (done % EVERY == 0 or done == most_rounds) and shift < tolerance:
                settled = True
                break
        return pd.DataFrame({"seat": seats, "strength": strength, "rounds": done, "settled": settled})

    found = checkpointed(rows.groupBy(F.lit(1).alias("_one")).applyInPandas(fit, f"seat {kind}, strength double, rounds int, settled boolean"))
    first = found.first()
    return found.select("seat", "strength"), first.rounds if first else 0, bool(first and first.settled)


def fitted_ratings(pairs: DataFrame, anchors: DataFrame | None = None, anchor_rating: float = 1500.0, *, tolerance: float = 1e-6, most_rounds: int = 500, spread: float = 1200.0, most_pairs: int = 200_000) -> DataFrame:
    """``(seat, rating, separated, anchored, rounds, settled)`` from results of pairs, on the scale of expected scores.

    Rounds go on until no rating moves by ``tolerance``; ``settled`` says whether they did within ``most_rounds``.
    Strengths stay within ``spread`` points of the mean either way. A seat that won or lost all, or that runs into that
    limit, is bounded by its results on one side only: it is ``separated``, kept with its results, and its number is a
    limit and no estimate. Ratings are shifted so that the ``anchors(seat)`` among them have
    ``anchor_rating`` on average, or all that are not separated where no anchor played (``anchored`` false). A table has
    a row for each pair of seats, however many games; over ``most_pairs`` of them the rounds are joins.
    """
    n = F.col("wins") + F.col("draws") + F.col("losses")
    rows = pairs.select("a", "b", n.cast("double").alias("g"), F.col("points").cast("double").alias("p")).filter("g > 0 and a <> b")
    form = ratings_apart if rows.limit(most_pairs + 1).count() <= most_pairs else ratings_by_joins
    found, rounds, settled = form(rows, most_rounds, tolerance, spread)
    own = [rows.select(F.col(s).alias("_seat"), "g", F.when(F.lit(s == "a"), F.col("p")).otherwise(F.col("g") - F.col("p")).alias("p")) for s in "ab"]
    totals = own[0].unionByName(own[1]).groupBy("_seat").agg(F.sum("p").alias("_p"), F.sum("g").alias("_g"))
    edge = (F.abs(F.abs(F.log10("strength") * SCALE) - spread) <= 1e-6) | (F.col("_p") <= 0) | (F.col("_p") >= F.col("_g"))
    out = checkpointed(found.join(totals, F.col("seat") == F.col("_seat")).select("seat", (F.log10("strength") * SCALE).alias("_r"), edge.alias("separated")))
    basis = out.join(anchors.select("seat").distinct(), "seat", "left_semi") if anchors is not None else out.limit(0)
    level = basis.agg(F.avg("_r").alias("_a")).crossJoin(out.agg(F.coalesce(F.avg(F.when(~F.col("separated"), F.col("_r"))), F.avg("_r")).alias("_all")))
    shifted = F.col("_r") - F.coalesce("_a", "_all") + F.lit(anchor_rating)
    return out.crossJoin(F.broadcast(level)).select("seat", shifted.alias("rating"), "separated", F.col("_a").isNotNull().alias("anchored"), F.lit(rounds).alias("rounds"), F.lit(settled).alias("settled"))


GAMES_DRAWN = 10_000  # drawn by one row


def dealt_games(pairs: DataFrame, replicates: int) -> DataFrame:
    """A row for each game of each pair and replicate.

    Pairs may be few and their games very many, so games are dealt to all tasks in runs of ``GAMES_DRAWN``; a number of
    partitions is named, as so few rows would be put into one task otherwise.
    """
    spark = pairs.sparkSession
    n = F.col("wins") + F.col("draws") + F.col("losses")
    runs = pairs.withColumn("n", n).filter("n > 0").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GAMES_DRAWN))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    first = F.col("run") * GAMES_DRAWN + 1
    return runs.repartition(tasks, "a", "b", "rep", "run").withColumn("game", F.explode(F.sequence(first, F.least(first + (GAMES_DRAWN - 1), F.col("n")))))


def redrawn(pairs: DataFrame, replicates: int, seed: str) -> DataFrame:
    """Each pair's games drawn anew from its own shares of wins, draws and losses, by a hash for each game."""
    rows = dealt_games(pairs, replicates)
    u = hashing.hash_fraction(seed, F.concat_ws(":", "a", "b", "rep", "game")) * F.col("n")
    drawn = rows.withColumn("s", F.when(u < F.col("wins"), 1.0).when(u < F.col("wins") + F.col("draws"), 0.5).otherwise(0.0))
    return drawn.groupBy("rep", "a", "b").agg(F.count_if(F.col("s") == 1).alias("wins"), F.count_if(F.col("s") == 0.5).alias("draws"), F.count_if(F.col("s") == 0).alias("losses"), F.sum("s").alias("points"))


def fitted_rating(results: DataFrame, rating: str, score: str, low: float, high: float, step: float) -> DataFrame:
    """The rating whose expected scores sum to the observed ones: a grid over rating counts, then a line between points.

    Where all or none of the results are won no rating fits, and the end of the grid is given."""
    counts = results.groupBy(F.col(rating).alias("_r")).agg(F.count("*").alias("_n"), F.sum(score).alias("_s"))
    points = results.sparkSession.range(int((high - low) / step) + 1).select((F.lit(low) + F.col("id") * step).alias("own"))
    sums = counts.join(F.broadcast(points)).groupBy("own").agg((F.sum(F.col("_n") * expected_score(F.col("own"), F.col("_r"))) - F.sum("_s")).alias("over"))
    # expected scores rise with the own rating, so the last point below and the first above are neighbours
    ends = sums.agg(F.max(F.when(F.col("over") < 0, F.struct("own", "over"))).alias("a"), F.min(F.when(F.col("over") >= 0, F.struct("own", "over"))).alias("b"), F.count("*").alias("n")).filter("n > 0")
    line = F.col("a.own") + step * -F.col("a.over") / (F.col("b.over") - F.col("a.over"))
    return ends.select(F.when(F.col("a").isNull(), F.lit(low)).when(F.col("b").isNull(), F.lit(high)).otherwise(line).alias("rating"))


__all__ = ["bradley_terry", "fitted_rating", "fitted_ratings", "redrawn", "seat_totals"]
