"""Slices, rates, histograms and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def long_counts(rows: DataFrame, **labels: Column) -> DataFrame:
    """``(dimension, value, n)`` for every label column, by one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in labels.items()])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def slice_table(rows: DataFrame, single: Sequence[str], many: str | None, *aggregates: Column, partial: Sequence[Column] = ()) -> DataFrame:
    """Aggregates over all rows and over each value of each dimension; ``many`` is an array column of cases a row is in.

    Each row becomes one (dimension, value) pair for each dimension, and pairs are combined before the shuffle.
    """
    pairs = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))]
    pairs += [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in single]
    slices = F.array(*pairs)
    if many:
        slices = F.concat(slices, F.transform(many, lambda v: F.struct(F.lit(many).alias("dimension"), v.cast("string").alias("value"))))
    return rows.withColumn("_s", F.explode(slices)).filter("_s.value is not null").groupBy(F.col("_s.dimension").alias("dimension"), F.col("_s.value").alias("value")).agg(*aggregates)


def rate_support(rows: DataFrame, cluster: str, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Two success rates over clustered opportunities, their gap, and the effective number of clusters."""
    per = rows.groupBy(*keys, cluster).agg(F.count("*").alias("c"), F.count_if(first).alias("x"), F.count_if(second).alias("y"))
    out = per.groupBy(*keys).agg(F.sum("c").alias("opportunities"), F.count("*").alias("clusters"), F.sum("x").alias("x"), F.sum("y").alias("y"), (F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("effective"))
    n = F.col("opportunities")
    return out.withColumns({"first_rate": F.col("x") / n, "second_rate": F.col("y") / n, "gap": (F.col("x") - F.col("y")) / n}).drop("x", "y")


def bin_quantiles(bins: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """The first bin at which the count so far reaches a share of the whole; ``bins(*keys, bin, n)``."""
    cell = W.partitionBy(*keys)
    run = bins.withColumns({"_c": F.sum("n").over(cell.orderBy("bin")), "_n": F.sum("n").over(cell)})
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("_c") >= F.col("_n") * q, F.col("bin"))).alias(f"q{int(q * 100)}") for q in shares])


def wasserstein(bins: DataFrame, keys: Sequence[str], left: str, right: str, width: float) -> DataFrame:
    """Distance of two histograms over common bins: the area between their shares so far; gaps between bins count."""
    cell = W.partitionBy(*keys)
    share = lambda c: F.sum(c).over(cell.orderBy("bin")) / F.sum(c).over(cell)
    gap = F.coalesce(F.lead("bin").over(cell.orderBy("bin")) - F.col("bin"), F.lit(0))
    return bins.withColumn("_a", F.abs(share(left) - share(right)) * gap).groupBy(*keys).agg((F.sum("_a") * width).alias("distance"))


def total_variation(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """Half the sum of differences of shares over all labels; ``left`` and ``right`` hold (label, n)."""
    share = lambda d, name: d.select(label, (F.col("n") / F.sum("n").over(W.partitionBy())).alias(name))
    both = share(left, "_l").join(share(right, "_r"), label, "full")
    return both.agg((F.sum(F.abs(F.coalesce("_l", F.lit(0.0)) - F.coalesce("_r", F.lit(0.0)))) / 2).alias("distance"))


def weighted_slope(x: Column, y: Column, w: Column) -> Column:
    """Slope of the weighted least squares line; null where x does not vary."""
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    spread = n * F.sum(w * x * x) - sx * sx
    return F.when(spread > 0, (n * F.sum(w * x * y) - sx * sy) / spread)


def order_accuracy(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Share of pairs in rising order, ties half, and of neighbours alone; a group is a short series, one array of values."""
    series = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("_v"))
    point = lambda a, b: F.when(b > a, 1.0).when(b == a, 0.5).otherwise(0.0)
    pairs = F.flatten(F.transform("_v", lambda a, i: F.transform(F.slice("_v", i + 2, F.size("_v")), lambda b: point(a, b))))
    near = F.zip_with(F.slice("_v", 1, F.size("_v") - 1), F.slice("_v", 2, F.size("_v")), point)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    return series.filter(F.size("_v") > 1).select(*keys, mean(pairs).alias("all_pairs"), mean(near).alias("neighbours"))


def seat_totals(pairs: DataFrame) -> DataFrame:
    """Games and points of each seat from rows of pairs (points are those of side a)."""
    played = F.col("wins") + F.col("draws") + F.col("losses")
    a = pairs.select(F.col("a").alias("seat"), played.alias("games"), "points")
    b = pairs.select(F.col("b").alias("seat"), played.alias("games"), (played - F.col("points")).alias("points"))
    return a.unionByName(b).groupBy("seat").agg(F.sum("games").alias("games"), F.sum("points").alias("points"))


def identity_of(ids: DataFrame, column: str) -> DataFrame:
    from tidemark.operators.selection import identity_digest

    return identity_digest(ids, column)
