"""How sure a number is: bounds on spreads, bootstraps by hashed draws, and what a sample can tell apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions import hashing
from tidemark.functions.shared import keep

#: Normal quantiles of a two-sided 5 % test and of 80 % power.
Z_TEST, Z_POWER = 1.959963984540054, 0.8416212335729143
#: Lower 5 % quantiles of chi squared for 1 to 10 degrees of freedom.
CHI2_05 = (0.00393214, 0.10258659, 0.35184632, 0.71072302, 1.14547623, 1.63538289, 2.16734991, 2.73263679, 3.32511284, 3.94029914)


def detectable(n: Column) -> Column:
    """The smallest difference of two rates that n of each can show, at the rate that is hardest."""
    return F.lit(Z_TEST + Z_POWER) * F.sqrt(2 * F.lit(0.25) / n)


def chi2_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(CHI2_05, 1)], "dof int, quantile double")


def bounded(rows: DataFrame, dispersion: str, dof: str) -> DataFrame:
    """Upper limit of a spread; none for a spread of zero, which has shown only that it could not move."""
    out = rows.join(F.broadcast(chi2_table(rows.sparkSession).withColumnRenamed("dof", "_dof")), F.col(dof) == F.col("_dof"), "left")
    return out.withColumn("bound", F.when(F.col(dispersion) > 0, F.col(dispersion) * F.sqrt(F.col(dof) / F.col("quantile")))).drop("_dof", "quantile")


def verdict(delta: Column, floor: Column) -> Column:
    return F.when(delta.isNull() | floor.isNull(), "unknown").when(F.abs(delta) > floor, "cleared").otherwise("within")


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count from a uniform number, by the inverse of its distribution."""
    out, total, term = F.when(u < 0.36787944117144233, 0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 8):
        term /= k
        total += term
        out = out.when(u < total, k)
    return out.otherwise(8)


def bootstrap(totals: DataFrame, cluster: str, keys: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """Spread of the ratio sum(total) / sum(n) when clusters are drawn anew; ``totals(cluster, *keys, total, n)``.

    Every cluster has a hashed count in every replicate; sums are combined before the shuffle, so it moves a row for
    each key and replicate.
    """
    rep = totals.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_weight(hashing.hash_fraction(seed, F.concat_ws(":", F.col(cluster), "_r")))
    per = rep.withColumn("_w", w).groupBy(*keys, "_r").agg((F.sum(F.col("total") * F.col("_w")) / F.sum(F.col("n") * F.col("_w"))).alias("_v"))
    return per.groupBy(*keys).agg(F.stddev_samp("_v").alias("dispersion"), F.count("_v").alias("replicates"))


def stratified_bootstrap(rows: DataFrame, stratum: str, key: str, value: str, replicates: int, seed: str) -> DataFrame:
    """Spread of the mean over strata when n - 1 of each stratum's n rows are drawn anew, scaled by n / (n - 1).

    The i-th row of a stratum brings the i-th draw of every replicate with it, so draws are made where rows are and
    meet what they drew by stratum and rank: a stratum of any size is spread over all tasks.
    """
    from tidemark.operators.batching import rank_within
    from tidemark.operators.quantiles import held

    ranked = keep(rank_within(rows.select(stratum, key, value), [stratum], [key], "_k").withColumn("_k", F.col("_k") - 1), "strata")
    sizes = ranked.groupBy(stratum).agg(F.count("*").alias("_n")).filter("_n > 1")
    slots = ranked.filter("_k > 0").select(stratum, F.col("_k").alias("_s")).join(held(sizes), stratum).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = F.floor(hashing.hash_fraction(seed, F.concat_ws(":", stratum, "_r", "_s")) * F.col("_n"))
    picks = slots.select(stratum, "_r", "_n", drawn.alias("_k")).join(ranked, [stratum, "_k"])
    return picks.groupBy("_r").agg((F.sum(F.col(value) * F.col("_n") / (F.col("_n") - 1)) / F.sum(F.col("_n") / (F.col("_n") - 1))).alias("_v")).agg(F.stddev_samp("_v").alias("dispersion"), F.count("_v").alias("replicates"))
