"""Which rows are taken: ordered reasons, stable shares, views, pools and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import hashing
from tidemark.functions.checks import must
from tidemark.functions.parsing import first_reason


def screened(rows: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """``reason``: the first rule that rejects a row, null for accepted rows. One expression, so later rules cost little."""
    return rows.withColumn("reason", first_reason(*rules))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def hash_top(rows: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """The n rows with the lowest hashes: a top-n of each task, then of those."""
    return rows.orderBy(hashing.rank_key(seed, F.col(key)), F.col(key)).limit(n)


def size_dial(n: Column, fraction: float, most: int | None) -> Column:
    want = F.floor(n * F.lit(fraction))
    return F.least(want, F.lit(most)) if most is not None else want


def thinned(rows: DataFrame, acceptance: DataFrame, seed: str, key: str, sides: tuple[tuple[str, Column], tuple[str, Column]]) -> DataFrame:
    """Keep a row with the weighted mean of the acceptance of its two sides; ``sides``: value column and weight of each."""
    for i, (column, _) in enumerate(sides):
        rows = rows.join(acceptance.select(F.col("value").alias(column), F.col("accept").alias(f"_a{i}")), column, "left")
    weights = [w for _, w in sides]
    mean = sum((F.coalesce(f"_a{i}", F.lit(1.0)) * w for i, w in enumerate(weights)), F.lit(0.0)) / sum(weights[1:], weights[0])
    return rows.filter(hashing.hash_fraction(seed, F.col(key)) < mean).drop("_a0", "_a1")


def without_marked(rows: DataFrame, marked: DataFrame, mark: str, columns: Sequence[str]) -> DataFrame:
    """Rows with no marked id in any of the columns; an anti join for each, broadcast only where Spark finds it small."""
    ids = marked.select(F.col(mark).alias("_marked")).distinct()
    for c in columns:
        rows = rows.join(ids, F.col(c) == F.col("_marked"), "left_anti")
    return rows


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key in order, and the later ones."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").drop("_n")


def lowest_of_stratum(rows: DataFrame, stratum: Sequence[str], seed: str, key: str, k: int) -> DataFrame:
    """The k lowest hashes of each stratum; a smaller k takes a part of them."""
    order = W.partitionBy(*stratum).orderBy(hashing.rank_key(seed, F.col(key)), F.col(key))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def require(rows: DataFrame, **bad: Column) -> DataFrame:
    """One row of counts of what must not be; a count over zero fails the job under its name."""
    counted = rows.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in bad.items()])
    for k, held in [("no rows", F.col("rows") > 0), *((k, F.col(k) == 0) for k in bad)]:
        counted = counted.filter(must(held, k))
    return counted.withColumn("ok", F.lit(True))


def identity_digest(ids: DataFrame, column: str) -> DataFrame:
    """Digest of a set of ids, whatever their order: of their number and of the sums of eight 32-bit parts of their hashes.

    Sums combine in every task, so what is shuffled after the ids are made distinct is a row for each task.
    """
    one = ids.select(F.col(column).cast("string").alias("id")).filter(F.col("id").isNotNull()).distinct().select(F.sha2("id", 256).alias("h"))
    sums = one.agg(F.count("*").alias("n"), *[F.coalesce(s, F.lit(0).cast("decimal(30,0)")).alias(f"_s{i}") for i, s in enumerate(hashing.part_sums(F.col("h")))])
    return sums.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(8)]), 256).alias("digest"), "n")


def first_and_more(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``key``, and ``more``: whether there are others. One pass that keeps n + 1 rows; ties in no fixed order."""
    first = rows.orderBy(key).limit(n + 1)
    place = F.row_number().over(W.orderBy(key))  # over n + 1 rows
    return first.withColumn("_place", place).withColumn("more", F.count("*").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) > n).filter(F.col("_place") <= n).drop("_place")
