"""Composites: a frozen pool from a corpus, and the slice table of a held-out share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import hashing as H
from tidemark.functions.checks import must
from tidemark.functions.shared import keep
from tidemark.operators import dimension as D, metrics as M, selection as X
from tidemark.sources.stores import manifest, write_bounded


def held_out(rows: DataFrame, key: str, held: float, share: float, marked: DataFrame, mark: str, on: Sequence[str]) -> DataFrame:
    """Rows of the held-out splits in a hash share, without marked ids. Hash filters come first: they need no shuffle."""
    part = rows.filter((H.hash_fraction("split", F.col(key)) < held) & (H.hash_fraction("pool", F.col(key)) < share))
    return X.without_marked(part, marked, mark, on)


def freeze_pool(rows: DataFrame, key: str, path: str, *, columns: Sequence[str], marked: DataFrame, mark: str, on: Sequence[str], held: float, share: float) -> tuple[DataFrame, str]:
    """Write the pool in order of its key with a manifest; an empty pool or one that meets the training split fails."""
    pool = held_out(rows, key, held, share, marked, mark, on).select(*columns)
    written = write_bounded(pool, f"{path}/rows", key, 1_000_000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    gate = X.require(written, leaked=H.split_of("split", F.col(key), held / 3 * 2, held / 3) == "train")
    manifest(written, key).crossJoin(gate.filter("ok").select()).coalesce(1).write.text(f"{path}/manifest")
    return written, path


def write_recipe(spark: SparkSession, path: str, *, seed: str, validation: float, test: float) -> None:
    """Record how rows were split, beside what was split by it."""
    spark.range(1).select(F.to_json(F.struct(F.lit(seed).alias("seed"), F.lit(validation).alias("validation"), F.lit(test).alias("test"))).alias("value")).write.text(path)


def check_leakage(held: DataFrame, key: str, recipe_path: str, *, seed: str, validation: float, test: float) -> DataFrame:
    """``(state, leaked, held)``: held-out ids that the split of a training run put into its training part.

    The run's split is given; the recorded one is read. Where they differ nothing can be recomputed: "unverified".
    """
    recorded = held.sparkSession.read.text(recipe_path).select(F.from_json("value", "seed string, validation double, test double").alias("r")).select("r.*")
    same = recorded.agg((F.count_if((F.col("seed") == seed) & (F.col("validation") == validation) & (F.col("test") == test)) == 1).alias("same"))
    found = held.agg(F.count_if(H.split_of(seed, F.col(key), validation, test) == "train").alias("leaked"), F.count("*").alias("held"))
    return found.crossJoin(same).select(F.when(F.col("same"), "verified").otherwise("unverified").alias("state"), F.when(F.col("same"), F.col("leaked")).alias("leaked"), "held")


def load_pool(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row: the pool's size, and whether its identity is the recorded one; another fails the job."""
    rows = spark.read.parquet(f"{path}/rows")
    recorded = spark.read.text(f"{path}/manifest").select(F.from_json("value", "rows long, identity string").alias("m")).select("m.*")
    found = X.identity_digest(rows, key).crossJoin(recorded)
    same = (F.col("digest") == F.col("identity")) & (F.col("n") == F.col("rows"))
    return found.filter(must(same, "the pool is not the recorded one")).select("n", F.lit(True).alias("sound"))


def pool_slices(t) -> DataFrame:
    """For a held-out, leakage-checked share without marked ids: mean step loss by band, speed and family."""
    screened = X.screened(t.orders, ("unsupported_variant", F.col("o_orderstatus") == "P"), ("speed_mismatch", F.col("o_totalprice") < 1000)).filter("reason is null")
    pool = held_out(screened, "o_orderkey", 0.3, 0.3, t.customer.filter("c_custkey % 10 = 0"), "c_custkey", ["o_custkey"])
    pool = pool.select("o_orderkey", F.floor(F.col("o_totalprice") / 1000 / 100).alias("band"))
    # the lines of the pool's orders are taken before they are put in order, and kept for both uses
    lines = t.lineitem.join(pool.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    steps = keep(t.as_steps(lines).join(pool, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_orderkey", "band", "step", "l_partkey", "l_quantity", "l_discount"), "pool-steps")
    book = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("family"))
    named = D.deepest(steps, book, "l_orderkey", "step", "l_partkey", ["family"])
    rows = steps.join(named.select("l_orderkey", "family"), "l_orderkey").withColumn("speed", F.when(F.col("l_quantity") > 25, "slow").otherwise("fast"))
    return M.slice_table(rows, ["band", "speed", "family"], None, F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("loss"))
