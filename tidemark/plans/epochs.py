"""The order of training batches in an epoch, planned as a table, and cursors into it.

Groups of rows (files, archives, years) are put in an order drawn for the epoch and read some at a time, a *span*; the
rows of a span are shuffled and cut into batches, and the batches of a span are shuffled again. So a reader holds a span
and never an epoch, two epochs differ, and one epoch is the same on every run. A plan is partitioned by epoch and span,
so a resumed reader opens what is still to come and nothing before it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from tidemark.functions import hashing
from tidemark.functions.shared import keep
from tidemark.operators.batching import global_rank, rank_within
from tidemark.operators.quantiles import held
from tidemark.operators.selection import identity_digest


class Mismatch(ValueError):
    """A cursor of other data or of another configuration."""


def epoch_plan(rows: DataFrame, key: str, group: str, *, seed: str, epoch: int, groups: int, size: int, drop_last: bool = False) -> DataFrame:
    """``(epoch, span, batch, slot, key)``, all counted from 0: ``batch`` is a batch's place in its span.

    ``groups`` groups make a span, ``size`` rows a batch; ``drop_last`` leaves out a span's last, shorter batch. Ranks come
    from ranges, so a group or a span of any size is spread over all tasks.
    """
    drawn = lambda *c: hashing.rank_key(f"{seed}:{epoch}", F.concat_ws(":", *c))
    slim = rows.select(key, group)
    order = global_rank(slim.select(group).distinct(), [drawn(F.lit("group"), F.col(group).cast("string")), group], "_place")
    spans = order.select(F.col(group).alias("_group"), F.floor((F.col("_place") - 1) / groups).alias("span"))
    placed = slim.join(held(spans), F.col(group).eqNullSafe(F.col("_group"))).select(key, "span")
    placed = rank_within(placed, ["span"], [drawn(F.lit("row"), F.col(key).cast("string")), key], "_at")
    placed = keep(placed.select(key, "span", F.floor((F.col("_at") - 1) / size).alias("_cut"), ((F.col("_at") - 1) % size).cast("int").alias("slot")), "placed")
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.col(key).cast("string").alias("k")))), lambda s: s["k"]), ",")
    batches = placed.groupBy("span", "_cut").agg(members.alias("_members"), F.count("*").alias("_n"))
    if drop_last:
        batches = batches.filter(F.col("_n") == size)
    ordered = rank_within(batches.select("span", "_cut", drawn(F.lit("batch"), F.col("_members")).alias("_drawn")), ["span"], ["_drawn", "_cut"], "_b")
    ordered = ordered.select("span", "_cut", (F.col("_b") - 1).alias("batch"))
    return placed.join(ordered, ["span", "_cut"]).select(F.lit(epoch).alias("epoch"), F.col("span").cast("long").alias("span"), F.col("batch").cast("long").alias("batch"), "slot", key)


def write_plan(plan: DataFrame, path: str) -> None:
    """Add an epoch's plan; one that is there is replaced as a whole."""
    plan.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "span").parquet(path)


def configuration_digest(configuration: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(configuration, sort_keys=True).encode()).hexdigest()


def write_cursor(rows: DataFrame, key: str, path: str, configuration: Mapping[str, object], *, epoch: int, span: int, batch: int) -> None:
    """The next batch to read, with the identity of the data and of the configuration that its place stands in."""
    place = [F.lit(v).cast("long").alias(n) for n, v in (("epoch", epoch), ("span", span), ("batch", batch))]
    identity_digest(rows, key).select(F.to_json(F.struct("digest", F.lit(configuration_digest(configuration)).alias("configuration"), *place)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_cursor(rows: DataFrame, key: str, path: str, configuration: Mapping[str, object]) -> Row:
    """``(epoch, span, batch)``; refuses a cursor of other data or of another configuration."""
    stored = rows.sparkSession.read.text(path).select(F.from_json("value", "digest string, configuration string, epoch long, span long, batch long").alias("c")).select("c.*").first()
    if stored is None or None in tuple(stored):
        raise Mismatch("the cursor is incomplete")
    if stored.configuration != configuration_digest(configuration):
        raise Mismatch("the cursor is of another configuration")
    if stored.digest != identity_digest(rows, key).first()["digest"]:
        raise Mismatch("the cursor is of other data")
    return Row("epoch", "span", "batch")(stored.epoch, stored.span, stored.batch)


def resumed(spark: SparkSession, path: str, cursor: Row) -> DataFrame:
    """The rest of the cursor's epoch, from its batch on; spans before it are not opened."""
    rows = spark.read.parquet(path).filter((F.col("epoch") == cursor.epoch) & (F.col("span") >= cursor.span))
    return rows.filter((F.col("span") > cursor.span) | (F.col("batch") >= cursor.batch))
