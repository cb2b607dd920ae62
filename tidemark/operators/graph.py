"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.shared import checkpointed

HELD = 1 << 19  # edges of a task that are folded together
WORDS = 1 << 18  # words of 64 bits in the bitmap of some nodes, all that is sent to a task, however many they are


def marked(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """The rows whose value is among ``nodes`` (of one column), and few others: four bits of one word stand for a node.

    With 2**18 nodes some 1 in 10,000 others passes; with many more nodes more do, so what follows must be a join."""
    digest = lambda c: F.xxhash64(c).alias("_h")
    word = F.col("_h").bitwiseAND(WORDS - 1)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("_h", at).bitwiseAND(63).cast("int"))
    bits = bit(18).bitwiseOR(bit(24)).bitwiseOR(bit(30)).bitwiseOR(bit(36))
    bitmap = nodes.select(digest(nodes.columns[0])).select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_set"))
    return rows.withColumn("_h", digest(column)).join(F.broadcast(bitmap), (word == F.col("_word")) & (F.col("_set").bitwiseAND(bits) == bits), "left_semi").drop("_h")


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, least)`` of the nodes of some edges that are not the least of their component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (above := root[root]).tobytes() != root.tobytes():
            root = above
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def forests(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Fewer edges ``(a, b)`` of whole numbers with the same components: each task folds the edges that it reads, some at a
    time, so that what is shuffled is at most an edge for each node of a fold, and never more than came in."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            return forest(*map(np.concatenate, zip(*held)))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= HELD:
                held = [folded()]
                size = len(held[0][0])
                if size >= HELD // 2:  # many nodes: little more would be gained
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in folded()], ["a", "b"])

    whole = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna().filter("a <> b")
    return whole.mapInArrow(fold, "a long, b long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge; the component is its smallest node.

    Alternates two rounds until nothing changes: each node links its larger neighbours to its smallest one, then its
    smaller neighbours to the smallest one. Edges never grow in number, minima are combined before the shuffle, and
    each round is cut off by a checkpoint in the shared folder. Nodes without an edge do not appear; rows with a null
    end are ignored.
    """
    e = checkpointed(_oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()))
    digest = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = digest(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = _oriented(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(_oriented(small.unionByName(least.select("u", F.col("m").alias("v")))))
        if (now := digest(e)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
