"""SimHash near-duplicate groups, searched with BK-trees.

A document's fingerprint has a bit set where over half of its shingles' XXH64 values have it set. Fingerprints link
at ``radius`` or fewer differing bits. The search works on distinct fingerprints only, so copies cost nothing:

* Each fingerprint goes to one shard for every way of choosing the bit blocks on which it may agree with a partner:
  of ``blocks`` blocks, ``radius`` may differ, so two linked fingerprints agree on the other ``blocks - radius`` and
  meet in that shard. The number of blocks follows from the number of fingerprints; every choice is exact.
* In a task, all fingerprints of its shards form one forest of BK-trees (children keyed by the integer Hamming
  distance to their parent). All searches run together, level by level, following only edges within the radius.
* A shard with more than ``shard_limit`` fingerprints is dealt out in tiles, each holding two pieces of it.
* A tree reports a spanning forest of the links it found (at most one edge for each fingerprint), never all pairs;
  the components of those edges are the groups.

Trees are not broadcast: their size grows with the corpus, so each shard's tree is built where its shard is.

Defined cases: null, empty or wordless text has fingerprint zero and is linked like any other; fewer words than a
shingle count as one shingle; repeated rows and repeated ids are rows of their own in the query, and the dedup keeps
one row of each group (ties: the smallest id, then the smallest text hash); a null id is never the smallest of a
group unless all are null; an empty table gives an empty result. Extra columns are kept by the dedup.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.shared import keep
from tidemark.llm.codes import bounded, pieces
from tidemark.operators.graph import connected_components


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint; only A-Z are lower-cased and only ASCII white space parts words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts[: max(1, len(words) - width + 1)].tolist(), ends[width - 1 :].tolist() or [len(line)]))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[s:e], seed) for s, e in spans], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """As a signed number, the bits that over half of the hashes have set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        h = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprinted(docs: DataFrame, columns: Sequence[str] | None = None, width: int = 4) -> DataFrame:
    """``(row, fp, tie)``: ``row`` a struct of ``columns`` (default all), ``fp`` the fingerprint as a signed long."""
    names = list(columns or docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("tie"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["tie"], T.StructField("fp", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = pa.array([fingerprint(t, width) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("tie"), fp], ["row", "tie", "fp"])

    return bounded(rows).mapInArrow(add, schema)


def block_masks(blocks: int, radius: int) -> list[int]:
    """One signed 64-bit mask for each choice of the blocks that must agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in itertools.combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class BKForest:
    """BK-trees over the points of each group, built and searched level by level for all groups at once."""

    def __init__(self, group: np.ndarray, points: np.ndarray):
        """``group`` is sorted; ``points`` are distinct in a group. Every point is the node of its own index."""
        n = len(points)
        self.points = points
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, n])
        self.root = np.repeat(starts, sizes)
        self.size = np.repeat(sizes, sizes)
        keys, kids = [], []
        rest = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        parent = self.root[rest]
        while len(rest):
            key = parent * 65 + np.bitwise_count(points[rest] ^ points[parent])
            order = np.argsort(key, kind="stable")
            key, rest = key[order], rest[order]
            first = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[first])
            kids.append(rest[first])
            parent = rest[first][np.cumsum(first) - 1][~first]
            rest = rest[~first]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], (np.concatenate(kids) if kids else np.zeros(0, np.int64))[order]

    def within(self, radius: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of one group at distance 1 to ``radius``, in portions; ``most`` bounds a search front."""
        cuts = np.searchsorted(np.cumsum(self.size), np.arange(1, self.size.sum() // most + 1) * most)
        for queries in np.split(np.arange(len(self.points)), np.unique(cuts)):
            node = self.root[queries]
            while len(queries):
                d = np.bitwise_count(self.points[queries] ^ self.points[node]).astype(np.int64)
                near = (d <= radius) & (queries != node)
                yield queries[near], node[near]
                low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), "left")
                n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - low
                at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                queries, node = np.repeat(queries, n), self.child[at]


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` points the smallest point it is connected to."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if len(a):
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while not np.array_equal(up := label[label], label):
                    label = up
    return label


def links(prints: DataFrame, radius: int = 4, shard_size: int = 4096, shard_limit: int = 16384) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``prints(fp)``: a spanning forest of the links of each shard."""
    n = prints.count()
    blocks = radius + 1
    while blocks < 2 * radius and n >> (64 * (blocks - radius) // blocks) > shard_size:
        blocks += 1
    shards = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(block_masks(blocks, radius))])
    placed = prints.select("fp", F.explode(shards).alias("shard")).select("fp", "shard.*")
    hot = placed.groupBy("choice", "value").agg(F.ceil(F.count("*") / F.lit(shard_limit / 2)).cast("int").alias("pieces")).filter("pieces > 2")
    piece = F.pmod(F.xxhash64("fp", F.lit("piece")), F.col("pieces")).cast("int")
    tiles = (
        placed.join(hot, ["choice", "value"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", piece)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("choice", "value", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "fp")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for choice, value, i, j, fp in whole_tiles(batches, 16 * shard_limit):
            order = np.lexsort((fp, j, i, value, choice))
            choice, value, i, j, fp = choice[order], value[order], i[order], j[order], fp[order]
            new = np.r_[True, (choice[1:] != choice[:-1]) | (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            forest = BKForest(np.cumsum(new), fp.view(np.uint64))
            label = joined(len(fp), forest.within(radius))
            linked = np.flatnonzero(label != np.arange(len(fp)))
            edges = np.unique(np.stack([fp[linked], fp[label[linked]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    tile = ("choice", "value", "i", "j")
    return tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(search, "a long, b long")


def whole_tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The columns of some whole tiles at a time, about ``most`` rows; tiles come sorted by their first four columns."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in range(5)])
        if sum(len(h[0]) for h in held) < most:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0))
        if len(cut):
            yield [c[: cut[-1] + 1] for c in columns]
            columns = [c[cut[-1] + 1 :] for c in columns]
        held = [columns]
    if held and sum(len(h[0]) for h in held):
        yield [np.concatenate(c) for c in zip(*held)]


def groups(printed: DataFrame, radius: int = 4) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct fingerprint of ``printed(doc_id, fp)``."""
    owners = keep(printed.groupBy("fp").agg(F.min("doc_id").alias("owner")), "simhash-prints")
    parts = connected_components(links(owners.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = owners.join(parts, "fp", "left")
    alone = rooted.filter("root is null").select("fp", F.col("fp").alias("root"), F.col("owner").alias("component_id"))
    linked = rooted.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("owner").alias("component_id"))
    return alone.unionByName(linked.join(least, "root").select("fp", "root", "component_id"))


def near_dedup(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id."""
    printed = fingerprinted(docs, ["doc_id"], width).select("row.doc_id", "fp")
    found = groups(keep(printed, "simhash-docs"), radius)
    kept = fingerprinted(docs, None, width).join(found, "fp").filter(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    once = kept.groupBy(F.col("row.doc_id").alias("id"), "root").agg(F.min_by("row", F.struct("tie")).alias("row"))
    return once.select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    printed = keep(fingerprinted(docs, ["doc_id"]).select("row.doc_id", "fp"), "simhash-docs")
    return printed.join(groups(printed), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
