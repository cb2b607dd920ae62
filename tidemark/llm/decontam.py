"""Benchmark decontamination with spaced seeds.

Texts become words (runs of letters, marks and digits, lower-cased), and words 64-bit hashes. A spaced seed is a hash
of the words that a fixed mask leaves, so a substituted word in an ignored position does not hide a match. Hashes of
the benchmark and of the training text meet in a join, and each meeting fixes an alignment of a document and an item;
an alignment counts if some window of ``window`` words, among those around its hits, agrees in at least ``similarity``
of its words (items shorter than the window: in their whole length).

Before the join, a bitmap of the benchmark's hashes goes to every task. Its size is fixed (``2 ** BITMAP_BITS`` bits,
8 MB) whatever the benchmark holds; it lets few other hashes pass, and those fall out in the join. Only the words
around passing hashes are kept, once for each run of them. So the training text is read once and never shuffled.

No overlap is lost at the default similarity: for each number of words from 8 to 13, ``MASKS`` hit every choice of
substituted words that 0.8 allows (a test goes through them all). Items of fewer than 8 words have masks of their
whole length, one for each choice of the words that may differ; they are looked for only if the benchmark has such
items. A hash that meets very many places is split by a salt.

Defined cases: null and empty texts and texts without words match nothing, nor do items without words; repeated ids and rows of documents are matched one by one by the query's pair of id and
text hash and reported once for each id and item; a null id is reported as null; repeated items give one row for each
item id; an empty benchmark or table gives no rows. Extra columns are kept by the stage.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.shared import keep
from tidemark.llm.codes import bounded, code_points, pieces, portions, tables, word_starts

MASKS = ("111101", "110111", "11000111")
SHORT = 8  # items of fewer words have masks of their own
BITMAP_BITS = 26
#: Odd multipliers, from the fractional parts of square roots of primes.
MIX = np.array([0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179], np.uint64)


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX[0]
    h = (h ^ (h >> np.uint64(29))) * MIX[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words in order."""
    lower, _ = tables()
    for a, b in portions(texts):
        points, at = code_points(texts[a:b])
        x = lower[points]
        inside = x != 0
        starts = word_starts(inside)
        place = np.arange(len(x))
        first = np.zeros(len(x), np.int64)
        first[starts] = starts
        np.maximum.accumulate(first, out=first)
        letter = scramble(x.astype(np.uint64) * MIX[2] + (place - first).astype(np.uint64) * MIX[3])
        letter[~inside] = 0
        words = scramble(np.add.reduceat(letter, starts)) if len(starts) else np.zeros(0, np.uint64)
        cut = np.searchsorted(starts, at)
        for i in range(b - a):
            yield words[cut[i] : cut[i + 1]]


def short_masks(n: int, similarity: float) -> list[str]:
    """Masks as long as an item of ``n`` words, one for each choice of the words that may differ."""
    free = int(n * (1 - similarity) + 1e-9)
    return ["".join("0" if i in c else "1" for i in range(n)) for c in itertools.combinations(range(n), free)]


def seed_hashes(words: np.ndarray, masks: Sequence[str] = MASKS) -> list[np.ndarray]:
    """For each mask, the hash at each position where the whole mask fits."""
    out = []
    for mask in masks:
        n = max(0, len(words) - len(mask) + 1)
        h = np.full(n, zlib.crc32(mask.encode()) | 1, np.uint64) * MIX[7]
        for j, bit in enumerate(mask):
            if bit == "1":
                h = h + (words[j : j + n] ^ MIX[4]) * MIX[j % 8] + (words[j : j + n] >> np.uint64(31)) * MIX[(j + 3) % 8]
        out.append(scramble(h))
    return out


def items_table(benchmark: DataFrame, similarity: float) -> DataFrame:
    """``(item_id, words, hits array<struct<hash, pos>>)``."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def hash_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int64())]))
        for b in pieces(batches):
            words, hits = [], []
            for w in word_hashes(b.column("text").to_pylist()):
                words.append(w.view(np.int64))
                found = seed_hashes(w, MASKS if len(w) >= SHORT else short_masks(len(w), similarity)) if len(w) else []
                hits.append([{"hash": h, "pos": p} for s in found for p, h in enumerate(s.view(np.int64).tolist())])
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(words, pa.list_(pa.int64())), pa.array(hits, hit)], ["item_id", "words", "hits"])

    return bounded(rows).mapInArrow(hash_items, "item_id long, words array<long>, hits array<struct<hash:long,pos:long>>")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits set at the top ``BITMAP_BITS`` bits of each hash, as bytes; built by aggregation, at most 8 MB in all."""
    slot = F.shiftrightunsigned("hash", 64 - BITMAP_BITS) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << BITMAP_BITS, np.bool_)
    for r in parts:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(np.bool_)
        at = (r["bucket"] - 1) * len(bits)
        out[at : at + len(bits)] = bits
    return np.packbits(out, bitorder="little")


def passing(docs: DataFrame, bits: np.ndarray, window: int, masks: Sequence[str] = MASKS) -> DataFrame:
    """``(doc_id, tie, start, words, hits)``: stretches of documents around hashes that the bitmap lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    hit = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int64())]))
    reach = window + max(map(len, masks))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in pieces(batches):
            out = []
            for doc_id, tie, words in zip(b.column("doc_id").to_pylist(), b.column("tie").to_pylist(), word_hashes(b.column("text").to_pylist())):
                pos, hashes = [], []
                for h in seed_hashes(words, masks):
                    slot = h >> np.uint64(64 - BITMAP_BITS)
                    p = np.flatnonzero(table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    pos.append(p)
                    hashes.append(h[p].view(np.int64))
                p, h = np.concatenate(pos), np.concatenate(hashes)
                order = np.argsort(p, kind="stable")
                p, h = p[order], h[order]
                for q, g in zip(*(np.split(v, np.flatnonzero(np.diff(p) > reach) + 1) for v in (p, h))):
                    if len(q):
                        a = max(0, int(q[0]) - window)
                        near = words[a : int(q[-1]) + reach]
                        out.append((doc_id, tie, a, near.view(np.int64), [{"hash": y, "pos": x} for x, y in zip((q - a).tolist(), g.tolist())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), hit)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "tie", "start", "words", "hits"])

    return bounded(rows).mapInArrow(scan, "doc_id long, tie long, start long, words array<long>, hits array<struct<hash:long,pos:long>>")


def best_window(doc: np.ndarray, item: np.ndarray, shift: int, window: int) -> tuple[int, int, int]:
    """``(agreeing words, start in the item, length)`` of the best window where item word i lies on doc word i + shift."""
    size = min(window, len(item))
    same = np.zeros(len(item) + 1, np.int64)
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b > a:
        same[a + 1 : b + 1] = doc[a + shift : b + shift] == item[a:b]
    total = np.cumsum(same)
    agree = total[size:] - total[: len(total) - size]
    at = int(agree.argmax())
    return int(agree[at]), at, size


def overlaps(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, similarity: float = 0.8, most_met: int = 100_000) -> DataFrame:
    """``(doc_id, tie, item_id, doc_word, item_word, n_words, n_same)``: the best overlap of each document and item."""
    items = keep(items_table(benchmark, similarity), "benchmark-items")
    seeds = items.select("item_id", F.explode("hits").alias("hit")).select("item_id", F.col("hit.hash").alias("hash"), F.col("hit.pos").alias("item_pos"))
    lengths = sorted(r[0] for r in items.select(F.size("words")).filter(F.size("words").between(1, SHORT - 1)).distinct().collect())  # at most 7
    masks = [*MASKS, *(m for n in lengths for m in short_masks(n, similarity))]
    near = keep(passing(docs, bitmap(seeds), window, masks), "benchmark-near")
    met = near.select("doc_id", "tie", "start", F.explode("hits").alias("hit")).select("doc_id", "tie", "start", F.col("hit.hash").alias("hash"), F.col("hit.pos").alias("pos"))
    hot = met.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > most_met).select("hash", F.ceil(F.col("n") / most_met).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id", "tie", "start", "pos"), F.coalesce("parts", F.lit(1))).cast("int")
    met = met.join(hot, "hash", "left").withColumn("part", part).drop("parts")
    parted = seeds.join(hot, "hash", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    aligned = met.join(parted, ["hash", "part"]).select("doc_id", "tie", "start", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    ready = (
        aligned.alias("a").join(near.alias("n"), F.expr("a.doc_id <=> n.doc_id and a.tie = n.tie and a.start = n.start"))
        .select("a.*", F.col("words").alias("doc_words")).join(items.dropDuplicates(["item_id", "words"]).select("item_id", "words"), "item_id")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for doc_id, tie, start, item_id, shift, doc, item in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "start", "item_id", "shift")), b.column("doc_words"), b.column("words")):
                same, at, size = best_window(doc.values.to_numpy(), item.values.to_numpy(), shift, window)
                if same >= similarity * size:
                    out.append((doc_id, tie, item_id, start + at + shift, at, size, same))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], ["doc_id", "tie", "item_id", "doc_word", "item_word", "n_words", "n_same"])

    found = bounded(ready).mapInArrow(verify, "doc_id long, tie long, item_id long, doc_word long, item_word long, n_words long, n_same long")
    best = F.max_by(F.struct("doc_word", "item_word", "n_words", "n_same"), F.struct("n_same", -F.col("doc_word"), -F.col("item_word")))
    return found.groupBy("doc_id", "tie", "item_id").agg(best.alias("best")).select("doc_id", "tie", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that overlap with no item; columns unchanged."""
    found = overlaps(docs, benchmark, **options).select("doc_id", "tie").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
    return rows.alias("r").join(found.alias("f"), F.expr("r.doc_id <=> f.doc_id and r.tie = f.tie"), "left_anti").select("row.*")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = overlaps(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("doc_word", "item_word", "n_words", "n_same"), F.struct("n_same", "tie")).alias("best")).select("doc_id", "item_id", "best.*")
