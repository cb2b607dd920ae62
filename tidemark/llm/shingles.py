"""SimHash near-dedup for the pipeline: fingerprints of word shingles, checked on the whole sets.

A document's set is the hashes of its shingles, ``WIDTH`` words each. Two sets link if their exact Jaccard likeness is
``LEAST`` or more; groups are the components of the links.

* Candidates come from the BK-trees of ``simhash``, over fingerprints of the same shingles and within ``RADIUS`` bits.
* Fingerprints of pairs at a likeness of 0.8 differ in eight bits or more on average, and at a radius wide enough for
  them the bit blocks no longer part the fingerprints. So min-hash bands bring what the trees miss: two sets at 0.8
  share one of 24 bands of 6 with a chance of 0.9993, and with more the more alike they are.
* First each member of a bucket meets one only: the member that its bands bring together with the most others, which in
  a group of edited copies is the one nearest to all. What these links join need not meet again.
* In buckets that still hold several components, sets are ordered rarest shingle first. Two sets at 0.8 share one of
  the first fifth of the larger set, and one of the first ninth of the smaller set; so only sets of different
  components that do, and that can reach 0.8 from these places on, meet. This loses no pair, and what a group has in
  common comes last in the order, so its members do not meet through it. ``SLOTS`` counters give the order; sharing one
  makes it less sharp, never wrong.
* Every candidate is checked on the whole sets; sets are fetched for members of buckets only.

Defined cases: words and their case are those of ``simhash.fingerprint``; texts without words have an empty set and
are alike; fewer words than a shingle count as one shingle (so does text without spaces); equal sets link whatever
their texts; one row of each group stays, the one with the smallest id (ties: the smallest text hash), a null id only
if all are null; an empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.shared import keep
from tidemark.llm.codes import bounded, pieces
from tidemark.llm.simhash import links as links_of_prints, majority
from tidemark.operators.graph import connected_components

WIDTH, LEAST, RADIUS, BANDS, ROWS, SLOTS = 5, 0.8, 4, 24, 6, 1 << 20
FLIP, TIMES, FOLD = np.random.default_rng(5).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64) | np.array([[0], [1], [1]], np.uint64)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: max(1, len(words) - width + 1)].tolist(), ends[width - 1 :].tolist() or [len(line)])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], 42) for s, e in spans], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, width))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One value for each band; two sets share a value if all least hashes of a band agree."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[None, at : at + 1024] ^ FLIP[:, None]) * TIMES[:, None]).min(axis=1))
    return (least * FOLD).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")


def sketched(docs: DataFrame) -> DataFrame:
    """``(doc_id, tie, set, n, fp, bands)``: ``set`` names the set, ``n`` is its size; an empty set has no bands.

    ``fp`` is the SimHash fingerprint. Texts of one set may repeat shingles differently and so have several."""
    rows = keyed(docs)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tie long, set long, n int, fp long, bands array<long>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            whole = [shingle_hashes(t) for t in b.column("text").to_pylist()]
            found = [np.unique(h) for h in whole]
            names = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in found], np.uint64).view(np.int64)
            values = pa.array([bands(h) if len(h) else [] for h in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(names), pa.array([len(h) for h in found], pa.int32()), pa.array([majority(h) for h in whole], pa.int64()), values], ["doc_id", "tie", "set", "n", "fp", "bands"])

    return bounded(rows).mapInArrow(add, schema)


def checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are alike."""
    side = lambda c: sets.select(F.col("set").alias(c), F.col("hashes").alias(f"of_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b")  # a may be hot; by then rows have a size to split by

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(c).to_pylist()] for c in (2, 3))
            good = pa.array([likeness(p, q) >= least for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["a", "b"])

    return bounded(both).mapInArrow(check, "a long, b long")


def near_prints(distinct: DataFrame) -> DataFrame:
    """Candidates ``(a, b)``: sets of one fingerprint with the smallest of them, and those of fingerprints that BK-trees link."""
    heads = keep(distinct.filter("n > 0").groupBy("fp").agg(F.min(F.struct("set", "n")).alias("head")), "shingle-prints")
    same = distinct.join(heads, "fp").filter(F.col("set") != F.col("head.set")).select("head", F.struct("set", "n").alias("other"))
    side = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"of_{c}"))
    near = links_of_prints(heads.select("fp"), RADIUS).join(side("a"), "a").join(side("b"), "b").select(F.col("of_a").alias("head"), F.col("of_b").alias("other"))
    return same.unionByName(near)


def slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.int32)


def rarity(sets: DataFrame, size: int) -> np.ndarray:
    """How many shingles of the sets fall on each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at, n = np.unique(slots(np.frombuffer(b"".join(b.column("hashes").to_pylist()), np.uint64), size), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["slot", "n"])

    found = bounded(sets.select("hashes")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size, np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return table


def rare_first(sets: DataFrame, least: float, size: int) -> DataFrame:
    """``(set, component, n, at, h)``: the first shingles of each set in order of rarity that another set may have too."""
    order = sets.sparkSession.sparkContext.broadcast(rarity(sets, size))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            which, at, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for i, v in enumerate(b.column("hashes").to_pylist()):
                own = np.frombuffer(v, np.uint64)
                n = order.value[slots(own, size)]
                places = np.lexsort((own, n))[: int((1 - least) * len(own) + 1e-9) + 1]
                met = np.flatnonzero(n[places] > 1).astype(np.int32)
                which.append(np.full(len(met), i))
                at.append(met)
                h.append(own[places[met]])
            rows = b.select(["set", "component", "n"]).take(pa.array(np.concatenate(which)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(at)), pa.array(np.concatenate(h).view(np.int64))], ["set", "component", "n", "at", "h"])

    return bounded(sets).mapInArrow(first, "set long, component long, n int, at int, h long")


def across(sets: DataFrame, least: float, size: int = SLOTS) -> DataFrame:
    """Pairs ``(a, b)`` of sets of different components, all those among them that are alike; ``sets`` has ``(set, component, n, hashes)``."""
    rows = keep(rare_first(sets, least, size), "shingle-rare")
    sizes = rows.groupBy("h", "component").agg(F.count("*").alias("m")).groupBy("h")
    mixed = sizes.agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("components")).filter("components > 1").select("h", F.col("top.component").alias("main"))
    rows = rows.join(mixed, "h").withColumn("out", F.col("component") != F.col("main"))
    # of two components one is not the main one of a shingle, so the main one's sets do not meet each other
    larger = rows.withColumn("part", F.when(F.col("out"), 0).otherwise(1))
    smaller = rows.filter(F.col("at") <= F.lit((1 - least) / (1 + least)) * F.col("n") + 1e-9).withColumn("part", F.explode(F.when(F.col("out"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    reach = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= F.lit(least / (1 + least)) * (F.col("x.n") + F.col("y.n")) - 1e-9
    order = F.expr("x.h = y.h and x.part = y.part and x.component <> y.component and (x.n > y.n or x.n = y.n and x.set > y.set)")
    return larger.alias("x").join(smaller.alias("y"), order & (F.col("y.n") >= F.lit(least - 1e-9) * F.col("x.n")) & reach).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()


def links(docs: DataFrame, distinct: DataFrame, least: float = LEAST) -> DataFrame:
    """Edges ``(a, b)`` between sets: enough links of each bucket to join what is linked there."""
    fits = lambda n, m: F.least(n, m) >= F.lit(least - 1e-9) * F.greatest(n, m)  # noqa: E731  sets of other sizes cannot be so alike
    prints = near_prints(distinct).filter(fits(F.col("head.n"), F.col("other.n"))).select(F.least("head.set", "other.set").alias("a"), F.greatest("head.set", "other.set").alias("b"))
    prints = keep(prints.distinct(), "shingle-near-prints")
    placed = distinct.select(F.explode("bands").alias("band"), "set", "n")
    shared = placed.groupBy("band").agg(F.count("*").alias("met")).filter("met > 1")
    members = keep(placed.join(shared, "band"), "shingle-members")
    central = members.join(members.groupBy("set").agg(F.sum("met").alias("met_in_all")), "set")
    heads = central.groupBy("band").agg(F.max(F.struct("met_in_all", "set", "n")).alias("head"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("set"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["set", "hashes"])

    named = members.select("set").unionByName(prints.select(F.explode(F.array("a", "b")).alias("set"))).distinct()
    wanted = distinct.join(named, "set", "left_semi").select("set", "owner.doc_id", "owner.tie")
    texts = keyed(docs).alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id and d.tie = w.tie")).select("w.set", "d.text")
    sets = keep(bounded(texts).mapInArrow(fetch, "set long, hashes binary").dropDuplicates(["set"]), "shingle-sets")
    stars = members.join(heads, "band").filter((F.col("set") != F.col("head.set")) & fits(F.col("n"), F.col("head.n"))).select(F.col("head.set").alias("a"), F.col("set").alias("b")).unionByName(prints).distinct()
    first = keep(checked(stars, sets, least), "shingle-links")
    parts = members.select("band", "set", "n").join(connected_components(first).withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    parts = keep(parts, "shingle-parts")
    open_ = parts.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band")
    left = parts.join(open_, "band", "left_semi").select("set", "component", "n").distinct()
    rest = across(left.join(sets, "set").select("set", "component", "n", "hashes"), least)
    return first.unionByName(keep(checked(rest, sets, least), "shingle-links"))


def near_dedup(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id."""
    sketches = keep(sketched(docs), "shingle-sketches")
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("owner")
    distinct = keep(sketches.groupBy("set").agg(owner, F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "shingle-distinct")
    found = connected_components(links(docs, distinct, least)).withColumnRenamed("node", "set")
    rooted = distinct.select("set", "owner").join(found, "set", "left")
    kept = rooted.groupBy(F.coalesce("component", "set").alias("root")).agg(F.min("owner").alias("owner")).select("owner.doc_id", "owner.tie")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("tie"))
    chosen = rows.alias("r").join(kept.alias("k"), F.expr("r.doc_id <=> k.doc_id and r.tie = k.tie"), "left_semi")
    return chosen.groupBy("doc_id", "tie").agg(F.first("row").alias("row")).select("row.*")
