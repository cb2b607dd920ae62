"""Removal of repeated byte strings with suffix arrays.

A byte goes if it is covered by a string of ``length`` bytes that starts anywhere else too, in the same document or in
another. Suffix arrays tell which such windows are repeated: a window is, if the suffix that it starts agrees over the
whole window with a neighbour in the array. Arrays over a whole corpus don't fit a task, so it is divided, exactly:

* Each window has an anchor, the least hashed byte gram in its first part (the rightmost on a tie), which its content
  alone fixes. Windows in a row with one anchor are a run; a run's bytes are its stretch. Equal windows lie in runs with
  equal seeds (the bytes behind the anchor that all its windows hold), so only stretches with one seed need comparing.
* Stretches that seem to occur more than once (their hashes are equal) enter an array from two of their places, each
  cut into symbols of a block of bytes: the stretch is repeated as a whole, if the suffix at its start agrees with a
  neighbour over all of it. The places of one hash have one text, so what the array says of two holds for all.
* Those that occur once meet, in a task for each seed, all other stretches with it. There the bytes that all windows of
  a block share become one symbol, so a window is a few symbols; blocks whose shared bytes no other has are done, and
  one suffix array is built over the rest, in which pieces of text that several stretches hold stand twice.

The array is built by linear grouping: suffixes with one Lyndon prefix form a group; groups are taken in descending
order, and each suffix in the group lengthens the prefix of its previous smaller one, which splits the groups below.
When all groups stand, one ascending pass gives each suffix its place in its group when the suffix behind its prefix is
placed. Nothing is renamed and there is no recursion.

Defined cases: null text is empty and loses nothing, as any text shorter than ``length``; repeated rows are documents
of their own, so their long texts go altogether; ids may be null or repeated, texts of one id are apart by their
hash; an empty table gives no rows. Other columns are kept in ``row`` by the operator.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tidemark.functions.shared import discard, keep
from tidemark.llm.codes import bounded, pieces
from tidemark.llm.decontam import MIX, scramble

BYTES = scramble(np.arange(1, 257, dtype=np.uint64) * MIX[5])
PLACE = 28  # low bits of a key that tell positions apart
CHUNK = 1 << 24  # window starts looked at together
HELD = 256  # stretches compared together: arrays so small stay in a core's cache


@dataclass(frozen=True)
class Plan:
    length: int = 400
    gram: int = 16  # a power of two
    window: int = 320  # a multiple of block; wider means fewer runs and shorter seeds
    block: int = 16

    @property
    def seed(self) -> int:
        return self.length - self.window + 1

    @property
    def whole(self) -> int:
        """Bytes of a symbol of stretches that are compared as a whole."""
        return 4 * self.block


# suffix arrays


def lyndon_groups(text: list[int]) -> tuple[list[list[int]], list[int]]:
    """Groups of suffixes with one Lyndon prefix, ascending, and the length of each suffix's Lyndon prefix."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    group, live = [0] * n, [len(m) for m in members]
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    done = [False] * len(members)
    length, previous = [1] * n, list(range(-1, n - 1))
    g, order = len(members) - 1, []
    while g >= 0:
        done[g] = True
        if live[g]:
            mine = members[g]  # ascending, as those that lengthen others are taken in order
            if len(mine) > live[g]:
                members[g] = mine = [i for i in mine if group[i] == g]
            order.append(g)
            w, taken = length[mine[0]], {}
            for i in mine:
                j = previous[i]
                while j >= 0 and done[group[j]]:  # what lies between is as large or larger
                    j = previous[j]
                k = i
                while (up := previous[k]) != j:  # and later searches need not look at it again
                    previous[k] = j
                    k = up
                if j >= 0:
                    taken[j] = taken.get(j, 0) + 1
            if len(taken) == 1:  # most groups are of one suffix
                split = [((group[j], k), [j]) for j, k in taken.items()]
            else:
                found: dict[tuple[int, int], list[int]] = {}
                for j, k in taken.items():
                    found.setdefault((group[j], k), []).append(j)
                split = sorted(found.items())
            last: dict[int, int] = {}
            for (h, k), moved in split:
                for j in moved:
                    length[j] += k * w
                # who takes more copies stands above who takes fewer, all right above those that take none
                if len(moved) == live[h] and h not in last:  # all take as many, so they stay together
                    continue
                new, under = len(members), last.get(h, h)
                over = above[under]
                members.append(moved)
                live.append(len(moved))
                live[h] -= len(moved)
                done.append(False)
                below.append(under)
                above.append(over)
                above[under] = last[h] = new
                if over >= 0:
                    below[over] = new
                for j in moved:
                    group[j] = new
        g = below[g]
    return [members[h] for h in reversed(order)], length


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes in ascending order; a suffix that is a prefix of another comes before it."""
    n = len(text)
    groups, length = lyndon_groups(text)
    slot, group, at = [], [0] * n, 0
    for g, m in enumerate(groups):
        slot.append(at)
        at += len(m)
        for i in m:
            group[i] = g
    head, link = [-1] * (n + 1), [-1] * n
    for i in range(n):
        behind = i + length[i]
        link[i] = head[behind]
        head[behind] = i
    out = [0] * n
    for r in range(-1, n):
        i = head[n if r < 0 else out[r]]
        while i >= 0:  # the suffix behind their prefix has its place, so they have the next of their group
            g = group[i]
            out[slot[g]] = i
            slot[g] += 1
            i = link[i]
    return out


def repeated_windows(text: list[int], size: int) -> np.ndarray:
    """Starts of windows of ``size`` symbols that occur elsewhere in ``text`` too; separators in it must be unique."""
    if len(text) < size:
        return np.zeros(0, np.int64)
    order, symbols = np.array(suffix_array(text), np.int64), np.array(text, np.int64)
    order = order[order <= len(text) - size]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(size):
        same &= symbols[order[:-1] + k] == symbols[order[1:] + k]
    return order[np.r_[same, False] | np.r_[False, same]]


def repeated_wholes(sequences: list[list[int]]) -> list[bool]:
    """Whether each sequence of symbols from 0 on occurs elsewhere in the sequences too."""
    text: list[int] = []
    starts, mark = [], 1 + max(map(max, sequences), default=0)
    for k, x in enumerate(sequences):
        starts.append(len(text))
        text += x
        text.append(mark + k)  # unique, so that nothing agrees across it
    order = suffix_array(text)
    place = [0] * len(text)
    for r, i in enumerate(order):
        place[i] = r
    near = ((x, order[max(0, place[i] - 1) : place[i]] + order[place[i] + 1 : place[i] + 2]) for i, x in zip(starts, sequences))
    return [any(text[j : j + len(x)] == x for j in found) for x, found in near]


# runs of windows


def find_runs(texts: Sequence[bytes], plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, first window, last window, anchor)`` of the runs, text by text; long texts come in several portions."""
    # a portion of a text holds the bytes of its windows, so where it is cut a run ends, and no more
    cuts = [(i, a, min(a + CHUNK + plan.length - 1, len(t))) for i, t in enumerate(texts) for a in range(0, max(0, len(t) - plan.length + 1), CHUNK)]
    at = 0
    while at < len(cuts):
        size, to = 0, at
        while to < len(cuts) and (size == 0 or size + cuts[to][2] - cuts[to][1] <= 1 << 21):
            size += cuts[to][2] - cuts[to][1]
            to += 1
        yield from runs_of(texts, cuts[at:to], plan)
        at = to


def runs_of(texts: Sequence[bytes], cuts: list[tuple[int, int, int]], plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in cuts), np.uint8)
    h, step, times = BYTES[data], 1, MIX[6:7]  # an array: products wrap
    while step < plan.gram:  # the hash of twice as many bytes from those of both halves
        h = h[:-step] * times + h[step:]
        step, times = 2 * step, times * times
    low = np.uint64((1 << PLACE) - 1)
    key = (scramble(h) & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost is least
    width = 1
    while 2 * width <= plan.window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < plan.window:
        key = np.minimum(key[: len(key) - (plan.window - width)], key[plan.window - width :])
    anchor = (low - (key & low)).astype(np.int64)
    base = 0
    for i, a, b in cuts:
        mine = anchor[base : base + b - a - plan.length + 1]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        last = np.r_[first[1:], len(mine)] - 1
        yield i, first + a, last + a, mine[first] - base + a
        base += b - a


def packed(first: int, last: int, anchor: int) -> int:
    """A run in one number: 40 bits of its start, and 12 each of its other windows and of the way to its anchor."""
    return first << 24 | last - first << 12 | anchor - first


def unpacked(run: int) -> tuple[int, int, int]:
    first = run >> 24
    return first, first + (run >> 12 & 4095), first + (run & 4095)


RUN = "doc_id long, tie long, run long, seed long, stretch long"


def runs_table(docs: DataFrame, plan: Plan) -> DataFrame:
    """A row for each run: its document, place, and hashes of its seed and of its stretch."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in pieces(batches):
            ids, ties = b.column("doc_id").to_pylist(), b.column("tie").to_pylist()
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            for i, first, last, anchor in find_runs(texts, plan):
                view = memoryview(texts[i])
                first, last, anchor = first.tolist(), last.tolist(), anchor.tolist()
                seeds = np.array([digest(view[p : p + plan.seed], 1) for p in anchor], np.uint64).view(np.int64)
                stretches = np.array([digest(view[a : z + plan.length], 2) for a, z in zip(first, last)], np.uint64).view(np.int64)
                runs = [packed(a, z, p) for a, z, p in zip(first, last, anchor)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(runs), pa.int64()), pa.array([ties[i]] * len(runs), pa.int64()), pa.array(runs, pa.int64()), pa.array(seeds), pa.array(stretches)], ["doc_id", "tie", "run", "seed", "stretch"])

    return bounded(keyed(docs)).mapInArrow(scan, RUN)


# stretches that may be repeated


def confirmed(entries: list[tuple[int, int, bytes, bytes]], plan: Plan) -> list[tuple[int, int]]:
    """Of ``(seed, stretch, bytes before the anchor, bytes behind the seed)``, two places or more of each stretch: the
    ``(seed, stretch)`` that the suffix array finds in two of them."""
    found: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
    for seed, stretch, left, right in entries:
        places = found.setdefault((seed, stretch), [])
        if len(places) < 2:  # rows that are repeated as a whole bring more
            places.append((left, right))
    names: dict[int | bytes, int] = {}
    sequences = []
    for (seed, _), places in found.items():
        for left, right in places:
            parts = [x[i : i + plan.whole] for x in (left, right) for i in range(0, len(x), plan.whole)]
            parts.insert(-(-len(left) // plan.whole), seed)
            sequences.append([names.setdefault(x, len(names)) for x in parts])
    repeated = iter(repeated_wholes(sequences))
    return [k for k, places in found.items() if all([next(repeated) for _ in places])]


def compare(entries: list[tuple[int, int, bytes, bytes, int]], plan: Plan) -> list[tuple[int, int, int]]:
    """``(entry, least, most)`` bytes before the anchor at which repeated windows start.

    An entry is a distinct stretch: its seed, the way from its first window to the anchor, the bytes before the anchor,
    the bytes behind the seed, and how often it occurs. Those that occur more than once are only compared with.
    """
    digest, size = xxhash.xxh3_128_digest, plan.block
    cores: dict[bytes, list[tuple[int, int, bytes, bytes]]] = {}
    for e, (seed, _, left, right, _) in enumerate(entries):
        nearest = plan.window - 1 - len(right)  # of a window's start to the anchor, in bytes
        head = seed.to_bytes(8, "little", signed=True)
        for t in range(nearest // size, len(left) // size + 1):
            near, far = max(nearest, size * t), min(len(left), size * t + size - 1)
            shared = plan.window - size * (t + 1)  # bytes behind the seed that all windows of the block hold
            if near <= far and shared <= len(right):
                before, behind = left[len(left) - far : len(left) - size * t], right[shared : shared + plan.window - 1 - near - shared]
                core = digest(b"".join((head, t.to_bytes(2, "little"), left[len(left) - size * t :] if t else b"", right[:shared])))
                cores.setdefault(core, []).append((e, t, before, behind))
    text: list[int] = []
    where: list[tuple[list[int], int, int, int]] = []  # entries, block, start of their piece in the text, bytes before the core
    symbol = 256
    for found in cores.values():
        if len(found) < 2 or all(entries[e][4] > 1 for e, *_ in found):
            continue
        kinds: dict[tuple[bytes, bytes], list[int]] = {}
        for e, _, before, behind in found:
            kinds.setdefault((before, behind), []).append(e)
        for (before, behind), same in kinds.items():
            once = [e for e in same if entries[e][4] == 1]
            for owners in (once, []) if len(same) > 1 or not once else (once,):  # in the text twice where several hold it
                where.append((owners, found[0][1], len(text), len(before)))
                text += before
                text.append(symbol)
                text += behind
                text.append(-1)
        symbol += 1
    marks = iter(range(symbol, symbol + len(where) + 1))
    text = [next(marks) if c < 0 else c for c in text]  # unique, so that nothing agrees across them
    hits = np.sort(repeated_windows(text, size))
    piece = np.searchsorted(np.array([w[2] for w in where], np.int64), hits, "right") - 1
    new = np.flatnonzero(np.r_[True, (np.diff(hits) > 1) | (np.diff(piece) > 0)]) if len(hits) else hits
    out = []
    for first, last, k in zip(hits[new].tolist(), hits[np.r_[new[1:], len(hits)] - 1].tolist() if len(hits) else [], piece[new].tolist()):
        owners, t, start, before = where[k]
        out += [(e, size * t + before - (last - start), size * t + before - (first - start)) for e in owners]
    return out


INTERVALS = "doc_id long, tie long, start long, end long"


def squeezed(text: str) -> bytes:
    """A text's bytes, compressed, behind 8 bytes of their number."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def opened_up(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(memoryview(data)[8:], size, codec="zstd", asbytes=True) if size else b""


def with_squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` squeezed: texts meet their runs in shuffles, whose files stay until the driver collects them."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in rows.schema])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            small = pa.array([squeezed(t) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if n == "text" else b.column(n) for n in b.schema.names], b.schema.names)

    return bounded(rows).mapInArrow(squeeze, schema)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))


def intervals(docs: DataFrame, plan: Plan) -> DataFrame:
    """``(doc_id, tie, start, end)``: bytes to remove; the intervals of a document may overlap."""
    runs = keep(runs_table(docs, plan), "suffix-runs")
    stretches = runs.groupBy("seed", "stretch").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "tie", "run")])
    stretches = keep(stretches, "suffix-stretches")
    several = keep(runs.join(stretches.filter("copies > 1").select("seed", "stretch"), ["seed", "stretch"], "left_semi"), "suffix-several")
    discard(runs)
    drawn = F.xxhash64("doc_id", "tie", "run")
    first, last = (F.struct(*[by(c, drawn).alias(c) for c in ("doc_id", "tie", "run")]) for by in (F.min_by, F.max_by))
    places = several.groupBy("seed", "stretch").agg(first.alias("first"), last.alias("last"))
    # whole stretches may be dealt by themselves; those that occur once meet all of their seed
    places = places.select("seed", "stretch", F.explode(F.array("first", "last")).alias("place")).select("seed", "stretch", "place.*", F.lit(2).cast("long").alias("copies"), F.lit(True).alias("whole"))
    of_seed = W.partitionBy("seed")
    varied = stretches.withColumns({"kinds": F.count("*").over(of_seed), "least": F.min("copies").over(of_seed)}).filter("kinds > 1 and least = 1")
    opened = varied.drop("kinds", "least").withColumn("whole", F.lit(False)).unionByName(places)
    opened = opened.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("seed", "stretch", "run", "copies", "whole")).alias("runs"))
    cut_from = with_squeezed(keyed(docs)).alias("d").join(opened.alias("o"), F.expr("d.doc_id <=> o.doc_id and d.tie = o.tie")).select("d.doc_id", "d.tie", "d.text", "o.runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int64()] * 6, pa.bool_(), pa.binary(), pa.binary())
        names = ["doc_id", "tie", "seed", "stretch", "run", "copies", "whole", "before", "behind"]
        for b in pieces(batches, 64):
            out = []
            for doc_id, tie, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "text", "runs"))):
                data = opened_up(text)
                for r in found:
                    first, last, anchor = unpacked(r["run"])
                    out.append((doc_id, tie, r["seed"], r["stretch"], r["run"], r["copies"], r["whole"], data[first:anchor], data[anchor + plan.seed : last + plan.length]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            once = [r for r in held if not r[6]]
            out = [(None, None, None, None, *k) for k in confirmed([(r[2], r[3], r[7], r[8]) for r in held if r[6]], plan)]
            for e, least, most in compare([(r[2], 0, r[7], r[8], r[5]) for r in once], plan):
                doc_id, tie, _, _, run, *_ = once[e]
                anchor = unpacked(run)[2]
                out.append((doc_id, tie, anchor - most, anchor - least + plan.length, None, None))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], ["doc_id", "tie", "start", "end", "seed", "stretch"])

        for b in batches:  # in order of the key; all rows of a key are compared together, some hundred at a time
            for *r, key in zip(*(b.column(c).to_pylist() for c in range(10))):
                if len(held) >= HELD and before != key:
                    yield done()
                    held = []
                held.append(r)
                before = key
        yield done()

    cut_out = bounded(cut_from).mapInArrow(cut, "doc_id long, tie long, seed long, stretch long, run long, copies long, whole boolean, before binary, behind binary")
    dealt = cut_out.withColumn("key", F.when(F.col("whole"), F.xxhash64("seed", "stretch")).otherwise(F.col("seed"))).repartition("key").sortWithinPartitions("key")
    found = keep(dealt.mapInArrow(search, f"{INTERVALS}, seed long, stretch long"), "suffix-found")
    discard(stretches)
    settled = several.join(found.filter("start is null").select("seed", "stretch"), ["seed", "stretch"], "left_semi").select(
        "doc_id", "tie", F.shiftright("run", 24).alias("start"), (F.shiftright("run", 24) + F.shiftright("run", 12).bitwiseAND(F.lit(4095)) + F.lit(plan.length)).alias("end")
    )
    # a stretch that occurs once lies in one row, but rows may be repeated: then all of theirs occur more than once
    return settled.unionByName(found.filter("start is not null").select("doc_id", "tie", "start", "end"))


def without_repeats(docs: DataFrame, plan: Plan = Plan(), columns: Sequence[str] | None = None) -> DataFrame:
    """``(row, n_bytes, n_removed, n_spans, kept)``: ``row`` a struct of ``columns`` (default all), ``kept`` the bytes left."""
    names = list(columns or docs.columns)
    if names == ["doc_id"]:
        rows = keyed(docs)
    else:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    gone = intervals(docs.select("doc_id", "text"), plan).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    joined = with_squeezed(rows).alias("r").join(gone.alias("g"), F.expr("r.doc_id <=> g.doc_id and r.tie = g.tie"), "left")
    joined = joined.select(F.struct("r.doc_id").alias("row") if names == ["doc_id"] else F.col("row"), "text", "gone")
    schema = T.StructType([joined.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone")):
                data = opened_up(text)
                spans, kept = [], []
                if gone.is_valid and len(gone):
                    pairs = gone.values
                    start, end = pairs.field("start").to_numpy(), pairs.field("end").to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate(end[order])
                    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
                    spans = list(zip(start[new].tolist(), reach[np.r_[new[1:], len(reach)] - 1].tolist()))
                at = 0
                for a, z in spans:
                    kept.append(data[at:a])
                    at = z
                kept.append(data[at:])
                out.append((len(data), sum(z - a for a, z in spans), len(spans), b"".join(kept)))
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return bounded(joined).mapInArrow(remove, schema)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), columns=["doc_id"])
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
