"""A Merkle manifest of a dataset, kept as a postorder append log.

Every row is a leaf; the leaves of a source, in order of their id, stand under nodes of up to 16 children, and the
roots of the sources under further nodes in the same way. A tree is built by aligned builders: each takes 4,096
consecutive leaves (three levels), and writes its nodes in the order in which they are completed, children before
their parent. A builder's log is one row, a *segment*; the roots of segments are the leaves of the next round of
builders, so a tree of any size takes few rounds and no task holds more than a segment.

The place of a node in such a log follows from the sizes of full subtrees alone (``position``), so a proof needs no
search: the siblings of a leaf on every level are read from their places. Proofs go down the rounds: a segment gets
the path above its root from the segment one round up, and its leaves extend it.

Defined cases: a null field is ``-``, so it differs from any text; rows with a null source are a tree of their own, the
first; a null id comes first in its source; rows of one id are ordered by their digests, and repeated rows are leaves
of their own; texts count as a whole, however long; an empty table has no root and no proofs. Other columns don't
count, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.shared import keep
from tidemark.operators.batching import rank_within

FANOUT = 16
#: Levels that one builder completes, and the leaves that it takes.
LEVELS = 3
WIDTH = FANOUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value after its length in bytes; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


# places in a log


def position(level: int, index: int, leaves: int) -> int:
    """The place, from 0, of node ``index`` of a level in the log of a tree of so many leaves.

    A node over a full subtree is written right after its last leaf; before it come, level by level, all nodes that
    end no later. The nodes over the ragged end are written last, from low to high.
    """
    end, before, size = (index + 1) * FANOUT**level, 0, 1
    if end <= leaves:
        for j in range(end.bit_length() // 4 + 1):
            before += (end if j <= level else end - 1) // size
            size *= FANOUT
        return before - 1
    for j in range(leaves.bit_length() // 4 + 1):
        before += leaves // size
        size *= FANOUT
    return before + sum(leaves % FANOUT**j > 0 for j in range(1, level))


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // FANOUT), n + 1
    return n


class Builder:
    """Appends leaves; ``nodes`` is the log so far."""

    def __init__(self) -> None:
        self.nodes: list[str] = []
        self.open: list[list[str]] = [[]]
        self.leaves = 0

    def put(self, level: int, digest: str) -> None:
        self.nodes.append(digest)
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(digest)

    def close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.put(level + 1, digest_of("".join(run)))

    def append(self, leaf: str) -> None:
        self.leaves += 1
        self.put(0, leaf)
        level = 0
        while len(self.open[level]) == FANOUT:
            self.close(level)
            level += 1

    def seal(self, levels: int) -> list[str]:
        """Complete the nodes over the ragged end, up to a level."""
        for level in range(min(levels, len(self.open) + levels)):
            if level < len(self.open) and self.open[level]:
                self.close(level)
        return self.nodes


def sealed(builder: Builder, part: int) -> list[str]:
    """A short first segment is a whole tree and ends with its root; any other segment reaches the root level of segments."""
    return builder.seal(height(builder.leaves) if part == 0 else LEVELS)


# builders


SEGMENT = "tree string, part long, leaves int, nodes array<string>, ids array<string>, altered array<string>"


def segments(leaves: DataFrame) -> DataFrame:
    """``leaves(tree, at, digest, id, altered)``, ``at`` from 0 in each tree, to one row for each run of WIDTH leaves."""
    texts = pa.list_(pa.string())
    kinds = {"tree": pa.string(), "part": pa.int64(), "leaves": pa.int32(), "nodes": texts, "ids": texts, "altered": texts}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, key = 0, None
        builder, ids, altered = Builder(), [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values())], list(kinds))

        for b in batches:
            for tree, part, digest, i, other in zip(*(b.column(c).to_pylist() for c in ("tree", "part", "digest", "id", "altered"))):
                if (tree, part) != key:
                    if key is not None:
                        out.append((*key, builder.leaves, sealed(builder, key[1]), ids, altered))
                        size += builder.leaves
                    if size > 4 * WIDTH or len(out) > 4096:
                        yield flush()
                        out, size = [], 0
                    key, builder, ids, altered = (tree, part), Builder(), [], []
                builder.append(digest)
                ids.append(i)
                altered.append(other)
        if key is not None:
            out.append((*key, builder.leaves, sealed(builder, key[1]), ids, altered))
        yield flush()

    rows = leaves.withColumn("part", F.floor(F.col("at") / WIDTH)).repartition("tree", "part").sortWithinPartitions("tree", "part", "at")
    return rows.select("tree", "part", "digest", "id", "altered").mapInArrow(build, SEGMENT)


def rounds(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Segments of the leaves, of their roots, and so on, until each tree has one; every round is a table in the shared folder."""
    none = F.lit(None).cast("string")
    made = []
    while True:
        made.append(keep(segments(leaves), f"{name}-{len(made)}"))
        if not made[-1].agg(F.max("part")).first()[0]:
            return made
        leaves = made[-1].select("tree", F.col("part").alias("at"), F.element_at("nodes", -1).alias("digest"), none.alias("id"), none.alias("altered"))


@dataclass
class Manifest:
    """``sources``: the rounds over the rows of each tree; ``top``: the rounds over the subroots; ``trees(tree, at, subroot)``."""

    sources: list[DataFrame]
    top: list[DataFrame]
    trees: DataFrame
    root: str | None


def manifest(rows: DataFrame, by: Column, key: Column, leaf: Column, altered: Column | None = None) -> Manifest:
    """Trees by the values of ``by`` (null first), leaves in order of ``key``. ``altered`` is a leaf to check in place of
    a row's own later on, where it is not null."""
    tree = F.coalesce(F.concat(F.lit("="), by.cast("string")), F.lit(""))
    other = (altered if altered is not None else F.lit(None)).cast("string")
    flat = rows.select(tree.alias("tree"), key.alias("key"), key.cast("string").alias("id"), leaf.alias("digest"), other.alias("altered"))
    ranked = rank_within(flat, ["tree"], ["key", "digest"], "at")
    sources = rounds(ranked.withColumn("at", F.col("at") - 1), "log")
    roots = sources[-1].select("tree", F.element_at("nodes", -1).alias("subroot")).withColumn("all", F.lit(""))
    trees = keep(rank_within(roots, ["all"], ["tree"], "at").select("tree", (F.col("at") - 1).alias("at"), "subroot"), "trees")
    none = F.lit(None).cast("string")
    top = rounds(trees.select(F.lit("").alias("tree"), "at", F.col("subroot").alias("digest"), none.alias("id"), none.alias("altered")), "top")
    last = top[-1].select(F.element_at("nodes", -1).alias("root")).first()
    return Manifest(sources, top, trees, last and last.root)


def log(found: Manifest) -> DataFrame:
    """``(tree, position, level, index, digest)``: the whole postorder log of every source, by places in closed form."""
    sizes = found.sources[0].groupBy("tree").agg(F.sum("leaves").alias("n"))
    out = None
    for k, segs in enumerate(found.sources):
        rows = segs.join(sizes, "tree").select("tree", "part", "leaves", "nodes", "n")

        def place(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    local = r["leaves"], height(r["leaves"]) if r["part"] == 0 and r["leaves"] < WIDTH else LEVELS
                    made = []
                    for level in range(k > 0, local[1] + 1):  # the leaves of a later round are in the log already
                        for i in range(-(-local[0] // FANOUT**level)):
                            index = r["part"] * FANOUT ** (LEVELS - level) + i
                            made.append((r["tree"], position(k * LEVELS + level, index, r["n"]), k * LEVELS + level, index, r["nodes"][position(level, i, local[0])]))
                    columns = list(zip(*made)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["tree", "position", "level", "index", "digest"])

        made = rows.mapInArrow(place, "tree string, position long, level int, index long, digest string")
        out = made if out is None else out.unionByName(made)
    return out


# proofs


def siblings(nodes: Sequence[str], leaves: int, part: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a segment the digests before and after it in its run, level by level, read at their places."""
    levels = height(leaves) if part == 0 and leaves < WIDTH else LEVELS
    read = []
    for level in range(levels):
        count = -(-leaves // FANOUT**level)
        read.append(["".join(nodes[position(level, i, leaves)] for i in range(a, min(a + FANOUT, count))) for a in range(0, count, FANOUT)])
    for at in range(leaves):
        path = []
        for level in range(levels):
            run, own = divmod(at // FANOUT**level, FANOUT)
            text = read[level][run]
            path.append((text[: 64 * own], text[64 * (own + 1) :]))
        yield path


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = digest_of(before + leaf + after)
    return leaf


PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
PATHS = "tree string, at long, path array<struct<before:string,after:string>>"


def descended(segs: DataFrame, above: DataFrame | None) -> DataFrame:
    """``(tree, at, path)`` of every leaf of these segments; ``above(tree, part, path)`` are the paths of their roots."""
    rows = segs.select("tree", "part", "leaves", "nodes")
    rows = rows.join(above, ["tree", "part"]) if above is not None else rows.withColumn("path", F.lit(None).cast("array<struct<before:string,after:string>>"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                above = [(s["before"], s["after"]) for s in r["path"] or []]
                paths = [[{"before": x, "after": y} for x, y in path + above] for path in siblings(r["nodes"], r["leaves"], r["part"])]
                places = pa.array(range(r["part"] * WIDTH, r["part"] * WIDTH + r["leaves"]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * r["leaves"], pa.string()), places, pa.array(paths, PATH)], ["tree", "at", "path"])

    return rows.mapInArrow(walk, PATHS)


def upper_paths(found: Manifest) -> DataFrame:
    """``(tree, part, path, subroot)``: the path above each segment of the first round, up to the root of all."""
    above = None
    for segs in reversed(found.top):
        above = descended(segs, above).select("tree", F.col("at").alias("part"), "path")
    above = found.trees.join(above.select(F.col("part").alias("at"), "path"), "at").select("tree", F.lit(0).cast("long").alias("part"), "path")
    for segs in reversed(found.sources[1:]):
        above = descended(segs, above).select("tree", F.col("at").alias("part"), "path")
    return above.join(found.trees.select("tree", "subroot"), "tree")


CHECKED = {"id": pa.string(), "leaf": pa.string(), "subroot": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string()}


def checked(found: Manifest) -> DataFrame:
    """A row for each leaf: its digest, its subroot, the digest of its proof, and the root that its altered (else own)
    digest gives with that proof. Proofs are made and used in the task that holds the segment and never shuffled."""
    rows = found.sources[0].join(upper_paths(found), ["tree", "part"])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                above = [(s["before"], s["after"]) for s in r["path"]]
                out: dict[str, list] = {c: [] for c in CHECKED}
                for i, path in enumerate(siblings(r["nodes"], r["leaves"], r["part"])):
                    path += above
                    leaf = r["nodes"][position(0, i, r["leaves"])]
                    values = (r["ids"][i], leaf, r["subroot"], digest_of("".join(x + y for x, y in path)), fold(r["altered"][i] or leaf, path))
                    for c, v in zip(CHECKED, values):
                        out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in CHECKED.items()], list(CHECKED))

    return rows.select("nodes", "leaves", "part", "ids", "altered", "path", "subroot").mapInArrow(prove, ", ".join(f"{c} string" for c in CHECKED))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; every fifth id by its crc is checked with its text in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    low = F.translate("text", UPPER, LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    values = [F.col(c) for c in COLUMNS]
    found = manifest(docs, F.col("source"), F.col("doc_id"), leaf_of(*values), F.when(tampered, leaf_of(*values[:-1], low)))
    root = F.lit(found.root).cast("string")
    return checked(found).select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def oracle(levels: int = 5, top: int = 3) -> str:
    """The same in DuckDB for up to 16^levels rows of a source and 16^top sources, each level written out."""
    of = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"
    head = " || ".join(of(c) for c in COLUMNS[:-1])
    with_ = [
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({head} || {of('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {of(f'''translate(text, '{UPPER}', '{LOWER}')''')}) END AS altered FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves)",
        "s0 AS (SELECT tree, idx, leaf AS d FROM placed)",
    ]

    def grow(name: str, count: int, first: str) -> None:
        before = first
        for k in range(count):
            with_.append(f"{name}r{k} AS (SELECT tree, idx // 16 AS run, string_agg(d, '' ORDER BY idx) AS r, count(*) AS n, max(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {before}) GROUP BY 1, 2)")
            with_.append(f"{name}n{k} AS (SELECT tree, run AS idx, CASE WHEN m > 1 THEN sha256(r) ELSE r END AS d FROM {name}r{k})")
            before = f"{name}n{k}"

    grow("s", levels, "s0")
    with_.append(f"subs AS (SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, d FROM s{'n'}{levels - 1})")
    grow("t", top, "subs")
    with_.append(f"roots AS (SELECT d AS root FROM tn{top - 1})")
    with_.append("w0 AS (SELECT p.*, s.idx AS top_at, s.d AS subroot, '' AS proof, coalesce(altered, leaf) AS f FROM placed p JOIN subs s ON s.name = p.tree)")
    step = 0
    for name, count, place in (("s", levels, "idx"), ("t", top, "top_at")):
        for k in range(count):
            own = f"(w.{place} // {16**k} % 16)"
            sides = f"substr(r, 1, 64 * {own})", f"substr(r, 64 * {own} + 65)"
            tree = "w.tree" if name == "s" else "''"
            with_.append(
                f"w{step + 1} AS (SELECT doc_id, w.tree, leaf, altered, idx, top_at, subroot, CASE WHEN m > 1 THEN proof || {sides[0]} || {sides[1]} ELSE proof END AS proof, CASE WHEN m > 1 THEN sha256({sides[0]} || f || {sides[1]}) ELSE f END AS f "
                f"FROM w{step} w JOIN {name}r{k} q ON q.tree = {tree} AND q.run = w.{place} // {16 ** (k + 1)})"
            )
            step += 1
    return f"WITH {', '.join(with_)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM w{step}, roots"


OP11_SQL = oracle()
