"""Repair of the structure of conversations: the cheapest edits that make turns alternate.

A repaired conversation reads ``system? (user assistant)+``, or is empty. Rows are kept, given another role, deleted
or inserted; each edit has a cost and a letter, and of the cheapest sequences the one whose letters are least in ASCII
order is taken, so every result is one and the same on every run.

Everything is decided by one integer for each path: its high digits are the cost, its low digits the letters, the
first one highest, in a fixed width and padded with zeros at the end; the least integer is the cheapest path and of
the cheapest the least in letters. The nodes of the graph are (row, state), the states being what a conversation may
go on with. A letter's weight depends on how many came before it, so a node would have to be split by the number of
insertions; it needs no such split, as of two paths of one cost that reach a node neither's letters begin the
other's: they take the same rows, so the longer one would add insertions alone, and these cost. So letters differ
before either ends, whatever follows.

A conversation may hold a third of all rows. Its rows are coded as one character each, and runs of ``PART`` rows are
solved apart, from every state to every state; such solutions are put together in rounds of ``FAN`` by the same
integers. Ranks come from ranges, earlier copies from minima combined before the shuffle. Texts pass once more, as a
stream in order, when the edits are known. That stream, and a digest of its whole output, is one task's work for a
conversation, in bounded memory.

Defined cases: null roles, texts and turns in the key that damages are one space; null turns come first; rows of one
turn are ordered by a hash of role and text, so copies are adjacent; all rows with a null id are one conversation;
texts count as a whole; an empty table gives no rows; other columns don't count, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.shared import keep
from tidemark.llm.chat import runs
from tidemark.llm.codes import pieces
from tidemark.operators.batching import rank_within

#: Rows of a run that is solved by itself, and solutions that are put together at a time.
PART, FAN = 1024, 16
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What a conversation has so far: nothing, a system turn, a user's or an assistant's turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
KEPT_TRUNCATED = 5
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
SPACES = r"[^\x20\x09-\x0D]"


# the graph


def code(initial: int, fault: int) -> str:
    """One character for a row: the place of its role's initial in ``sua`` (3: another), and its fault."""
    return chr(ord("A") + 4 * initial + fault)


def turn_after(state: int) -> int:
    """The one role, user's or assistant's, that may follow."""
    return ASSISTANT if state == USER else USER


def edits(row: str, state: int) -> Iterator[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of what can be done with a row."""
    initial, fault = divmod(ord(row) - ord("A"), 4)
    yield "D", COST["D"], state
    if fault in (BLANK, DUPLICATE):
        return
    more = KEPT_TRUNCATED if fault == TRUNCATED else 0
    if (initial == 0 and state == NOTHING) or initial == turn_after(state) - 1:
        yield "K", COST["K"] + more, initial + 1
    yield "R", COST["R"] + more, turn_after(state)


EDITS = {(code(i, f), s): tuple(edits(code(i, f), s)) for i in range(4) for f in range(4) for s in range(4)}

Paths = dict[int, tuple[int, int]]  # by state: the integer, and the number of letters in it


def widest(rows: int) -> int:
    """Letters that a cheapest path over so many rows can have: deleting them all costs 2 each, an insertion 5."""
    return rows + (2 * rows + 2 * COST["I"]) // COST["I"] + 2


def with_insertions(best: Paths, width: int) -> None:
    """Up to two insertions at a place; three would lead back to a state that one reaches."""
    for _ in range(2):
        for state, (weight, n) in list(best.items()):
            made = weight + (COST["I"] << 8 * width) + (ord("I") << 8 * (width - 1 - n))
            if (to := turn_after(state)) not in best or made < best[to][0]:
                best[to] = made, n + 1


def read(weight: int, width: int) -> tuple[int, str]:
    """Cost and letters of an integer."""
    return weight >> 8 * width, (weight & ((1 << 8 * width) - 1)).to_bytes(width, "big").rstrip(b"\0").decode()


def weight_of(cost: int, letters: str, width: int) -> int:
    return (cost << 8 * width) + int.from_bytes(letters.encode().ljust(width, b"\0"), "big")


def solved(rows: str, start: int) -> dict[int, tuple[int, str]]:
    """Cost and letters of the cheapest path over coded rows from a state to each that can be reached."""
    width = widest(len(rows))
    best: Paths = {start: (0, 0)}
    for row in rows:
        with_insertions(best, width)
        new: Paths = {}
        for state, (weight, n) in best.items():
            shift = 8 * (width - 1 - n)
            for letter, cost, to in EDITS[row, state]:
                made = weight + (cost << 8 * width) + (ord(letter) << shift)
                if to not in new or made < new[to][0]:
                    new[to] = made, n + 1
        best = new
    return {state: read(weight, width) for state, (weight, _) in best.items()}


def least(found: Iterable[tuple[int, str]]) -> tuple[int, str]:
    """The least of costs and letters, by one integer each."""
    found = list(found)
    width = max(len(letters) for _, letters in found)
    return read(min(weight_of(cost, letters, width) for cost, letters in found), width)


def finished(ways: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """With insertions after the last row, the cheapest way to an end."""
    width = max(len(letters) for _, letters in ways.values()) + 2
    best = {state: (weight_of(cost, letters, width), len(letters)) for state, (cost, letters) in ways.items()}
    with_insertions(best, width)
    return read(min(best[s][0] for s in ENDS if s in best), width)


def audit_of(rows: str) -> tuple[int, str]:
    return finished(solved(rows, NOTHING))


def joined(first: dict, second: dict) -> dict:
    """Ways ``{(start, end): (cost, letters)}`` over two runs of rows, one after the other."""
    made: dict[tuple[int, int], list] = {}
    for (start, mid), (cost, letters) in first.items():
        for (again, end), (more, rest) in second.items():
            if again == mid:
                made.setdefault((start, end), []).append((cost + more, letters + rest))
    return {k: least(v) for k, v in made.items()}


# rows


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults at places that a crc of id and turn fixes."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """The rows with their ``place`` in the conversation, from 1."""
    return rank_within(rows.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", F.xxhash64("role", "text")], "place")


def coded(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, place, code)``. A row is a duplicate if it isn't the first of its role and text; first places
    come from minima, and meet their rows by conversation and place, so no copy is a hot key."""
    mark = F.regexp_extract("text", rf"({SPACES})[\x20\x09-\x0D]*\z", 1)
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    facts = keep(rows.select("conv_id", "turn", "place", initial.alias("initial"), mark.alias("mark"), digest.alias("digest")), "repair-facts")
    firsts = facts.groupBy("conv_id", "digest").agg(F.min("place").alias("_place")).select(F.col("conv_id").alias("_conv"), "_place")
    met = facts.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place")), "left")
    fault = F.when(F.col("mark") == "", BLANK).when(F.col("_place").isNull(), DUPLICATE).when(~F.col("mark").isin(*".!?"), TRUNCATED).otherwise(SOUND)
    return met.select("conv_id", "turn", "place", F.chr(F.lit(ord("A")) + 4 * F.col("initial") + fault).alias("code"))


PARTS = "conv_id {0}, part long, head string, tail string, blank long, duplicate long, truncated long, illegal long, ways array<struct<start:int,end:int,cost:long,letters:string>>"
WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
KINDS = {"part": pa.int64(), "head": pa.string(), "tail": pa.string(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "ways": WAYS}
FAULTS = ("blank", "duplicate", "truncated")


def unlike(before: str, after: str) -> bool:
    """Whether two coded rows may not follow each other."""
    a, b = ((ord(x) - ord("A")) // 4 for x in (before, after))
    return a == 3 or b == 3 or INITIALS[a] + INITIALS[b] not in LEGAL


def as_part(part: int, rows: str) -> dict:
    ways = {(s, e): w for s in ((NOTHING,) if part == 0 else range(4)) for e, w in solved(rows, s).items()}
    faults = [(ord(x) - ord("A")) % 4 for x in rows]
    counts = {c: faults.count(f) for c, f in zip(FAULTS, (BLANK, DUPLICATE, TRUNCATED))}
    return {"part": part, "head": rows[0], "tail": rows[-1], "illegal": sum(map(unlike, rows, rows[1:])), "ways": ways, **counts}


def as_one(first: dict, second: dict) -> dict:
    out = {c: first[c] + second[c] for c in FAULTS} | {"part": first["part"], "head": first["head"], "tail": second["tail"]}
    return out | {"illegal": first["illegal"] + second["illegal"] + unlike(first["tail"], second["head"]), "ways": joined(first["ways"], second["ways"])}


def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ways = lambda r: [{"start": s, "end": e, "cost": c, "letters": x} for (s, e), (c, x) in r["ways"].items()]
    columns = [pa.array([c for c, _ in rows], kind), *[pa.array([ways(r) if n == "ways" else r[n] for _, r in rows], k) for n, k in KINDS.items()]]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", *KINDS])


def parts_of(rows: DataFrame) -> DataFrame:
    """Runs of PART coded rows, each with its ways from every state."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "")
    runs_ = rows.groupBy("conv_id", F.floor((F.col("place") - 1) / PART).alias("part")).agg(text.alias("rows"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            made = [(c, as_part(p, r)) for c, p, r in zip(*(b.column(x).to_pylist() for x in ("conv_id", "part", "rows")))]
            yield batch(made, b.schema.field("conv_id").type)

    return runs_.mapInArrow(solve, PARTS.format(kind))


def put_together(parts: DataFrame) -> DataFrame:
    """One round: FAN neighbouring parts of a conversation become one."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = key = None
        for b in pieces(batches, 64):
            out, arrow = [], b.schema.field("conv_id").type
            for r in b.select([*b.schema.names]).to_pylist():
                r["ways"] = {(w["start"], w["end"]): (w["cost"], w["letters"]) for w in r["ways"]}
                now = r["conv_id"], r["part"] // FAN
                if now == key:
                    held = as_one(held, r)
                else:
                    if key is not None:
                        out.append((key[0], held | {"part": key[1]}))
                    key, held = now, r
            yield batch(out, arrow)
        if key is not None:
            yield batch([(key[0], held | {"part": key[1]})], arrow)

    dealt = parts.withColumn("_group", F.floor(F.col("part") / FAN)).repartition("conv_id", "_group").sortWithinPartitions("conv_id", "_group", "part").drop("_group")
    return dealt.mapInArrow(merge, PARTS.format(kind))


def audits(rows: DataFrame) -> DataFrame:
    """``(conv_id, blank, duplicate, truncated, illegal, cost, audit)`` of coded rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    parts = keep(parts_of(rows), "repair-parts")
    while parts.agg(F.max("part")).first()[0]:
        parts = keep(put_together(parts), "repair-parts")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ends = [finished({w["end"]: (w["cost"], w["letters"]) for w in ways if w["start"] == NOTHING}) for ways in b.column("ways").to_pylist()]
            same = [b.column(c) for c in ("conv_id", *FAULTS, "illegal")]
            yield pa.RecordBatch.from_arrays([*same, pa.array([c for c, _ in ends], pa.int64()), pa.array([x for _, x in ends], pa.string())], ["conv_id", *FAULTS, "illegal", "cost", "audit"])

    return parts.mapInArrow(finish, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(role, text, letter)`` of the repaired conversation; rows are used up as they come."""
    state = NOTHING
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K":
            state = INITIALS.index(role[0]) + 1
        else:
            state = turn_after(state)
            role = "user" if state == USER else "assistant"
        yield role, text, letter


def repaired(rows: DataFrame, found: DataFrame, most: int = 1 << 21) -> DataFrame:
    """``(conv_id, place, role, text, edit)``: the rows of repaired conversations, in order within each partition.

    ``rows`` are those of ``placed``, ``found`` those of ``audits``; the audit leads its conversation's rows in the stream.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    both = rows.select("conv_id", "place", "role", "text").unionByName(found.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text")))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.int64()

        def turns() -> Iterator[tuple]:
            nonlocal arrow
            for b in pieces(batches):
                arrow = b.schema.field("conv_id").type
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (arrow, pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text", "edit"])

        for conv, mine in runs(turns()):
            _, audit = next(mine)
            for place, (role, text, letter) in enumerate(edited(audit, mine), 1):
                out.append((conv, place, role, text, letter))
                size += len(text) + 64
                if size > most:
                    yield flush()
                    out, size = [], 0
        yield flush()

    return both.mapInArrow(edit, f"conv_id {kind}, place long, role string, text string, edit string")


def digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of repaired rows as they come, in the tasks that made them."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.int64()

        def turns() -> Iterator[tuple]:
            nonlocal arrow
            for b in batches:
                arrow = b.schema.field("conv_id").type
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        out = []
        for conv, mine in runs(turns()):
            sha, between = hashlib.sha256(), ""
            for role, text in mine:
                sha.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
            out.append((conv, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], arrow), pa.array([x for _, x in out], pa.string())], ["conv_id", "repaired_sha256"])

    return rows.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def gaps(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps)``: turns missing between the first and the last."""
    wide = lambda c: c.cast("decimal(20,0)")
    seen = rows.groupBy("conv_id").agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.countDistinct("turn")).alias("gaps"))
    return seen.select("conv_id", F.coalesce(F.col("gaps").try_cast("long"), F.lit(0)).cast("long").alias("gaps"))


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each of ``ids(conv_id)``: faults, cost and audit of the repair of ``rows``, and its digest."""
    known: Column = F.lit(hashlib.sha256(b"").hexdigest())
    at = placed(rows)
    codes = keep(coded(at), "repair-codes")
    found = keep(audits(codes.select("conv_id", "place", "code")), "repair-audits")
    out = ids.select("conv_id").distinct()
    for k, more in enumerate((found, gaps(codes), digests(repaired(at, found)))):
        more = more.withColumnRenamed("conv_id", f"_id{k}")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col(f"_id{k}")), "left").drop(f"_id{k}")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", known).alias("repaired_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(damaged(table), table)
