import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, place long, code string"
SHAPE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def dearest(rows):
    """All edit sequences with at most two insertions at a place, by plain enumeration of the results."""
    kinds = faults(rows)
    best = None
    places = [("", *("I" * k for k in (1, 2)))] * (len(rows) + 1)
    choices = [["D"] if k in ("blank", "duplicate") else ["D", "K", "R"] for k in kinds]
    for put in itertools.product(*places):
        for done in itertools.product(*choices):
            audit = "".join(a + b for a, b in zip(put, (*done, "")))
            cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] for c in audit) + 5 * sum(d != "D" and k == "truncated" for d, k in zip(done, kinds))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            kept = [(c, r) for c, r in zip((c for c in audit if c != "I"), rows)]
            source = iter(kept)
            made = [next(source) if c != "I" else ("I", ("", "")) for c in audit]
            made = [(c, r) for c, r in made if c != "D"]
            free = [i for i, (c, _) in enumerate(made) if c != "K"]
            for roles in itertools.product(("user", "assistant"), repeat=len(free)):
                out = [list(r) for _, r in made]
                for i, role in zip(free, roles):
                    out[i][0] = role
                if SHAPE.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                    best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
                    break
    return best


def plain(rows):
    """The report of whole conversations, the repair by a table of (cost, letters) for each state."""
    by = {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(c, [])
        blank = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{blank(c)}:{blank(turn)}".encode()) % 20
        role, text = "user" if k == 4 else blank(role), "" if k == 1 else re.sub("[.!?]", "", blank(text)) if k == 2 else blank(text)
        by[c] += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return by


def damaged_rows():
    rng = random.Random(5)
    texts = ["Yes.", "no", "Why?", "", "  ", "ok!\n", "é", "Fine. ", None, "x" * 200_000 + "."]
    roles = ["system", "user", "assistant", "tool", "", None, "Uper"]
    rows, turn = [], {}
    for _ in range(700):
        c = rng.choice([None, *range(120)])
        turn[c] = turn.get(c, 0) + rng.choice([1, 1, 1, 3])
        rows.append((c, turn[c], rng.choice(roles), rng.choice(texts), 9, "clash"))
    rows += [(500, None, "user", "Hi.", 1, ""), (500, None, "user", "Hi.", 1, "")]
    return rows + [(i, 0, "user", "Alone.", 1, "") for i in range(501, 561)]  # some lose their only row


def order(spark, rows):
    """The order of rows of one turn is that of a hash."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, r, t) for i, (_, r, t) in enumerate(rows)], "i int, role string, text string")
    hashes = [r.h for r in frame.select("i", F.xxhash64("role", "text").alias("h")).orderBy("i").collect()]
    return [(r, t) for _, _, _, r, t in sorted((k is not None, k or 0, h, r, t) for (k, r, t), h in zip(rows, hashes))]


def table_repair(rows):
    """Cost and letters by a table over (row, state, number of insertions)."""
    kinds, best = faults(rows), {("", 0): (0, "", [])}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    limit = 2 * len(rows) // 5 + 2

    def insert(best):
        for k in range(limit):
            for (q, n), (c, x, out) in list(best.items()):
                if n == k:
                    to, made = (after[q], n + 1), (c + 5, x + "I", out + [("user" if after[q] == "u" else "assistant", "")])
                    if to not in best or made[:2] < best[to][:2]:
                        best[to] = made
        return best

    for (role, text), kind in zip(rows, kinds):
        new = {}

        def put(to, made):
            if to not in new or made[:2] < new[to][:2]:
                new[to] = made

        for (q, n), (c, x, out) in insert(best).items():
            put((q, n), (c + 2, x + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            more = 5 * (kind == "truncated")
            if role[:1] == after[q] or (role[:1] == "s" and q == ""):
                put((role[:1], n), (c + more, x + "K", out + [(role, text)]))
            put((after[q], n), (c + 1 + more, x + "R", out + [("user" if after[q] == "u" else "assistant", text)]))
        best = new
    return min((v for (q, _), v in insert(best).items() if q in ("", "a")), key=lambda v: v[:2])


@pytest.mark.parametrize("seed", range(40))
def test_small_conversations_against_all_edits(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "no", "", "A!"])) for _ in range(rng.randrange(5))]
    cost, audit, text = dearest(rows)
    codes = "".join(R.code({"s": 0, "u": 1, "a": 2}.get(r[:1], 3), ["", "blank", "duplicate", "truncated"].index(f)) for (r, _), f in zip(rows, faults(rows)))
    assert R.audit_of(codes) == (cost, audit)
    assert "\n".join(f"{r}:{t}" for r, t, _ in R.edited(audit, iter(rows))) == text
    assert table_repair(rows)[:2] == (cost, audit)


def test_runs_put_together_are_the_whole():
    rng = random.Random(3)
    for _ in range(150):
        codes = "".join(rng.choice("ABDEFHIKLMPEIEI") for _ in range(rng.randrange(1, 60)))
        cuts = sorted(rng.randrange(len(codes) + 1) for _ in range(3))
        runs = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)]) if a < b]
        whole = R.as_part(0, runs[0])
        for k, run in enumerate(runs[1:], 1):
            whole = R.as_one(whole, R.as_part(k, run))
        assert R.finished({e: w for (s, e), w in whole["ways"].items() if s == R.NOTHING}) == R.audit_of(codes)
        assert whole["illegal"] == sum(map(R.unlike, codes, codes[1:]))


def checked(spark, rows, got):
    by = plain(rows)
    assert len(got) == len(by)
    for r in got:
        turns = [t for t, _, _ in by[r.conv_id] if t is not None]
        mine = order(spark, by[r.conv_id]) if by[r.conv_id] else []
        cost, audit, out = table_repair(mine)
        kinds = faults(mine)
        initials = [x[:1] or "-" for x, _ in mine]
        want = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest(),
        )
        assert tuple(r)[1:] == want, r.conv_id


def test_query_against_a_table(spark, tmp_path):
    rows = damaged_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    frame = R.op13_repair(spark, str(tmp_path))
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = frame.collect()
    checked(spark, rows, got)
    assert any(r.audit == "" for r in got) and all(any(x in r.audit for r in got) for x in "DKR")


def test_one_long_conversation_in_parts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, i, rng.choice(["user", "assistant", "tool"]), rng.choice([f"T{i}.", f"t{i}", "same.", "", "ok"]), 0, "") for i in range(2 * R.PART + 300)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    (got,) = R.op13_repair(spark, str(tmp_path)).collect()
    damaged = R.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    mine = [(r.role, r.text) for r in R.placed(damaged).orderBy("place").collect()]
    kinds = faults(mine)
    codes = "".join(R.code({"s": 0, "u": 1, "a": 2}.get(r[:1], 3), ["", "blank", "duplicate", "truncated"].index(f)) for (r, _), f in zip(mine, kinds))
    assert (got.cost, got.audit) == R.audit_of(codes) and got.duplicate == kinds.count("duplicate")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert R.op13_repair(spark, str(tmp_path)).collect() == []
