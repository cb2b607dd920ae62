import hashlib
import zlib

import pytest

from tidemark.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at int"


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, at):
    path = []
    for run in levels[:-1]:
        first = at // 16 * 16
        path.append(("".join(run[first:at]), "".join(run[at + 1 : first + 16])))
        at //= 16
    return path


def brute(rows):
    """By recursion over whole lists."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([d for _, _, d in sorted((r[0] is not None, r[0] or 0, leaf(r[:5])) for r in groups[s])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    root = top[-1][0] if top[-1] else None
    out = []
    for k, s in enumerate(order):
        kept = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[:5])))
        for i, r in enumerate(kept):
            path = path_of(trees[s], i) + path_of(top, k)
            own = folded = leaf(r[:5])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                folded = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((r[0], own, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def documents():
    rows = [(i, "hot", "en", 3, f"Text {i}", "clash", i) for i in range(4500)]  # more than one segment
    rows += [(i, f"s{i % 40}", None, None, ["é Ä Z", "", None, "z" * 300_000 + "Q"][i % 4], None, 0) for i in range(5000, 5200)]
    rows += [(7, None, "de", 1, "A", "x", 1)] * 3 + [(None, None, "de", 1, "B", "x", 1), (None, None, None, None, None, None, None), (1, "", "é", 1, "lone", "", 2)]
    rows += [(i, "s16", "en", 1, "T", "", 1) for i in range(9000, 9011)]  # full runs of 16
    return rows


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("merkle")
    spark.createDataFrame(documents(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query_against_recursion(spark, folder):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in M.op11_merkle(spark, folder).collect()), key=str)
    want = sorted(brute(documents()), key=str)
    assert got == want
    assert {r[6] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 255, 256, 257, 272, 4095, 4096, 4097, 5000, 70_000])
def test_places_are_those_of_one_builder(n):
    one = M.Builder()
    for i in range(n):
        one.append(str(i))
    nodes = one.seal(M.height(n))
    levels = levels_of([str(i) for i in range(n)])
    placed = {M.position(k, i, n): d for k, level in enumerate(levels) for i, d in enumerate(level)}
    assert [placed[i] for i in range(len(placed))] == nodes


def test_log_of_many_builders_is_that_of_one(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = M.manifest(docs, F.col("source"), F.col("doc_id"), M.leaf_of(F.col("doc_id")))
    rows = [r for r in M.log(found).collect() if r.tree == "=hot"]
    one = M.Builder()
    for i in range(4500):
        one.append(leaf((i,)))
    assert [r.digest for r in sorted(rows, key=lambda r: r.position)] == one.seal(M.height(4500)) and len({r.position for r in rows}) == len(rows)


def test_a_proof_shows_any_change():
    levels = levels_of([sha(str(i)) for i in range(300)])
    for at in (0, 17, 255, 256, 299):
        path = path_of(levels, at)
        assert M.fold(sha(str(at)), path) == levels[-1][0] and M.fold(sha("other"), path) != levels[-1][0]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert M.op11_merkle(spark, str(tmp_path)).collect() == []
