import pytest

from tidemark.llm import mixing


def water(sizes, weights, share, cap):
    """Targets by repeated resharing of what is over a cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= cap * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def docs(spark, n=900):
    rows = [(i, "w " * (1 + i * i % 137), ["a", "b", None, "É", "c", "a", "a"][i % 7], i) for i in range(n)]
    rows += [(9001, None, "empty", 0), (9002, " \t ", "empty", 0), (9003, "x", "z", 1), (9003, "x", "z", 1), (None, "x y", "z", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_words_and_caps(spark):
    rows = mixing.mix(docs(spark), columns=["doc_id", "source"]).select("row.*", "size", "source_size", "target", "copies").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = water(sizes, (3, 1, 2), 1.5, 2.0)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(137, 0.02 * t), s
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_and_partitions_agree(spark):
    once = sorted(map(str, mixing.mixed_documents(docs(spark)).collect()))
    again = sorted(map(str, mixing.mixed_documents(docs(spark).repartition(7)).collect()))
    assert once == again
    assert mixing.mixed_documents(docs(spark)).columns == ["doc_id", "text", "source", "size"]


def test_empty_table(spark):
    assert mixing.mix(docs(spark).limit(0)).count() == 0


def test_large_sizes_in_parts_and_long_texts(spark):
    table = docs(spark).union(spark.createDataFrame([(8000, "word " * 200_000, "long", 0)], "doc_id long, text string, source string, size int"))
    key = lambda rows: sorted(str((r.row.doc_id, r["size"], r.copies, r.target)) for r in rows.collect())
    assert key(mixing.mix(table, most_ranked=3)) == key(mixing.mix(table))
