import hashlib
import random
import re
from collections import Counter

import pytest

from tidemark.llm import suffixes

SMALL = suffixes.Plan(length=40, gram=4, window=24, block=8)


def brute(texts, length):
    """The bytes kept of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, *range(4, 60)] * 6:
        text = [rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(n)]
        assert suffixes.suffix_array(text) == sorted(range(n), key=lambda i: text[i:]), text
    for text in ([0] * 200, [0, 1] * 150, [1, 0] * 150, list(range(100)), list(range(100, 0, -1)), [2, 1, 2, 1, 1, 2] * 40):
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_lyndon_groups():
    text = list(b"banana")
    groups, length = suffixes.lyndon_groups(text)
    assert [[bytes(text[i : i + length[i]]) for i in g] for g in groups] == [[b"a"], [b"an", b"an"], [b"b"], [b"n", b"n"]]


def test_repeated_wholes():
    rng = random.Random(3)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 7))] for _ in range(rng.randrange(0, 9))]
        sequences += rng.sample(sequences, len(sequences) // 3)
        inside = lambda x, y: sum(y[i : i + len(x)] == x for i in range(len(y)))
        assert suffixes.repeated_wholes(sequences) == [sum(inside(x, y) for y in sequences) > 1 for x in sequences]


def test_arrays_decide_and_not_hashes():
    """Places with one hash whose bytes differ are not taken for repeats, by either kind of array."""
    same, other = (b"left of it", b"right of it"), (b"left of iT", b"right of it")
    assert suffixes.confirmed([(1, 7, *same), (1, 7, *same), (1, 8, *same), (1, 8, *other)], SMALL) == [(1, 7)]
    assert suffixes.confirmed([(1, 7, *same)] * 3, SMALL) == [(1, 7)]
    assert suffixes.confirmed([], SMALL) == [] and suffixes.compare([], SMALL) == []


def test_arrays_stay_small(monkeypatch):
    """op9's CPU seconds: whole stretches entered in symbols of 16 bytes, and arrays of 4,096 of them left the cache."""
    rng, sizes, built = random.Random(8), [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda text: sizes.append(len(text)) or built(text))
    entries = [(k, k, rng.randbytes(300), rng.randbytes(300)) for k in range(50)]
    assert suffixes.confirmed(entries + entries, suffixes.Plan()) == [(k, k) for k in range(50)]
    assert sizes == [100 * (5 + 1 + 5 + 1)] and suffixes.HELD <= 256


def test_groups_whose_suffixes_all_move_stay_one():
    """Suffixes that lengthen alike are no new group, and who takes more copies still stands above."""
    rng = random.Random(9)
    for _ in range(300):
        text = [rng.randrange(rng.choice([2, 3, 4])) for _ in range(rng.randrange(30))] * rng.choice([1, 2, 3])
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("size, removed", [(300, 0), (399, 0), (400, 400), (401, 401), (500, 500), (800, 800)])
def test_planted_passages(spark, size, removed):
    """A passage in two documents goes whole from 400 bytes on, at any offset, and nothing else goes."""
    rng = random.Random(size)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    docs = []
    for k in range(12):
        passage = "<" + make(size - 2) + ">"
        docs += [(2 * k + i, make(rng.randrange(900)) + "AB"[i] + passage + "CD"[i] + make(rng.randrange(900))) for i in range(2)]
    cut = suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r.n_removed for r in cut.collect()] == [removed] * 24


def test_benchmark_passages_of_over_50_words(spark):
    """FINDINGS_r03: the given items of over 50 words have fewer than 400 bytes each, so planted they stay by contract."""
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items = [t for t in items if len(re.findall(r"[^\x20\x09-\x0D]+", t)) > 50]
    assert items and max(len(t.encode()) for t in items) < 400
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    # each in two documents: as it is, then between borders that bring what is shared to 400 bytes or 401
    texts = [make(600) + side + t + side + make(600) for t in items for side in "AB"]
    for t in items:
        border = (401 - len(t.encode())) // 2 * "<"
        texts += [make(600) + border + t + border + make(600) for _ in range(2)]
    docs = list(enumerate(texts))
    rows = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[i] for i, _ in docs] == brute([t.encode() for t in texts], 400)
    assert [rows[i][2] for i, _ in docs] == [0] * (2 * len(items)) + [1] * (2 * len(items))


def corpus(seed):
    rng = random.Random(seed)
    letters = "ab é" if seed % 2 else "the of and ion wh é"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(rng.choice([10, 39, 40, 41, 60, 90, 150])) for _ in range(8)]
    docs = []
    for _ in range(60):
        t = make(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(shared) + t[at:]
        docs.append(t)
    for t in docs[:20]:
        k = rng.randrange(len(t) + 1)
        docs.append(t[:k] + "#" + t[k + 1 :])
    docs += [docs[3], docs[4] + "z", "a" * 300, "a" * 39, "xy" * 100, "q" + "xy" * 100, "", "é" * 30]
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_against_all_windows(spark, seed):
    texts = corpus(seed)
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[7]), (6, "other"), (900, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    cut = suffixes.without_repeats(frame, SMALL)
    rows = [(r.row.doc_id, r.row.text, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut.collect()]
    want = [(i, t, *w) for (i, t), w in zip(docs, brute([(t or "").encode() for _, t in docs], 40))]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_query_and_long_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 2000, 3000)]
    texts += [texts[1][:900] + passage, passage + texts[2][:500], texts[0] + passage[100:499], "ß" * 500, passage[:399], texts[1]]
    spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.op9_suffixes(spark, str(tmp_path)).collect()}
    want = brute([t.encode() for t in texts], 400)
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in enumerate(want)}
    monkeypatch.setattr(suffixes, "CHUNK", 256)
    plan = suffixes.Plan()
    for t in texts:
        data = t.encode()
        windows = [w for _, a, z, p in suffixes.find_runs([data], plan) for x, y in zip(a.tolist(), z.tolist()) for w in range(x, y + 1)]
        assert windows == list(range(max(0, len(data) - 399)))


def test_empty_table(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_disk_texts_are_squeezed_and_tables_go(spark, tmp_path, monkeypatch):
    """What shuffles hold of a text is smaller than it, and tables of runs go as soon as nothing reads them."""
    for t in ("", "a", "ß\x00" * 300, "\ud800"):
        assert suffixes.opened_up(suffixes.squeezed(t)) == t.encode("utf-8", "surrogatepass")
    assert len(suffixes.squeezed("some words and more " * 50)) < 200
    monkeypatch.setattr("tidemark.functions.shared.shared_dir", lambda _: str(tmp_path))
    texts = corpus(1)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(r.n_removed for r in suffixes.without_repeats(frame, SMALL).collect()) == sum(w[1] for w in brute([t.encode() for t in texts], 40))
    assert {p.name.rsplit("-", 1)[0] for p in (tmp_path / "tidemark").iterdir()} == {"suffix-several", "suffix-found"}
