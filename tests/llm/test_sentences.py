import random
import re

from tidemark.llm import sentences


def split(text):
    out = []
    sentence, piece = sentences.patterns()
    for s in re.findall(sentence, text):
        out += [s] if len(s) <= 100 else re.findall(piece, s)
    assert "".join(out) == text
    return out


def brute(docs):
    """Texts after the cut, for distinct (id, text) pairs."""
    docs = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    seen, gone = {}, {}
    for d in docs:
        keys = [p.strip(" \t\n\r") for p in split(d[1] or "")]
        for i in range(len(keys) - 2):
            run = tuple(keys[i : i + 3])
            if run in seen:
                gone.setdefault(d, set()).update((i, i + 1, i + 2))
            seen.setdefault(run, (d, i))
    return {d: "".join(p for i, p in enumerate(split(d[1] or "")) if i not in gone.get(d, ())) for d in docs}


def test_against_plain_python(spark):
    rng = random.Random(3)
    lines = [f"Sentence {i} says {'word ' * rng.randrange(1, 30)}{i}" + rng.choice([". ", "!\n", "?  ", "\n\n"]) for i in range(25)]
    docs = [(i, "".join(rng.choices(lines, k=rng.randrange(0, 12)))) for i in range(60)]
    docs += [(300 + i, "".join(rng.choice("abgkxé ю日本語のですがกา。؟.\n  ") for _ in range(rng.randrange(900)))) for i in range(20)]
    docs += [(100, None), (101, ""), (102, "\n\n. ! "), (103, "no marks at all " * 40), (104, "no marks at all " * 40), (None, "".join(lines[:6])), (105, "".join(lines[:6]) + "tail")]
    frame = spark.createDataFrame([(*d, 1) for d in docs] + [(3, docs[3][1], 2)], "doc_id long, text string, tie int")
    got = sentences.remove_repeats(frame)
    want = brute(docs)
    assert got.columns == frame.columns
    rows = [(r.doc_id, r.text or "") for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(d[0], want[d]) for d in docs] + [(3, want[docs[3]])]))
    parted = sentences.remove_repeats(frame, most_met=2)  # frequent spans fall into parts
    assert sorted(map(str, ((r.doc_id, r.text or "") for r in parted.collect()))) == sorted(map(str, rows))
    assert sum(len(t) for _, t in rows) < sum(len(t or "") for _, t in docs)
    assert sentences.remove_repeats(frame.limit(0)).count() == 0


def test_very_long_text(spark):
    long = "".join(f"Sentence number {i} of a long text. " for i in range(30_000))
    rows = [(1, "Own start of it. " + long), (2, long + "Own end of it.")]
    got = {r.doc_id: r.text for r in sentences.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Own end of it."}


def test_unmarked_passages_at_any_offset(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstux") for _ in range(rng.randrange(2, 9)))
    shared = " ".join(word() for _ in range(90))
    docs = [(i, " ".join(word() for _ in range(40 + i)) + " " + shared + " " + " ".join(word() for _ in range(30))) for i in (1, 3, 8)]
    han = "".join(chr(rng.randrange(0x4E00, 0x6000)) if rng.random() < 0.93 else rng.choice("的是在不") for _ in range(700))
    docs += [(20 + i, "".join(chr(rng.randrange(0x6000, 0x8000)) for _ in range(50 + 7 * i)) + han) for i in range(3)]
    docs += [(40, "Ist das so? 是的。 " * 3 + "好。", )]
    got = {r.doc_id: r.text for r in sentences.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d[0]: brute(docs)[d] for d in docs}
    text = dict(docs)
    assert got[1] == text[1] and got[20] == text[20]
    assert all(len(shared) - (len(text[i]) - len(got[i])) < 200 for i in (3, 8)) and all(len(text[i]) - len(got[i]) > 560 for i in (21, 22))
