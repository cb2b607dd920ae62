import itertools
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import langid

WORDS = {"en": "the house with that thing is there and which they should".split(), "fr": "le être avec maison est où cette dans vous nous".split(), "ru": "это дом где который быть они тогда если".split(), "uk": "це дім де який бути вони тоді якщо їхній".split()}


def make(spark, n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 4]
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(8, 30))), lang if i % 5 else None, 1.0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(make(spark))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = np.round(rng.normal(size=(rng.integers(1, 6), 3)) * 3, 2)
        got = langid.viterbi(scores, 2.5)
        worth = lambda p, s=scores: sum(s[i, x] for i, x in enumerate(p)) - 2.5 * sum(a != b for a, b in itertools.pairwise(p))
        assert worth(got) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=len(scores)))))


def test_viterbi_without_the_best_sum():
    assert langid.viterbi(np.array([[0.0, -30, -10], [-30, 0, -10]]), 12).tolist() == [0, 1]
    rng = np.random.default_rng(2)
    worth = lambda p, s: sum(s[i, x] for i, x in enumerate(p)) - 12 * sum(a != b for a, b in itertools.pairwise(p))
    for _ in range(300):  # each word has a language of its own, and a third one is near all of them
        n = rng.integers(2, 5)
        scores = np.full((n, 4), -30.0) + rng.integers(-5, 6, (n, 4))
        scores[np.arange(n), np.sort(rng.integers(0, 3, n))] = 0
        scores[:, 3] = rng.integers(-12, -5, n)
        assert worth(langid.viterbi(scores, 12), scores) == max(worth(p, scores) for p in itertools.product(range(4), repeat=n))


def test_held_out_accuracy_and_columns(spark, model):
    rows = langid.identify(make(spark), model).select("row.doc_id", "lang_pred", "score").collect()
    right = [r.lang_pred == list(WORDS)[r.doc_id % 4] for r in rows]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    for r in make(spark).select("doc_id", langid.held_out(langid.F.col("doc_id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_spans_of_mixed_text(model):
    text = " ".join(WORDS["en"] * 3) + ". " + " ".join(WORDS["ru"] * 2)
    (lang, score, spans), = langid.predict(model, [text])
    assert lang == "en" and [s["lang"] for s in spans] == ["en", "ru"]
    assert text[spans[1]["start"] : spans[1]["end"]] == " ".join(WORDS["ru"] * 2) and 0.5 < score < 1


def test_odd_texts(model):
    got = list(langid.predict(model, [None, "", " 123 !? \n", "日本語", "the house 日本語 with", "́", "a", "é" * 300_000, "x\ud800y"]))
    assert [g[:2] for g in got[:3]] == [("und", 0.0)] * 3 and got[3][0] in WORDS and got[3][1] == 0
    assert got[4][:2] == ("en", 1.0) and got[5][0] == "und" and all(g[0] in WORDS for g in got[6:])


def test_stage_and_empty_tables(spark):
    docs = make(spark).union(spark.createDataFrame([(900, "123 --", None, 0.0), (901, None, "en", 0.0), (None, "le être avec maison", "fr", 0.0), (4, "the house with that", "en", 9.0)], "doc_id long, text string, lang string, score double"))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 242
    assert langid.fit(docs.limit(0)) is None
    assert langid.identify(docs.limit(0), None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.limit(5), None).collect()} == {"und"}


def plain_prediction(model, text):
    """Language and score by plain Python over characters: words, trigram scores, the full recursion."""
    lower, kind = langid.tables()
    low = [0 if kind[ord(c)] == langid.NUMBER else int(lower[ord(c)]) for c in text]
    at = lambda i: low[i] if 0 <= i < len(low) else 0
    full = 0xFFFFFFFF

    def bucket(i):
        h = low[i] * 0x9E3779B1 & full ^ at(i - 1) * 0x85EBCA77 & full
        h = h + (at(i + 1) * 0xC2B2AE3D & full ^ at(i + 1) << 7 & full) & full
        return ((h ^ h >> 15) * 0x27D4EB2F & full) >> 32 - model.bits

    words, i = [], 0
    while i < len(low):
        j = i
        while j < len(low) and low[j]:
            j += 1
        if j > i:
            script = next((k for k, ranges in enumerate(langid.SCRIPTS.values(), 1) if any(a <= ord(text[i]) <= z for a, z in ranges)), 0)
            words.append(sum(model.scores[bucket(p)].astype(float) for p in range(i, j)) + model.scripts[script] if model.known[script] else np.zeros(len(model.langs)))
        i = j + 1
    if not words or not any(map(str.isalpha, text)):
        return "und", 0.0
    state, came = words[0], []
    for w in words[1:]:
        top = int(np.argmax(state))
        came.append([top if state[top] - model.penalty > state[x] else x for x in range(len(state))])
        state = np.array([max(state[x], state[top] - model.penalty) for x in range(len(state))]) + w
    path = [int(np.argmax(state))]
    for step in reversed(came):
        path.append(step[path[-1]])
    says = [bool(np.any(w)) for w in reversed(words)]
    count = [sum(s for p, s in zip(path, says) if p == x) for x in range(len(state))]
    return model.langs[int(np.argmax(count))], max(count) / sum(says)


def test_query_against_plain_python_and_held_out_rows(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.op3_langid(spark, folder).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    model = langid.fit(docs)
    right = total = 0
    for r in rows:
        found = got[r.doc_id]
        assert found.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if len(r.text or "") < 4000:
            lang, score = plain_prediction(model, r.text or "")
            assert (found.lang_pred, found.score) == (lang, pytest.approx(score)), r.doc_id
        if found.held_out and r.lang is not None and found.lang_pred != "und":
            total += 1
            right += found.lang_pred == r.lang
    assert total > 20 and right / total > 0.95


def test_many_languages_are_all_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_CELLS", 1 << 15)
    rng = random.Random(8)
    names = [f"l{k:02d}" for k in range(60)]
    own = {n: ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(12)] for n in names}
    rows = [(i, " ".join(rng.choices(own[names[i % 60]], k=20)), names[i % 60]) for i in range(1200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == names and model.bits == 9
    assert np.mean([g[0] == r[2] for g, r in zip(langid.predict(model, [r[1] for r in rows]), rows)]) > 0.95
