import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontam, test_mixing, test_simhash

WORDS = {"en": "the house with that thing is there and which they should gone river".split(), "fr": "le être avec maison est où cette dans vous nous rivière jamais".split()}


def make(spark, path):
    rng = random.Random(11)
    rows, items = [], []
    sentence = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + str(rng.choice(["", "s", "e", "x"])) for _ in range(n))
    for i in range(150):
        lang = ["en", "fr"][i % 2]
        rows.append((i, sentence(lang, rng.randrange(40, 90)), lang, ["a", "b", None][i % 3], 0))
    items = [(k, sentence("en", 30)) for k in range(4)]
    for k in range(4):
        rows.append((200 + k, rows[k][1], "en", "a", 0))  # copies
        rows.append((300 + k, f"{sentence('en', 20)} {items[k][1]} {sentence('en', 20)}", "en", "b", 0))
        rows.append((400 + k, [None, "", "12 34 !!", "\n"][k], None, "a", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_stages_against_plain_python(spark, tmp_path):
    rows, items = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    first = sorted((r[0], r[1]) for r in rows if r[0] < 400)
    assert seen[0] == first
    prints = {i: test_simhash.brute_fingerprint(t) for i, t in first}
    groups = test_simhash.brute_groups(prints)
    second = [(i, t) for i, t in first if groups[i] == i]
    assert seen[1] == second and len(second) <= len(first) - 4
    bad = {d for d, _ in test_decontam.brute(second, items)}
    third = [(i, t) for i, t in second if i not in bad]
    assert seen[2] == third and len(bad) == 4
    source = {r[0]: r[3] for r in rows}
    sizes, taken, copies = {}, {}, {}
    for i, t in third:
        sizes[source[i]] = sizes.get(source[i], 0) + len(t.split())
    for i, t in seen[3]:
        taken[source[i]] = taken.get(source[i], 0) + len(t.split())
        copies[i] = copies.get(i, 0) + 1
    targets = test_mixing.water(sizes, (3, 1, 2), 1.5, 2.0)
    assert max(copies.values()) <= 2 and all(abs(taken[s] - t) < 200 for s, t in targets.items())
    got = sorted(corpus_pipeline.records(spark, docs, str(tmp_path)).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want, at = [], 0
    for i, t in seen[3]:
        ids = plain.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert whole == want
