import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokens

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [None, "", " \n", "Hello, World. hello world", "don't we'll it's l'amour 's", "É́ É ç̧a ＡＢ", "a\x1cb c\x1fd", "x<|endoftext|>y <|start", "...a.. b,c ,d. e., f.",
         "tab\tnb\xa0sp  wide　x\x85y", "日本語 текст ΑΣ Σ ΟΔΟΣ.", "İstanbul Ǆ ŉ ﬃ straße ẞ", "1234 5a b6,", "word " * 30000, "µº ª Ⅷ x² ½", "zero\x00nul", "é. a,"]


def test_word_memory_equals_whole_text_encoding():
    enc, plain = tokens.Encoder(PATH, True), Tokenizer.from_file(PATH)
    enc.MOST = 50
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("aB é.,'\n\t́Σİ1-ß—") for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["Of the ÉTÉ, été. Straße, ÿ µm ªb"] * 2
    for at in range(0, len(texts), 7):
        for t, x in zip(texts[at : at + 7], enc(texts[at : at + 7]), strict=True):
            assert np.frombuffer(x, enc.kind).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_records_round_trip_and_damage():
    made = [(5, [1, 2, 3]), (None, [70000]), (-2, [])]
    data = b"".join(tokens.frame(tokens.pack(i, np.array(x, "<u4").tobytes(), True)) + b"\n" for i, x in made)
    assert [(i, x.tolist()) for _, _, i, x in tokens.records(data)] == made
    for at in (0, 9, 15, 25, len(data) - 3):
        with pytest.raises(ValueError):
            list(tokens.records(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :]))
    with pytest.raises(ValueError):
        list(tokens.records(data[:-1]))


def test_files_against_plain_encoding(spark, tmp_path):
    rows = [(i * 7 % 100, t, -1) for i, t in enumerate(TEXTS * 3)] + [(None, "null id", 0), (7, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = tokens.write_tokens(docs, f"file://{tmp_path}/t", PATH, by_word=True, shard_bytes=40000)
    plain = Tokenizer.from_file(PATH)
    got = sorted(tokens.token_rows(spark, path).collect(), key=lambda r: r.start)
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        assert any(r.n_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r.doc_id])
        at += r.n_tokens
    shuffled = tokens.read_shuffled(spark, path, 3).collect()
    assert sorted(map(str, (list(r.ids) for r in shuffled))) == sorted(str(x) for xs in ids.values() for x in xs)
    assert [r.doc_id for r in shuffled] != [r.doc_id for r in got]
    assert [r.position for r in shuffled] == [r.position for r in tokens.read_shuffled(spark, path, 3).collect()]


def test_reads_by_offset_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of many") for i in range(200)], "doc_id long, text string")
    path = tokens.write_tokens(docs, f"file://{tmp_path}/t", PATH, by_word=True, shard_bytes=2000)
    index = {r.doc_id: r for r in spark.read.parquet(f"{path}/index").collect()}
    chosen = [3, 77, 150]
    for f in (tmp_path / "t" / "records").rglob("part-*"):  # spoil every byte of every other record
        data, place = bytearray(f.read_bytes()), tuple(int(x) for x in re.search(r"file=(\d+)/part-(\d+)", str(f)).groups())
        hold = [(r.offset, r.offset + r.length) for i in chosen if ((r := index[i]).file, r.shard) == place]
        keep = bytearray(b"\xff" * len(data))
        for a, z in hold:
            keep[a:z] = data[a:z]
        f.write_bytes(keep)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    wanted = spark.createDataFrame([(k, (r := index[i]).shard, r.file, r.offset, r.length) for k, i in enumerate(chosen)], "position long, shard int, file int, offset long, length long")
    plain = Tokenizer.from_file(PATH)
    for most in (10, 1):  # broadcast and joined
        got = sorted(tokens.read_at(spark, path, wanted, most).collect())
        assert [(r.position, r.doc_id, r.ids) for r in got] == [(k, i, plain.encode(f"text {i} of many", add_special_tokens=False).ids + [1]) for k, i in enumerate(chosen)]
    assert tokens.read_at(spark, path, wanted.limit(0)).count() == 0
    with pytest.raises(Exception, match="bad record"):
        tokens.read_records(spark, path).collect()


def test_bytes_read_are_those_of_the_records(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(3000)], "doc_id long, text string").coalesce(1)
    path = tokens.write_tokens(docs, f"file://{tmp_path}/t", PATH, by_word=True)
    (file,) = (tmp_path / "t" / "records").rglob("part-*")
    index = spark.read.parquet(f"{path}/index").sort("offset").collect()
    chosen = [index[i] for i in (2999, 5, 1500)]

    class Counted:
        bytes = 0

        def read_at(self, n, offset):
            self.bytes += n
            with open(file, "rb") as f:
                f.seek(offset)
                return f.read(n)

    handle = Counted()
    got = list(tokens.records_at(handle, [{"position": k, "offset": r.offset, "length": r.length} for k, r in enumerate(chosen)]))
    assert [(k, i) for k, i, _ in got] == [(1, 5), (2, 1500), (0, 2999)]
    assert handle.bytes == sum(r.length for r in chosen) < file.stat().st_size / 500

    wanted = spark.createDataFrame([(k, r.shard, r.file, r.offset, r.length) for k, r in enumerate(chosen)], "position long, shard int, file int, offset long, length long")
    sought = sorted(tokens.read_at(spark, path, wanted).collect())
    assert [r.doc_id for r in sought] == [2999, 5, 1500]
    monkeypatch.setattr(tokens, "opener", lambda path: None)  # a store that only Spark's readers can open
    assert sorted(tokens.read_at(spark, path, wanted).collect()) == sought


def test_part_of_a_seeded_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    path = tokens.write_tokens(docs, f"file://{tmp_path}/t", PATH, by_word=True)
    whole = tokens.read_shuffled(spark, path, 5).collect()
    assert len(whole) == 60
    part = tokens.read_shuffled(spark, path, 5, whole[10].position, whole[29].position).collect()
    assert part == whole[10:30]


def test_one_id_and_long_texts_fall_into_several_shards_and_files(spark, tmp_path):
    rows = [(None, "the same text again")] * 300 + [(5, "word " * 5000)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = tokens.write_tokens(docs, f"file://{tmp_path}/t", PATH, by_word=True, shard_bytes=30000, file_bytes=15000)
    index = spark.read.parquet(f"{path}/index").collect()
    assert len({r.shard for r in index if r.doc_id is None}) > 1 and len({(r.shard, r.file) for r in index if r.doc_id == 5}) == 4
    got = sorted(tokens.token_rows(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, 5001 if r.doc_id else 5)
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None] * 300 + [5] * 4


def test_words_are_forgotten_in_time():
    enc, plain = tokens.Encoder(PATH, True), Tokenizer.from_file(PATH)
    enc.SLOTS, enc.MOST, enc.PORTION, enc.LONG = 1 << 10, 200, 400, 5
    enc.forget()
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdeÉß,.1") for _ in range(rng.choice([1, 3, 6, 15, 16, 40]))) for _ in range(60))
        assert np.frombuffer(enc([text])[0], enc.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert enc.words <= 200 + 400


def test_empty_table(spark):
    assert tokens.encoded_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
