"""Corpora that grow by archives, shards against their manifest, settings with odd texts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.parsing import flattened
from tidemark.sources.corpus import Conflict, Corpus, Refused, rows_digest
from tidemark.sources.stores import shard_records, validate_shards

SCHEMA = "id long, text string, archive string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i}", f"a{i % 3}") for i in range(60)], SCHEMA)


def ids(corpus):
    return sorted((r.id, r.text, r.archive) for r in corpus.read().collect())


def test_archives_come_once_and_changes_are_refused(spark, tmp_path, rows):
    corpus = Corpus(spark, f"file://{tmp_path}/c", rows.schema)
    assert corpus.read().count() == 0
    assert corpus.append(rows.filter("archive <> 'a2'"), {"least": 3}) == ["a0", "a1"]
    assert corpus.append(rows.repartition(7), {"least": 3}) == ["a2"]
    assert corpus.append(rows, {"least": 3}) == [] and corpus.version() == 2
    want = ids(corpus)
    assert want == sorted((r.id, r.text, r.archive) for r in rows.collect())
    with pytest.raises(Refused, match="different selection"):
        corpus.append(rows, {"least": 4})
    with pytest.raises(Refused, match="different selection"):
        corpus.append(rows.withColumn("archive", F.lit("new")), {"least": 4})
    extra = spark.createDataFrame([(99, "more", "a1")], SCHEMA)
    for changed in (rows.union(extra), rows.filter("id <> 7"), rows.withColumn("text", F.coalesce("text", F.lit(""))), rows.union(rows.filter("id = 4"))):
        with pytest.raises(Refused, match="other content"):
            corpus.append(changed, {"least": 3})
    with pytest.raises(Refused, match="without an archive"):
        corpus.append(rows.withColumn("archive", F.lit(None).cast("string")), {"least": 3})
    assert ids(corpus) == want and corpus.version() == 2


def test_a_crash_between_write_and_commit_leaves_the_corpus(spark, tmp_path, rows, monkeypatch):
    corpus = Corpus(spark, f"file://{tmp_path}/c", rows.schema)
    corpus.append(rows.filter("archive = 'a0'"), {})
    want = ids(corpus)
    with monkeypatch.context() as m:
        m.setattr(Corpus, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            corpus.append(rows, {})
    assert ids(corpus) == want
    assert corpus.append(rows, {}) == ["a1", "a2"] and len(ids(corpus)) == 60


def test_of_two_writers_one_wins(spark, tmp_path, rows):
    one, two = (Corpus(spark, f"file://{tmp_path}/c", rows.schema) for _ in range(2))
    commit, first = two.commit, []

    def late(base, new):
        if not first:
            first.append(one.append(rows.filter("archive = 'a0'"), {}))
        commit(base, new)

    two.commit = late
    assert two.append(rows.filter("archive = 'a1'"), {}) == ["a1"] and len(ids(one)) == 40
    first.clear()
    three = rows.withColumn("archive", F.concat(F.lit("x"), "archive"))

    def same(base, new):
        if not first:
            first.append(one.append(three.filter("archive = 'xa0'"), {}))
        commit(base, new)

    two.commit = same
    with pytest.raises(Conflict, match="another writer"):
        two.append(three, {})
    assert len(ids(one)) == 60


def test_shards_against_their_manifest(spark, tmp_path, rows):
    path = f"file://{tmp_path}/s"
    rows.repartitionByRange(4, "id").write.parquet(path)
    record = lambda: shard_records(spark.read.schema(rows.schema).parquet(path), "id", rows_digest(*rows.columns).alias("digest"))
    recorded = [tuple(r) for r in record().collect()]
    then = spark.createDataFrame(recorded, record().schema)
    assert {r.state for r in validate_shards(then, record()).collect()} == {"ok"}
    names = sorted(r[0] for r in recorded)
    spark.read.parquet(f"{path}/{names[0]}").withColumn("text", F.lit("x")).coalesce(1).write.parquet(f"file://{tmp_path}/o")
    (made,) = (tmp_path / "o").glob("part-*")
    (tmp_path / "s" / names[0]).unlink()
    made.rename(tmp_path / "s" / names[0])
    for crc in (tmp_path / "s").glob(".*.crc"):
        crc.unlink()
    (tmp_path / "s" / names[1]).rename(tmp_path / "s" / "part-new.parquet")
    got = {r.shard: r.state for r in validate_shards(then, record()).collect()}
    assert got == {names[0]: "changed", names[1]: "missing", "part-new.parquet": "unknown", names[2]: "ok", names[3]: "ok"}
    assert {r.shard: r.state for r in validate_shards(then.drop("digest"), record()).collect()}[names[0]] == "ok"  # counts alone don't show it


def test_texts_that_start_like_objects_are_kept(spark):
    rows = [('{"a":"{not json","b":{"c":1},"d":"{\\"x\\":1} y","e":"{\\"k\\":{\\"z\\":2}}","f":null,"g":{"h":{"i":[1,2]}}}',)]
    (got,) = spark.createDataFrame(rows, "j string").select(flattened(F.col("j")).alias("e")).collect()
    assert sorted(map(tuple, got.e)) == [("a", "{not json"), ("b.c", "1"), ("d", '{"x":1} y'), ("e", '{"k":{"z":2}}'), ("g.h.i", "[1,2]")]
