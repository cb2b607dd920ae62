import pytest
from pyspark.sql import functions as F

from tidemark.llm import compaction


@pytest.fixture
def store(spark, tmp_path):
    schema = spark.createDataFrame([], "doc_id long, text string, `od d` int").schema
    return compaction.Store(spark, f"file://{tmp_path}/store", schema, "doc_id", target_bytes=40_000, fanout=3, smallest=1000)


def batch(spark, start, n):
    return spark.range(start, start + n).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit(None).cast("int").alias("od d")).coalesce(1)


def test_append_compact_read(spark, store):
    assert store.read().count() == 0 and store.version() == 0
    want = None
    for k in range(10):
        rows = batch(spark, k * 100, 40 + 10 * k)
        rows = rows.union(rows.limit(2))
        want = rows if want is None else want.union(rows)
        assert store.append(rows) == k + 1
    before = store.shards()
    assert len(before) == 10 and all(s.files == 1 for s in before)
    old = store.version()
    store.compact()
    after = store.shards()
    assert len(after) < 6 and not store.full_tiers(after)
    assert sum(s.rows for s in after) == want.count() == store.read().count()
    assert store.read().exceptAll(want).count() == 0 and store.read(old).exceptAll(want).count() == 0
    store.append(batch(spark, 5000, 0))
    store.compact(whole=True)
    assert max(s.bytes / s.files for s in store.shards()) < 80_000
    assert store.vacuum() > 0 and store.read().exceptAll(want).count() == 0


def test_commit_is_first_come(spark, store):
    store.append(batch(spark, 0, 30))
    live = store.shards()
    assert store.commit(1, live + [compaction.Shard("x", 0, 0, 0)]) == 2
    with pytest.raises(compaction.Conflict):
        store.commit(1, live)
    assert len(store.shards()) == 2
    assert store.change(lambda now: [s for s in now if s.id != "x"]) == 3 and store.shards() == live


def test_arrivals_in_one_job(spark, store):
    rows = batch(spark, 0, 500)
    store.append(rows, F.coalesce(F.col("doc_id") % 5, F.lit(9)))
    assert len(store.shards()) == 6 and store.read().exceptAll(rows).count() == 0


def test_null_arrivals_and_clashing_names(spark, tmp_path):
    schema = spark.createDataFrame([], "doc_id long, text string, _shard int, arrival string, drawn int").schema
    store = compaction.Store(spark, f"file://{tmp_path}/store", schema, "doc_id", target_bytes=40_000, fanout=3, smallest=1000)
    rows = spark.createDataFrame([(i, "x" * (3_000_000 if i == 5 else i), i, [None, "a", "a/b:c", ""][i % 4], 1) for i in range(40)], schema)
    versions = []
    for _ in range(3):
        versions.append(store.append(rows, F.col("arrival")))
        assert len({s.id for s in store.shards()}) == 4 * len(versions)
    assert [store.read(v).count() for v in versions] == [40, 80, 120]
    store.compact(whole=True)
    assert [store.read(v).count() for v in versions] == [40, 80, 120] and store.read().count() == 120
    assert store.read().exceptAll(rows.union(rows).union(rows)).count() == 0


def test_a_taken_name_is_refused(spark, store):
    store.append(batch(spark, 0, 30))
    (shard,) = store.shards()
    incoming = f"{store.path}/incoming/z"
    batch(spark, 0, 5).write.parquet(incoming)
    with pytest.raises(Exception, match="exist"):
        store.context.rename(store.to_path(incoming), store.to_path(store.location(shard)), store.no_overwrite)
    assert store.read().count() == 30


def test_one_key_for_all_rows_fills_several_files(spark, store):
    for k in range(3):
        store.append(batch(spark, k * 1000, 600).withColumn("doc_id", F.lit(1).cast("long")))
    store.compact(whole=True)
    assert max(s.bytes / s.files for s in store.shards()) < 60_000 and store.read().count() == 1800


def test_large_arrivals_in_many_small_files_are_compacted_too(spark, store):
    want = None
    for k in range(3):
        rows = batch(spark, k * 5000, 2000)
        store.append(rows.repartition(40))
        want = rows if want is None else want.union(rows)
    before = store.shards()
    assert all(s.bytes >= store.target and s.files == 40 for s in before)  # each alone is over the target, its files are tiny
    store.append(batch(spark, 90_000, 2000).repartition(40))
    (alone,) = [g for g in store.full_tiers([s for s in store.shards() if s.id not in {b.id for b in before}])]
    assert len(alone) == 1  # one such shard is a reason by itself
    store.compact(whole=True)
    after = store.shards()
    assert sum(s.files for s in after) <= sum(s.bytes for s in before) * 4 / 3 / store.target * 2
    assert not store.full_tiers(after) and not any(s.bytes / s.files < store.target / 4 for s in after)
    assert store.read().exceptAll(want.union(batch(spark, 90_000, 2000))).count() == 0 and store.read().count() == 8000
