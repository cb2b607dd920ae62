"""Queries against DuckDB on tables with odd values."""

import duckdb

from tidemark import registry

registry.load()


def both(spark, folder, name):
    """The rows of a query and those of its DuckDB twin over ``documents`` of lengths that are odd."""
    lengths = [(i, None if i % 13 == 0 else 0 if i % 7 == 0 else -2500 if i % 11 == 0 else i * 937 % 5200) for i in range(300)]
    spark.createDataFrame(lengths, "doc_id long, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    found = con.execute(registry.SQL[name])
    got = registry.QUERIES[name](spark, str(folder))
    return [tuple(r) for r in got.select(*[d[0] for d in found.description]).collect()], found.fetchall()


def test_sequences_without_steps_lie_in_the_first_bucket(spark, tmp_path):
    got, want = both(spark, tmp_path, "w_length_buckets")
    assert {r[1] for r in want} == {None, -2, 0, 1, 2, 3, 4, 5}
    assert set(got) == set(want) and len(got) == len(want)  # length 0 had a bucket of its own, -1


def test_windows_with_sequences_without_steps_or_length(spark, tmp_path):
    got, want = both(spark, tmp_path, "w_planning_windows")
    assert set(got) == set(want) and len(got) == len(want)  # length 0 had batches of its own, null lengths stood first
