"""Tables, manifests, logs and result stores in folders that Spark reads and writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.checks import must


def write_normalized(rows: DataFrame, path: str, unique: Sequence[str] = (), partition: Sequence[str] = ()) -> DataFrame:
    """Zstandard Parquet, without dictionaries for columns whose values do not repeat; returns what was written."""
    writer = rows.write.option("compression", "zstd")
    for c in unique:
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_bounded(rows: DataFrame, path: str, key: str, most: int, shards: int) -> DataFrame:
    """Shards of at most ``most`` rows, each a range of the key and in its order."""
    rows.repartitionByRange(shards, key).sortWithinPartitions(key).write.option("maxRecordsPerFile", most).option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def files_of(spark: SparkSession, path: str):
    """Hadoop's path type and the file system of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def shard_records(rows: DataFrame, key: str, *extra: Column) -> DataFrame:
    """A row for each file: its rows, least and greatest key; ``rows_digest(...).alias("digest")`` adds its content."""
    return rows.groupBy(F.col("_metadata.file_name").alias("shard")).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), *extra)


def manifest(rows: DataFrame, key: str, **coverage: Column) -> DataFrame:
    """One row of JSON, keys sorted: what is in a table and in its shards' order-free identity."""
    from tidemark.operators.selection import identity_digest

    facts = rows.agg(F.count("*").alias("rows"), *[c.alias(k) for k, c in sorted(coverage.items())])
    return facts.crossJoin(identity_digest(rows, key).select(F.col("digest").alias("identity"))).select(F.to_json(F.struct(*sorted(["rows", "identity", *coverage]))).alias("value"))


def cached_summary(rows: DataFrame, key: str, path: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(rows)``, kept under the identity of the rows: the same rows find it, other rows have one of their own."""
    from tidemark.operators.selection import identity_digest

    spark, place = rows.sparkSession, f"{path}/{identity_digest(rows, key).first()['digest']}"
    try:
        return spark.read.parquet(place)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make(rows).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def validate_shards(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """``(shard, state)`` against a manifest ``(shard, rows, digest)``: missing, unknown, changed, or ok.

    Where both sides have a ``digest`` it decides, so a file that was rewritten in place is changed though its rows
    count the same; without one the numbers of rows do.
    """
    facts = ["rows", "digest"] if "digest" in recorded.columns and "digest" in found.columns else ["rows"]
    both = recorded.select("shard", F.struct(*facts).alias("want")).join(found.select("shard", F.struct(*facts).alias("have")), "shard", "full")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(~F.col("have").eqNullSafe(F.col("want")), "changed").otherwise("ok")
    return both.select("shard", state.alias("state"))


def write_with_header(rows: DataFrame, path: str, totals: DataFrame) -> None:
    """Tab-separated rows under one comment line of JSON totals."""
    head = totals.select(F.concat(F.lit("# "), F.to_json(F.struct(*totals.columns))).alias("value"))
    head.unionByName(rows.select(F.concat_ws("\t", *rows.columns).alias("value"))).write.text(path)


def read_with_header(spark: SparkSession, path: str, schema: T.StructType, totals: T.StructType, checks: Sequence[Column]) -> DataFrame:
    """Rows of such a file; the job fails if their totals are not those of the header."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith("# ")).select(F.from_json(F.substring("value", 3, 1 << 30), totals).alias("h"))
    body = lines.filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
    rows = body.select(*[F.get("p", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])
    found = rows.agg(F.struct(*[c.alias(f.name) for c, f in zip(checks, totals)]).alias("f")).crossJoin(head)
    held = found.filter(must(F.col("f") == F.col("h"), "totals differ from the header")).select(F.lit(True).alias("ok"))
    return rows.crossJoin(F.broadcast(held)).drop("ok")


def append_results(incoming: DataFrame, store: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of ``incoming`` that the store lacks; same key and same content is no row, other content fails the job."""
    held = store.select(key, F.col(digest).alias("_held"))
    both = incoming.join(held, key, "left")
    same = must(F.col("_held").isNull() | (F.col("_held") == F.col(digest)), F.concat(F.lit("conflicting record: "), F.col(key).cast("string")))
    return both.filter(F.col("_held").isNull() | ~same).drop("_held")
