"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. A document's expected copies are its source's target over its source's
size; the expected copies are summed in a fixed order within the source, a random offset (a hash of seed and source)
is added, and the document is emitted once for each integer that the sum crosses. So no document is emitted more
than ``ceil(rate)`` times, and the words taken follow the target as closely as the order allows: documents are
ordered by size, so that each size is thinned or repeated at the same rate.

The order within a source is (size, hash, id). The prefix sum is two-level: counts by (source, size, part of the hash
range) are summed over the cells of a source, and only the rank inside one cell needs a sort of documents. A size with
many documents has as many parts as keep a cell near ``most_ranked`` rows, so a hot source is spread over many tasks.

Defined cases: null text or a text without words has size 0 and is emitted like any other document of its source;
a null source is a source of its own, last in the order of weights; a source without words has target 0 and emits
nothing; repeated rows are ranked and emitted one by one; an empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.shared import keep

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)), F.lit(0)).cast("long")


def hash32(*parts: Column | str) -> Column:
    """The first 32 bits of an md5 as a long; null parts count as the word null."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: weights repeat over the sources in code point order, nulls last.

    A target stops at ``cap`` times its source's size and the excess goes to the others by weight. In ascending order
    of cap over weight the capped sources come first; the level of the rest is the largest of the levels that the
    prefixes give. One row per source goes through the window.
    """
    everything = W.partitionBy()
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    rising = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    levels = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    )
    return levels.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everything))).select("source", "source_size", "target")


def mix(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", most_ranked: int = 200_000, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(row, size, source_size, target, copies)``; ``row`` is a struct of ``columns`` (default: all of ``docs``)."""
    names = list(columns or docs.columns)
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("id"),
        word_count(F.col("text")).alias("size"), hash32(seed, F.col("doc_id")).alias("h"), F.xxhash64("text").alias("tie"),
    )
    if columns is not None:  # narrow rows: count words once
        sized = keep(sized, "mix-sizes")
    # at most documents / most_ranked sizes are large; the hash range of each is cut into even parts, in order
    large = sized.groupBy("source", "size").agg(F.count("*").alias("n")).filter(F.col("n") > most_ranked)
    large = large.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.ceil(F.col("n") / most_ranked).alias("_parts"))
    sized = sized.join(large, F.expr("source <=> _source and size = _size"), "left").withColumn("part", F.floor(F.col("h") * F.coalesce("_parts", F.lit(1)) / F.lit(4294967296))).drop("_source", "_size", "_parts")
    cells = sized.groupBy("source", "size", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    earlier = W.partitionBy("source").orderBy("size", "part").rowsBetween(W.unboundedPreceding, -1)
    plan = cells.select("source", "size", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select("p.*", "t.source_size", "t.target")
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("h", "id", "tie"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = hash32(seed, F.lit("offset"), F.col("s.source")) / F.lit(4294967296.0)
    crossed = F.floor(start + rate * F.col("rank")) - F.floor(start + rate * (F.col("rank") - 1))
    return (
        sized.withColumn("rn", rank).alias("s")
        .join(plan.alias("p"), F.expr("s.source <=> p.source and s.size = p.size and s.part = p.part"))
        .withColumn("rank", F.col("before") + F.col("rn"))
        .select("row", "s.size", "source_size", "target", crossed.cast("long").alias("copies"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it was drawn, columns unchanged."""
    drawn = mix(docs, **options).filter("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix(docs, columns=("doc_id",))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) AS rank FROM sized),
drawn AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.rank,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix|offset|' || coalesce(r.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(start + rate * rank) - floor(start + rate * (rank - 1))) * size)::BIGINT AS taken FROM drawn
"""
