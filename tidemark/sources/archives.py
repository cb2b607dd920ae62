"""Text archives of framed records: header tags, then a body with annotations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TAG = r'\[([A-Za-z0-9_]+)\s+"((?:[^"\\]|\\.)*)"\]'


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain, ``.bz2``, ``.gz`` or ``.zst`` files, the codec by suffix, with the file they are from. Each file is
    read as a stream, of any size; plain and ``.bz2`` files split."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("archive"))


def framed_records(spark: SparkSession, path: str, first_tag: str = "Event") -> DataFrame:
    """One row for each record: the reader itself breaks the text before each first tag, so large files split."""
    start = f"[{first_tag} "
    parts = spark.read.option("lineSep", "\n\n" + start).text(path).select("value", F.col("_metadata.file_name").alias("archive"))
    whole = F.when(F.col("value").startswith(start), F.col("value")).otherwise(F.concat(F.lit(start), "value"))
    return parts.filter(F.trim("value") != "").select("archive", whole.alias("record"))


def headers(record: Column, defaults: Mapping[str, str]) -> Column:
    """Tags of the block before the first blank line as a map; an absent tag has its default, the last of repeated ones counts."""
    block = F.substring_index(record, "\n\n", 1)
    tags = lambda i: F.regexp_extract_all(block, F.lit(TAG), F.lit(i))
    given = F.zip_with(tags(1), tags(2), lambda k, v: F.named_struct(F.lit("k"), k, F.lit("v"), v))
    base = F.map_from_arrays(F.array(*map(F.lit, defaults)), F.array(*map(F.lit, defaults.values()))) if defaults else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(given, base, lambda m, z: F.map_concat(F.map_filter(m, lambda k, _: k != z["k"]), F.create_map(z["k"], z["v"])))


def header(record: Column, name: str) -> Column:
    """The value of one tag as in ``headers``, null where it is absent."""
    block = F.substring_index(record, "\n\n", 1)
    tags = F.arrays_zip(*[F.regexp_extract_all(block, F.lit(TAG), F.lit(i)).alias(n) for i, n in ((1, "k"), (2, "v"))])
    return F.try_element_at(F.filter(tags, lambda z: z["k"] == name), F.lit(-1))["v"]


def annotations(record: Column, name: str) -> Column:
    """Values of ``[%name value]`` in order, one for each step that has it."""
    return F.regexp_extract_all(record, F.lit(rf"\[%{name}\s+([^\]\s]+)\]"), F.lit(1))
