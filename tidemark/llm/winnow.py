"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's units are its runs of non-space characters, cut to ``unit`` code points at most (so text without spaces has
units too). A gram is ``gram`` units in a row and its hash a polynomial of their hashes; of each ``window`` hashes in a
row the smallest is chosen, the rightmost on a tie, and kept with its position. So any ``gram + window - 1`` units that
two texts share give both a common choice. Likeness is the share of chosen hashes that two texts have in common, of
all that either has (1 for two texts without any).

The next document in order of id is found without a global sort: ids are cut into many buckets at approximate
quantiles, a window orders each bucket, and every bucket gets a copy of the first document of the next one, so the
order runs on across buckets and from the last to the first. Texts are shuffled once.

Defined cases: null text is empty; a text with fewer units than a gram has one gram of all its units; a text without
units has no choices and an empty fingerprint; equal ids go by text; a null id comes first; repeated rows are rows of
their own; a table of one row is its own next document; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

GRAM, WINDOW, UNIT = 5, 8, 16


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, though ``use`` names it inside of other functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def selections(text: Column, gram: int = GRAM, window: int = WINDOW, unit: int = UNIT) -> Column:
    """``array<long>`` in order of position: a chosen gram's hash above 31 bits that fall as its position rises.

    So the smallest of these longs has the smallest hash and, of equal ones, the rightmost position. A gram's hash
    rolls by shift and exclusive or: each step shifts what was and takes in the next unit's hash. ``window`` is a
    power of two: minima of windows come from those of windows half as wide.
    """
    units = F.regexp_extract_all(text, F.lit(rf"\S{{1,{unit}}}"), F.lit(0))

    def rolled(h: Column, i: Column) -> Column:
        out = F.shiftleft(F.get(h, i), 7 * (gram - 1))
        for k in range(1, gram):  # past the end of a short text there is nothing to take in
            out = out.bitwiseXOR(F.shiftleft(F.coalesce(F.get(h, i + k), F.lit(0)), 7 * (gram - 1 - k)))
        return F.shiftleft(F.hash(out).cast("long"), 31).bitwiseOR(F.lit((1 << 31) - 1) - i)

    def halved(width: int):
        if width == 1:
            return lambda m: m
        return lambda m: bound(F.transform(m, lambda x, i: F.least(x, F.get(m, i + width // 2))), halved(width // 2))

    grams = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - gram, F.lit(0))), lambda i: rolled(h, i))
    chosen = lambda m: F.array_distinct(F.slice(m, 1, F.greatest(F.size(m) - window + 1, F.lit(1))))
    # after the last half step, the value at i is the least of i .. i + window - 1
    steps = lambda h: bound(bound(grams(h), halved(window)), chosen)
    return bound(F.transform(units, lambda u: F.xxhash64(u)), lambda h: F.when(F.size(h) > 0, steps(h)).otherwise(F.array().cast("array<long>")))


def hash_of(choice: Column) -> Column:
    return F.shiftright(choice, 31).cast("int")


def position_of(choice: Column) -> Column:
    """In units, from 0."""
    return F.lit((1 << 31) - 1) - choice.bitwiseAND(F.lit((1 << 31) - 1))


def likeness(a: Column, b: Column) -> Column:
    """The share of distinct hashes common to two selections."""
    hashes = lambda s: F.array_distinct(F.transform(s, hash_of))
    share = lambda x, y, both: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))
    return bound(hashes(a), lambda x: bound(hashes(b), lambda y: bound(F.size(F.array_intersect(x, y)), lambda n: share(x, y, n))))


def digest(s: Column) -> Column:
    """Chosen hashes in order, 8 hex digits each."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(F.shiftright(x, 31).bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")), " ")


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs(doc_id, text)`` with ``bucket``, rising with the id, and a last row ``copied`` in each bucket: the first of the next."""
    bounds = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("at")).first()["at"] or []
    bounds = sorted(set(bounds))
    size = len(bounds)
    # binary search: how many bounds are at most the id
    step = lambda low, s: F.when((low + s <= size) & (F.get(at, low + s - 1) <= F.col("doc_id")), low + s).otherwise(low)
    at = F.lit(bounds) if bounds else F.array().cast("array<long>")
    powers = F.lit([1 << k for k in reversed(range(max(1, size.bit_length())))])
    bucket = F.when(F.col("doc_id").isNull() | F.lit(size == 0), F.lit(0)).otherwise(F.aggregate(powers, F.lit(0), step))
    placed = docs.withColumn("bucket", bucket)
    # the first of each bucket by (id, text); ids first, then texts of those ids alone
    heads = docs.select("doc_id").withColumn("bucket", bucket).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("head"))
    order, everything = W.orderBy("bucket"), W.partitionBy()
    following = F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select("bucket", following.alias("next")).select("bucket", "next.doc_id")
    texts = docs.alias("d").join(F.broadcast(heads).alias("h"), F.expr("d.doc_id <=> h.doc_id")).groupBy("h.bucket").agg(F.min_by(F.struct("d.doc_id", "d.text"), F.struct("d.text")).alias("row"))
    copies = texts.select("row.doc_id", "row.text", "bucket", F.lit(True).alias("copied"))
    return placed.withColumn("copied", F.lit(False)).unionByName(copies)


def fingerprints(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, unit: int = UNIT, buckets: int | None = None) -> DataFrame:
    """``(doc_id, n_chars, text, edited, chosen, edited_chosen, next_chosen)`` of every row of ``docs(doc_id, text)``.

    Buckets follow the shuffle partitions, eight to each, so a bucket is small where there are partitions enough for
    the table. The heads are one id for each bucket, so they may be broadcast.
    """
    spark = docs.sparkSession
    buckets = buckets or max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    by_id = W.partitionBy("bucket").orderBy("copied", F.col("doc_id").asc_nulls_first(), "text")
    run = (
        bucketed(rows, buckets).withColumn("chosen", selections(F.col("text"), gram, window, unit))
        .withColumns({"next_text": F.lead("text").over(by_id), "next_chosen": F.lead("chosen").over(by_id)}).filter(~F.col("copied"))
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    return run.withColumn("edited", edited).withColumn("edited_chosen", selections(F.col("edited"), gram, window, unit))


def digested(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("chosen")).alias("fingerprint"), digest(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"), likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"),
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
