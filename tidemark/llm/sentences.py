"""Substring dedup by sliding spans of sentences.

A text falls into sentences (up to marks or line ends, with the white space after them). One of more than 100
characters falls into pieces, so that a long passage without marks has spans too: it is cut where its
content says, after words that end with certain letters, or after certain characters of scripts without spaces, and
after ``most_words`` words or 40 characters without such a place. So two texts that share a passage cut it alike from
the first such place on, wherever it lies in them. Every run of ``span`` sentences is hashed,
equal hashes meet in one aggregation, and all sentences that any repeated span but the first one covers are removed.
The first is the one in the document with the smallest id, at the smallest place. Sentences are compared without the
white space around them; the rest of a text stays as it was.

The aggregation combines counts and minima before its shuffle, so a line in a third of all documents is one row from
each task. Spans that occur more than once come back to their documents in a join; frequent ones are dealt to many
parts there, so one line's places are no task's alone.

Defined cases: null text is empty; a text with fewer sentences than a span keeps them all; texts of one id are apart
by their hash, and repeated rows (same id and text) count as one document, so they lose the same sentences; a null id
comes before all others; an empty table gives no rows. Extra columns are kept by the dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.shared import keep

SPAN, MOST_WORDS = 3, 15
#: Longer sentences are cut, whatever their words.
MOST_CHARS, MOST_UNSPACED = 100, 40
BLANK = " \t\n\r"
#: Marks that end a sentence, beside the line end.
MARKS = ".!?\u3002\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965"
#: Ranges of scripts written without spaces (Thai and Lao, Myanmar, Khmer, kana and Han).
UNSPACED = ("\u0e00-\u0eff", "\u1000-\u109f", "\u1780-\u17ff", "\u3040-\u9fff")
#: Letters; a long sentence is cut after a word that ends with one of them.
LAST_LETTERS = "gkpxz\u0439\u0445\u0446"
#: Frequent characters of unspaced scripts; a long sentence is cut after each.
LAST_UNSPACED = "\u0e32\u0e48\u0e49\u103a\u17b6\u306e\u306f\u3092\u306b\u304c\u4e0d\u4e86\u4eba\u4ed6\u5728\u6211\u662f\u6709\u7684\u8fd9"


def without(ranges: tuple[str, ...], chars: str) -> str:
    """The inside of a character class: ranges but for some characters."""
    out = []
    for first, last in ((ord(r[0]), ord(r[2])) for r in ranges):
        for c in sorted(c for c in map(ord, chars) if first <= c <= last):
            out.append((first, c - 1))
            first = c + 1
        out.append((first, last))
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out if a <= b)


def patterns(most_words: int = MOST_WORDS, wide: bool = True) -> tuple[str, str]:
    """Sentences of a text, and pieces of a long sentence. Without ``wide`` the classes name no character from U+0400 on:
    the same for texts that have none, and many times faster."""
    narrow = lambda chars: "".join(c for c in chars if wide or ord(c) < 0x400)
    marks, letters, u, blank = narrow(MARKS), narrow(LAST_LETTERS), "".join(UNSPACED) if wide else "", r" \t\n\r"
    sentence = rf"[^{marks}\n]*[{marks}\n]+[ \t\n\r]*|[^{marks}\n]+"
    unspaced = rf"[{blank}]*[{without(UNSPACED, LAST_UNSPACED)}]{{0,{MOST_UNSPACED - 1}}}[{u}][{blank}]*|" if wide else ""
    spaced = rf"[{blank}]*(?:[^{blank}{u}]*[^{blank}{u}{letters}][{blank}]+){{0,{most_words - 1}}}[^{blank}{u}]+[{blank}]*"
    return sentence, rf"{unspaced}{spaced}|[{blank}]+"


def sentences(text: Column, most_words: int = MOST_WORDS) -> Column:
    """Pieces that give the text when put together."""
    short = lambda s: F.char_length(s) <= MOST_CHARS

    def cut(wide: bool) -> Column:
        sentence, piece = (F.lit(p) for p in patterns(most_words, wide))
        return F.flatten(F.transform(F.regexp_extract_all(text, sentence, F.lit(0)), lambda s: F.when(short(s), F.array(s)).otherwise(F.regexp_extract_all(s, piece, F.lit(0)))))

    return F.when(text.rlike("[\u0400-\uffff]"), cut(True)).otherwise(cut(False))


def repeated(docs: DataFrame, span: int = SPAN, most_words: int = MOST_WORDS, most_met: int = 10_000) -> DataFrame:
    """``(doc_id, tie, starts)``: where spans start that repeat an earlier one, for the documents that have any."""
    keys = F.transform(sentences(F.coalesce("text", F.lit("")), most_words), lambda s: F.btrim(s, F.lit(BLANK)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), keys.alias("keys")).filter(F.size("keys") >= span)
    runs = F.transform(F.sequence(F.lit(1), F.size("keys") - span + 1), lambda i: F.array_join(F.slice("keys", i, span), "\x1f"))
    spans = rows.select("doc_id", "tie", F.posexplode(runs).alias("at", "run")).select("doc_id", "tie", "at", F.xxhash64("run").alias("h"), F.hash("run").alias("g"))
    # id, 22 bits of the text's hash and place in one number, so that minima need no sort
    place = F.coalesce(F.col("doc_id").cast("decimal(38,0)"), F.lit("-9223372036854775809").cast("decimal(38,0)")) * F.lit(1 << 62).cast("decimal(19,0)")
    place = (place + (F.shiftleft(F.col("tie").bitwiseAND(F.lit((1 << 22) - 1)), 40) + F.col("at")).cast("decimal(19,0)")).cast("decimal(38,0)")
    spans = spans.withColumn("place", place)
    several = keep(spans.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1"), "repeated-spans")
    # frequent spans are dealt to parts; as each has over a 10,000th of all repeated places, they are under 10,000 and go to every task
    most_met = max(most_met, (several.agg(F.sum("n")).first()[0] or 0) // 10_000)
    parts = F.ceil(F.col("n") / F.lit(most_met)).cast("int")
    frequent = F.broadcast(several.filter(F.col("n") > most_met).select("h", "g", parts.alias("parts")))
    part = F.pmod(F.xxhash64("doc_id", "tie", "at"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = spans.join(frequent, ["h", "g"], "left").withColumn("part", part).drop("parts")
    held = several.select("h", "g", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    later = dealt.join(held, ["h", "g", "part"]).filter(F.col("place") > F.col("first"))
    return later.groupBy("doc_id", "tie").agg(F.collect_set("at").alias("starts"))


def deduplicated(docs: DataFrame, span: int = SPAN, most_words: int = MOST_WORDS, **options) -> DataFrame:
    """``(row, parts, kept)``: each row with its sentences and those that stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeated(docs, span, most_words, **options)
    joined = rows.alias("r").join(found.alias("f"), F.expr("r.doc_id <=> f.doc_id and r.tie = f.tie"), "left").select("row", "text", "starts")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + span - 1))))
    parts = joined.select("row", sentences(F.col("text"), most_words).alias("parts"), covered.alias("covered"))
    staying = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "covered")  # by a hash set, so long texts cost in proportion
    kept = F.when(F.col("covered").isNull(), F.col("parts")).otherwise(F.transform(staying, lambda i: F.get("parts", i)))
    return parts.select("row", "parts", kept.alias("kept"))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with repeated sentences cut out of ``text``; columns unchanged, null texts stay null."""
    cut = deduplicated(docs, **options)
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.array_join("kept", ""))
    return cut.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.array_join("kept", "")
    return cut.select("row.doc_id", F.size("parts").cast("long").alias("n_sentences"), (F.size("parts") - F.size("kept")).cast("long").alias("n_removed"), F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    flatten(list_transform(regexp_extract_all(coalesce(text, ''), '<sentence>'),
      lambda s: CASE WHEN length(s) <= 100 THEN [s] ELSE regexp_extract_all(s, '<piece>') END)) AS parts
  FROM documents),
placed AS (SELECT doc_id, unnest(range(1, len(parts) - 1)) AS pos, parts FROM parts WHERE len(parts) >= 3),
spans AS (SELECT doc_id, pos, list_transform(parts[pos:pos + 2], lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13))) AS run FROM placed),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, pos) AS k FROM spans),
covered AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE k > 1),
listed AS (SELECT doc_id, list(pos) AS gone FROM covered GROUP BY doc_id),
cut AS (
  SELECT p.doc_id, len(parts) AS n,
    CASE WHEN gone IS NULL THEN parts ELSE list_filter(parts, lambda s, i: NOT list_contains(gone, i)) END AS kept
  FROM parts p LEFT JOIN listed l ON p.doc_id IS NOT DISTINCT FROM l.doc_id)
SELECT doc_id, n::BIGINT AS n_sentences, (n - len(kept))::BIGINT AS n_removed,
  length(array_to_string(kept, ''))::BIGINT AS kept_chars, sha256(array_to_string(kept, '')) AS kept_sha256 FROM cut
""".replace("<sentence>", patterns()[0]).replace("<piece>", patterns()[1])
