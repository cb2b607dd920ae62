"""Language identification of whole and of mixed texts.

A word is a run of letters and marks; its score for a language is the sum of log likelihoods of its letter trigrams
(hashed to ``2 ** BITS`` buckets, word ends included). The script of its first letter, by code point ranges, leaves
only the languages that were learnt with that script as candidates. Viterbi over the words with a penalty for each
switch gives every word a language, and runs of one language are the spans of the text. Where no language gains as
much as the penalty over any stretch of words, nor two together over the first words and the last, staying in the best
language is the best path, so only other texts need the full recursion.

The model is fitted on a bounded sample of labelled rows: about ``ROWS_PER_LANGUAGE`` rows of each language, drawn by
a hash of the id; no language is left out. It is an array of ``2 ** bits`` rows and a column for each language, and has
``MOST_CELLS`` cells (128 MB) at most: with more than 512 languages trigrams share buckets, so its size does not depend
on the input.

Defined cases: null text and text without a letter give ``und`` with score 0, as does any text when no row is
labelled; a word in a script that no language was learnt with has no say, and a text of such words only is given to
the most frequent language with score 0; ties go to the language that comes first in code point order. Repeated rows
are predicted one by one; a null id is not held out and is not learnt from. Extra columns are kept by the stage.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.llm.codes import NUMBER, TOP, bounded, code_points, pieces, portions, tables, word_starts

BITS, ROWS_PER_LANGUAGE, MOST_CELLS, PENALTY = 16, 2000, 1 << 25, 12.0
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])

#: First and last code point of the blocks of a script.
SCRIPTS = {
    "Latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F), (0xFB13, 0xFB17)),
    "Hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x980, 0x9FF),),
    "Gurmukhi": ((0xA00, 0xA7F),),
    "Gujarati": ((0xA80, 0xAFF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Kannada": ((0xC80, 0xCFF),),
    "Malayalam": ((0xD00, 0xD7F),),
    "Sinhala": ((0xD80, 0xDFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Lao": ((0xE80, 0xEFF),),
    "Tibetan": ((0xF00, 0xFFF),),
    "Myanmar": ((0x1000, 0x109F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Ethiopic": ((0x1200, 0x139F),),
    "Khmer": ((0x1780, 0x17FF),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)),
    "Han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}


@functools.cache
def script_table() -> np.ndarray:
    """By code point: the number of its script in SCRIPTS, from 1; 0 for any other."""
    out = np.zeros(TOP, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            out[first : last + 1] = i
    return out


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter (``2 ** bits`` elsewhere), starts of words, their ends, their scripts, starts of texts."""
    lower, kind = tables()
    points, at = code_points(texts)
    x = lower[points]
    x[kind[points] == NUMBER] = 0
    h = x * np.uint32(0x9E3779B1)
    h[1:] ^= x[:-1] * np.uint32(0x85EBCA77)
    h[:-1] += (x[1:] * np.uint32(0xC2B2AE3D)) ^ (x[1:] << np.uint32(7))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    inside = x != 0
    bucket = np.where(inside, h >> np.uint32(32 - bits), np.uint32(1 << bits))
    starts = word_starts(inside)
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return bucket, starts, ends, script_table()[points[starts]], at


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (2 ** bits + 1, languages), the last row zero
    scripts: np.ndarray  # (scripts + 1, languages), added to a word's scores; rows of zeros leave all candidates
    known: np.ndarray  # (scripts + 1,), whether any language was learnt with the script
    penalty: float = PENALTY
    bits: int = BITS

    def words(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: scores of its words, and their starts and ends in it."""
        for a, b in portions(texts):
            bucket, starts, ends, script, at = features(texts[a:b], self.bits)
            scored = np.add.reduceat(self.scores[bucket], starts, axis=0) if len(starts) else np.zeros((0, len(self.langs)), np.float32)
            scored = np.where(self.known[script][:, None], scored + self.scripts[script], 0)
            cut = np.searchsorted(starts, at)
            for i in range(b - a):
                k = slice(cut[i], cut[i + 1])
                yield scored[k].astype(np.float64), starts[k] - at[i], ends[k] - at[i]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; a change of language costs ``penalty``. Ties go to staying, then to the first language."""
    best = int(np.argmax(scores.sum(axis=0)))
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    low = np.vstack([np.zeros((1, scores.shape[1])), low[:-1]])
    # where other languages have every word, k runs need only k - 1 switches, so first and last run must gain less than one
    ends = gain.max(initial=0.0) + (gain[-1:] - gain).max(initial=0.0)
    if (gain - low).max(initial=0.0) < penalty and ends < penalty:
        return np.full(len(scores), best)
    n, k = scores.shape
    came = np.empty((n, k), np.int64)
    stay, state = np.arange(k), scores[0].copy()
    came[0] = stay
    for i in range(1, n):
        top = int(state.argmax())
        switch = state[top] - penalty > state
        came[i] = np.where(switch, top, stay)
        state = np.where(switch, state[top] - penalty, state) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = int(state.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path


def predict(model: Model | None, texts: Sequence[str | None]) -> Iterator[tuple[str, float, list[dict]]]:
    """Language, score (share of the words that have a say and are of that language) and spans of each text."""
    full = [t or "" for t in texts]
    if model is None:
        yield from (("und", 0.0, []) for _ in full)
        return
    for text, (scores, starts, ends) in zip(full, model.words(full)):
        if not len(starts) or not any(map(str.isalpha, text)):
            yield "und", 0.0, []
            continue
        says = scores.any(axis=1)
        if not says.any():
            yield model.langs[int(np.argmax(model.scripts[0]))], 0.0, []
            continue
        path = viterbi(scores, model.penalty)
        count = np.bincount(path, weights=says, minlength=len(model.langs))
        lang = int(count.argmax())
        first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        last = np.r_[first[1:], len(path)] - 1
        spans = [{"start": s, "end": e, "lang": model.langs[p]} for s, e, p in zip(starts[first].tolist(), ends[last].tolist(), path[first].tolist())]
        yield model.langs[lang], float(count[lang] / says.sum()), spans


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, penalty: float = PENALTY) -> Model | None:
    """Learn from the labelled rows of ``docs(doc_id, text, lang)`` that are not held out."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counted = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counted:
        return None
    langs = sorted(r["lang"] for r in counted)
    bits = BITS
    while bits > 8 and len(langs) << bits > MOST_CELLS:
        bits -= 1
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, rows_per_language / r["count"])) for r in counted], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = labelled.join(F.broadcast(shares), "lang").filter(drawn < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams, scripts = {}, {}
        for b in pieces(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                bucket, _, _, script, _ = features([text], bits)
                n = np.bincount(bucket, minlength=(1 << bits) + 1)
                trigrams[lang] = trigrams.get(lang, 0) + n[:-1]
                scripts[lang] = scripts.get(lang, 0) + np.bincount(script, minlength=len(SCRIPTS) + 1)
        for lang in trigrams:
            for sign, n in ((1, trigrams[lang]), (-1, scripts[lang])):
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(sign * (at + 1)), pa.array(n[at])], ["lang", "slot", "n"])

    totals = bounded(sample).mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    n, scripts = np.zeros((1 << bits, len(langs))), np.zeros((len(SCRIPTS) + 1, len(langs)))
    column = totals["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    slot, value = totals["slot"].to_numpy(), totals["n"].to_numpy()
    n[slot[slot > 0] - 1, column[slot > 0]] = value[slot > 0]
    scripts[-slot[slot < 0] - 1, column[slot < 0]] = value[slot < 0]
    logs = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(n)))
    logs = np.where(n.sum(axis=1, keepdims=True) > 0, logs - logs.mean(axis=1, keepdims=True), 0)
    of_script = scripts / np.maximum(scripts.sum(axis=0), 1)
    candidate = of_script >= 0.02
    known = candidate.any(axis=1)
    narrowed = np.where(candidate, 0.0, -1e3)
    frequency = {r["lang"]: r["count"] for r in counted}
    narrowed[0], known[0] = [frequency[x] / 1e12 for x in langs], False  # row 0 orders the languages by frequency
    return Model(langs, np.vstack([logs, np.zeros(len(langs))]).astype(np.float32), narrowed, known, penalty, bits)


def identify(docs: DataFrame, model: Model | None, columns: Sequence[str] | None = None) -> DataFrame:
    """``(row, lang_pred, score, spans)``: ``row`` a struct of ``columns`` (default all); spans hold code point offsets."""
    names = list(columns or docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = list(predict(shared.value, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], spans)], ["row", "lang_pred", "score", "spans"])

    return bounded(rows).mapInArrow(label, schema)


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The documents with a language: letters, and at least ``least_score`` of the words in one language."""
    found = identify(docs, fit(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs), ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
