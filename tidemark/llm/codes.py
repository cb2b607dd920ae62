"""Texts as arrays of code points, and words in them, for work on many texts at once."""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOP = 0x110000
MARK, LETTER, NUMBER = 1, 2, 3


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case form of what words are made of, else 0; and its MARK, LETTER or NUMBER."""
    lower, kind = np.zeros(TOP, np.uint32), np.zeros(TOP, np.uint8)
    for c in range(TOP):
        group = unicodedata.category(chr(c))[0]
        if group in "LMN":
            kind[c] = {"M": MARK, "L": LETTER, "N": NUMBER}[group]
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return lower, kind


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a zero before and after each, and where each text starts in it (one more at the end)."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    out = np.zeros(int(size.sum()) + len(parts) + 1, np.uint32)
    at = np.r_[0, np.cumsum(size + 1)] + 1
    for a, p in zip(at, parts):
        out[a : a + len(p)] = p
    return out, at


def bounded(df: DataFrame) -> DataFrame:
    """``df`` itself, in a session whose Arrow batches hold 1 MB (or one row): what lies between a task and its Python
    worker stays small however long texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    return df


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some rows: what a task holds as Python objects stays small, however long the texts are."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system, so that a worker between tasks holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def portions(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` code points; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_starts(inside: np.ndarray) -> np.ndarray:
    """Where the runs of true values start; the first value is false."""
    return np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
