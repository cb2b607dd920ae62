"""Stable ids, ranks and shares from hashes. Equal on every run, partitioning and machine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

U64 = "decimal(20,0)"
TWO64 = 1 << 64


def sha256_of(*parts: Column) -> Column:
    """Hex sha256 of the parts with a NUL between them."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def u64(hex_digest: Column) -> Column:
    """The first 8 bytes of a hex digest as an unsigned number."""
    return F.conv(F.substring(hex_digest, 1, 16), 16, 10).cast(U64)


def derive_id(source: Column, key: Column) -> Column:
    return u64(sha256_of(source, key))


def salted_digest(name: Column, salt: str) -> Column:
    """32 hex digits for a name, whatever its case; null for none."""
    clean = F.lower(F.trim(name))
    return F.when(clean.isNull() | clean.isin("", "?"), F.lit(None)).otherwise(F.substring(sha256_of(F.lit(salt), clean), 1, 32))


def rank_key(seed: str, key: Column) -> Column:
    """Uniform in hex; its order is the order of the bytes."""
    return sha256_of(F.lit(seed), key)


def hash_fraction(seed: str, key: Column) -> Column:
    return u64(rank_key(seed, key)).cast("double") / F.lit(float(TWO64))


def split_of(seed: str, key: Column, validation: float, test: float) -> Column:
    """test takes the lowest hashes, validation the next, train the rest."""
    x = hash_fraction(seed, key)
    return F.when(x < test, "test").when(x < test + validation, "validation").otherwise("train")


def in_share(seed: str, key: Column, fraction: float) -> Column:
    """Whether a key is in a share; larger shares hold smaller ones."""
    return u64(rank_key(seed, key)) < F.lit(str(min(TWO64, int(fraction * TWO64)))).cast("decimal(21,0)")


def parity_side(seed: str, key: Column) -> Column:
    return F.conv(F.substring(rank_key(seed, key), 1, 2), 16, 10).cast("int") % 2


def part_sums(hex_digest: Column) -> list[Column]:
    """Aggregates: the sums of the eight 32-bit parts of a 256-bit hex digest, as ``decimal(30,0)``.

    Two parts are read as one signed number; halves of parts are summed as longs, which 2**47 rows don't overflow."""
    pair = lambda i: F.conv(F.substring(hex_digest, 16 * i + 1, 16), 16, -10).cast("long")
    half = lambda i, j: F.sum(F.shiftrightunsigned(pair(i), 48 - 16 * j).bitwiseAND(F.lit(0xFFFF)))
    whole = lambda i: half(i // 2, i % 2 * 2).cast("decimal(20,0)") * F.lit(1 << 16) + half(i // 2, i % 2 * 2 + 1)
    return [whole(i).cast("decimal(30,0)") for i in range(8)]


def content_digest(*columns: Column) -> Column:
    """Digest of values in the order given; a null is apart from any text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)
