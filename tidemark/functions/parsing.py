"""Text fields to typed values, each with a status: present, unavailable (nothing stated) or rejected (unreadable)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

PRESENT, UNAVAILABLE, REJECTED = "present", "unavailable", "rejected"
#: Inclusive upper bounds of the estimated length in seconds, and the moves that the estimate counts.
SPEED_BOUNDS = ((29, "ultrabullet"), (179, "bullet"), (479, "blitz"), (1499, "rapid"), (21599, "classical"))
LAST_SPEED = "correspondence"
ESTIMATED_MOVES = 40


def with_status(text: Column, value: Column) -> Column:
    """``(value, status)`` of a text and what was read from it."""
    empty = text.isNull() | F.trim(text).isin("", "?", "-")
    return F.struct(F.when(~empty, value).alias("value"), F.when(empty, UNAVAILABLE).when(value.isNull(), REJECTED).otherwise(PRESENT).alias("status"))


def flattened(value: Column, depth: int = 6, prefix: Column | None = None) -> Column:
    """Entries ``(key, value)`` of a JSON object with dotted keys for objects in it, down to ``depth`` levels; what lies
    deeper stays as JSON text. Nulls have no entry, arrays are kept as JSON text. What is an object is told by its type,
    so a text that looks like one is kept."""
    texts, kinds = (F.from_json(value, f"map<string,{t}>") for t in ("string", "variant"))
    none = F.array().cast("array<struct<key:string,value:string,inner:boolean>>")
    inner = F.transform(F.map_values(kinds), lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), F.lit(False)))
    entries = F.coalesce(F.transform(F.arrays_zip(F.map_keys(texts), F.map_values(texts), inner), lambda z: F.named_struct(F.lit("key"), z["0"], F.lit("value"), z["1"], F.lit("inner"), z["2"])), none)

    def one(e: Column) -> Column:
        name = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
        leaf = F.array(F.named_struct(F.lit("key"), name, F.lit("value"), e["value"]))
        return F.when(e["inner"], flattened(e["value"], depth - 1, name)).otherwise(leaf) if depth > 1 else leaf

    return F.filter(F.flatten(F.transform(entries, one)), lambda e: e["value"].isNotNull())


def optional_int(text: Column) -> Column:
    return with_status(text, F.when(F.trim(text).rlike("^[0-9]{1,9}$"), F.trim(text).try_cast("int")))


def time_control(text: Column) -> tuple[Column, Column]:
    """Initial and increment of ``initial+increment``."""
    form = r"^(\d{1,9})\+(\d{1,9})$"
    return tuple(with_status(text, F.when(text.rlike(form), F.regexp_extract(text, form, i).try_cast("int"))) for i in (1, 2))


def clock_ms(text: Column) -> Column:
    """Milliseconds of ``h:mm:ss`` with up to three decimals; null out of range."""
    form = r"^(\d{1,3}):(\d{2}):(\d{2})(?:\.(\d{1,3}))?$"
    part = lambda i: F.regexp_extract(text, form, i).try_cast("long")
    tail = F.rpad(F.regexp_extract(text, form, 4), 3, "0").try_cast("long")
    return F.when(text.rlike(form) & (part(2) < 60) & (part(3) < 60), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + tail)


def clock_precision_ms(text: Column) -> Column:
    """The tick that the printed decimals imply."""
    return F.element_at(F.array(*map(F.lit, (1000, 100, 10, 1))), F.length(F.regexp_extract(text, r"\.(\d{1,3})$", 1)) + 1)


def dotted_date(text: Column) -> Column:
    unknown = text.isNull() | text.rlike(r"^[?.]*$")
    day = F.when(text.rlike(r"^\d{4}\.\d{2}\.\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy.MM.dd")).cast("date"))
    return F.struct(F.when(~unknown, day).alias("value"), F.when(unknown, UNAVAILABLE).when(day.isNull(), REJECTED).otherwise(PRESENT).alias("status"))


def normalized(text: Column) -> Column:
    """Lower case with other runs than letters and digits as one underscore."""
    clean = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.struct(F.when(clean != "", clean).alias("value"), F.when(text.isNull(), UNAVAILABLE).when(clean == "", REJECTED).otherwise(PRESENT).alias("status"))


def source_key(url: Column, width: int | None = None) -> Column:
    """Last part of a URL's path if it is a plain key."""
    last = F.regexp_extract(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), r"/([A-Za-z0-9_-]+)/?$", 1)
    key = F.when(last != "", last)
    return F.substring(key, 1, width) if width else key


def pool_from_label(label: Column, words: Sequence[str], prefix: str) -> Column:
    found = F.regexp_extract(F.lower(label), rf"\b({'|'.join(words)})\b", 1)
    return F.when(found != "", F.concat(F.lit(prefix + "_"), found))


def speed_band(initial_s: Column, increment_s: Column) -> Column:
    length = initial_s + ESTIMATED_MOVES * increment_s
    out = F.when(length.isNull(), F.lit(None))
    for bound, name in SPEED_BOUNDS:
        out = out.when(length <= bound, name)
    return out.otherwise(LAST_SPEED)


def fixed_bucket(value: Column, width: int, digits: int = 4) -> Column:
    low = F.floor(value / width).cast("long") * width
    return F.when(value.isNull(), "unclassified").otherwise(F.concat_ws("-", F.lpad(low.cast("string"), digits, "0"), F.lpad((low + width - 1).cast("string"), digits, "0")))


def named_band(value: Column, bands: Sequence[tuple[str, float | None]]) -> Column:
    """Half-open bands by their upper ends, rising; the last may be open."""
    ends = [e for _, e in bands]
    if any(b is None for b in ends[:-1]) or any(a >= b for a, b in zip(ends, ends[1:]) if b is not None):
        raise ValueError("bands must rise, and only the last may be open")
    out = F.when(value.isNull(), F.lit(None))
    for name, end in bands:
        out = out.when(value < end, name) if end is not None else out.otherwise(name)
    return out


def name_levels(name: Column, separators: str = ":,") -> tuple[Column, Column, Column]:
    """A name up to its first and its second separator, and whole."""
    s = f"[{separators}]"
    family = F.trim(F.regexp_extract(name, f"^([^{separators}]*)", 1))
    variation = F.when(name.rlike(f"{s}.*{s}"), F.trim(F.regexp_extract(name, f"^([^{separators}]*{s}[^{separators}]*)", 1))).otherwise(name)
    return family, variation, name


def is_account(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9_-]*[A-Za-z0-9][A-Za-z0-9_-]*$"), F.lit(False))


def phase(weight: Column, step: Column, endgame_weight: float, opening_steps: int) -> Column:
    """What little is left decides first, then how early it is."""
    return F.when(weight <= endgame_weight, "endgame").when(step <= opening_steps, "opening").otherwise("middlegame")


def flag_mask(*flags: Column) -> Column:
    out = F.lit(0)
    for i, f in enumerate(flags):
        out = out.bitwiseOR(F.when(f, 1 << i).otherwise(0))
    return out


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, null if none does: the order of rules decides which is named."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(F.coalesce(rule, F.lit(False)), name)
    return out
