"""Scores of actions held as arrays: losses, ranks, masses and divergences, with no code outside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))


def policy_columns(scores: Column, allowed: Column, target: Column) -> dict[str, Column]:
    """``scores`` of all actions, ``allowed`` a boolean for each, ``target`` a position from 0."""
    kept = F.transform(F.filter(F.arrays_zip(scores.alias("s"), allowed.alias("a")), lambda z: z["a"]), lambda z: z["s"])
    at = F.get(scores, target)
    ahead = F.size(F.filter(kept, lambda v: v > at))
    everything, legal = log_sum_exp(scores), log_sum_exp(kept)
    best = F.array_max(F.transform(F.arrays_zip(scores.alias("s"), allowed.alias("a")), lambda z: F.when(~z["a"], z["s"])))
    return {
        "loss": everything - at,
        "allowed_loss": legal - at,
        "allowed_mass": F.exp(legal - everything),
        "margin": F.array_max(kept) - F.coalesce(best, F.lit(float("-inf"))),
        "rank": ahead + 1,
        "top1_disallowed": F.coalesce(best > F.array_max(kept), F.lit(False)),
        "lift": F.log(F.size(kept).cast("double")) - (legal - at),
    }


def set_mass(scores: Column, chosen: Column) -> tuple[Column, Column, Column]:
    """Mass, best rank and best position of the positions in ``chosen``."""
    picked = F.transform(chosen, lambda i: F.get(scores, i))
    best = F.array_max(picked)
    rank = F.size(F.filter(scores, lambda v: v > best)) + 1
    top = F.get(chosen, F.array_position(picked, best).cast("int") - 1)
    return F.exp(log_sum_exp(picked) - log_sum_exp(scores)), rank, top


def divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler of the distributions that two score arrays stand for."""
    a, b = log_sum_exp(p), log_sum_exp(q)
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.exp(x - a) * ((x - a) - (y - b))), F.lit(0.0), lambda s, v: s + v)


def expected_score(own: Column, other: Column) -> Column:
    """Logistic in the difference of ratings, clamped far out."""
    return 1 / (1 + F.exp(F.least(F.lit(15.0), F.greatest(F.lit(-15.0), (other - own) * F.log(F.lit(10.0)) / 400))))


def log_bin(value: Column, width: float) -> Column:
    return F.floor(F.log1p(value) / F.lit(width)).cast("long")


def top_scores(scores: Column, k: int) -> Column:
    """The k best as (score, position), best first, earlier positions first on a tie."""
    keyed = F.transform(scores, lambda v, i: F.struct((-v).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda z: F.struct((-z["s"]).alias("score"), z["i"].alias("at")))
