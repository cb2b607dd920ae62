"""Steps in order: differences, recurrences, islands, seams and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.shared import keep


def delta(value: Column, order, back: int = 2) -> Column:
    """Drop since the same side's last reading (``back`` steps before); the value itself where there is none."""
    before = F.lag(value, back).over(order)
    return F.when(value.isNull(), F.lit(None)).when(before.isNull(), value).otherwise(before - value)


def restored(rows: DataFrame, sequence: str, step: str, stored: str, out: str) -> DataFrame:
    """The readings behind stored deltas: after a hole a stored value is absolute, so islands of readings sum on their own."""
    rows = rows.withColumn("_side", F.col(step) % 2)
    side = W.partitionBy(sequence, "_side").orderBy(step)
    absolute = F.col(stored).isNotNull() & F.lag(stored).over(side).isNull()
    run = side.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_absolute", absolute).withColumn("_island", F.sum(F.col("_absolute").cast("int")).over(run))
    island = W.partitionBy(sequence, "_side", "_island").orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("_absolute"), F.col(stored)).otherwise(-F.col(stored))).over(island)
    return rows.withColumn(out, F.when(F.col(stored).isNotNull(), total)).drop("_side", "_absolute", "_island")


def clock_before(value: Column, step: Column, initial: Column, order, back: int) -> Column:
    """The latest reading before a step, ``back`` = 2 for the own side, 1 for the other; a missing reading stays missing."""
    return F.when(step <= back, initial).otherwise(F.lag(value, back).over(order))


def recurrence(order, cap: int | None = None) -> Column:
    """How often the state of ``order``'s partition came before."""
    n = F.row_number().over(order) - 1
    return F.least(n, F.lit(cap)) if cap is not None else n


def ended_by(said: Column, decided: Column, drawn: Column, share: Column, abandonment_share: float) -> Column:
    return (
        F.when(said == "abandoned", "abandonment")
        .when((said == "time_forfeit") & (share > abandonment_share), "abandonment").when(said == "time_forfeit", "clock_expiry")
        .when((said == "normal") & decided, "resignation").when((said == "normal") & drawn, "draw_agreement").otherwise("unknown")
    )


def earlier_mean(value: Column, order, least: int) -> Column:
    """Mean of the values before a row, where there are at least ``least``."""
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return F.when(F.count(value).over(before) >= least, F.avg(value).over(before))


def changed(value: Column, order) -> Column:
    """Whether a value differs from the last one stated before it; nulls are skipped."""
    last = F.last(value, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce(value.isNotNull() & last.isNotNull() & (value != last), F.lit(False))


def seams(rows: DataFrame, series: Sequence[str], order: Sequence[str], key: str, **values: Column) -> DataFrame:
    """``(key, starts, *values)``: whether a row is the first of its series, and whether each value differs from the one before.

    Rows meet the row before them by series and rank, and ranks come from ranges, so a series of any length is spread
    over all tasks. A null on either side is no difference.
    """
    from tidemark.operators.batching import rank_within

    slim = rows.select(*dict.fromkeys([key, *series, *order]), *[v.alias(f"_v_{n}") for n, v in values.items()])
    ranked = keep(rank_within(slim, series, order, "_at"), "series")
    before = ranked.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(series)], (F.col("_at") + 1).alias("_next"), *[F.col(f"_v_{n}").alias(f"_b_{n}") for n in values])
    same = [F.col("_at") == F.col("_next"), *[F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(series)]]
    met = ranked.join(before, same, "left")
    return met.select(key, (F.col("_at") == 1).alias("starts"), *[F.coalesce(F.col(f"_v_{n}") != F.col(f"_b_{n}"), F.lit(False)).alias(n) for n in values])


def latest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row of each key, by one aggregation and no sort."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*")


def absorbing(draw: Column, dose: float, order) -> Column:
    """Once a step is drawn, all after it are too."""
    return F.max(draw < dose).over(order.rowsBetween(W.unboundedPreceding, 0))


def fold_log(rows: DataFrame, session: str, order: Sequence[str], is_reset: Column, state: Column) -> DataFrame:
    """The state set by the last reset event, and the number of events since."""
    run = W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"state": F.last(F.when(is_reset, state), ignorenulls=True).over(run), "_game": F.sum(is_reset.cast("int")).over(run)})
    return rows.withColumn("since", F.row_number().over(W.partitionBy(session, "_game").orderBy(*order)) - 1).drop("_game")
