"""Local curves over one axis, their comparison, densities and bandwidths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import hashing
from tidemark.functions.shared import keep
from tidemark.operators.compare import radii, within, within_radius
from tidemark.operators.quantiles import held
from tidemark.operators.uncertainty import poisson_weight


def tricube(distance: Column, radius: Column) -> Column:
    x = F.when(radius > 0, F.least(F.lit(1.0), distance / radius)).otherwise(F.lit(0.0))
    return F.pow(1 - F.pow(x, F.lit(3.0)), F.lit(3.0))


def local_curve(observations: DataFrame, grid: DataFrame, axis: str, value: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(point, *keys, value, effective, games)``: weighted local means; a window whose weights are all zero is a plain mean."""
    near = within_radius(observations, grid, axis, k).withColumn("_w", tricube(F.col("distance"), F.col("radius")))
    sums = near.groupBy("point", *keys).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col(value)).alias("wx"), F.sum(F.col("_w") * F.col("_w")).alias("ww"), F.count_if(F.col("_w") > 0).alias("inside"), F.count("*").alias("n"), F.avg(value).alias("plain"))
    some = F.col("w") > 0
    return sums.select("point", *keys, F.when(some, F.col("wx") / F.col("w")).otherwise(F.col("plain")).alias("value"), F.when(some, F.col("w") * F.col("w") / F.col("ww")).otherwise(F.col("n")).alias("effective"), F.when(some, F.col("inside")).otherwise(F.col("n")).alias("games"))


def side_at(observations: DataFrame, reach: DataFrame, axis: str) -> DataFrame:
    """Observations within the radius of each point, with their kernel weight ``_w``."""
    return within(observations, reach, axis).withColumn("_w", tricube(F.col("distance"), F.col("radius")))


def local_means(near: DataFrame, value: str, *keys: str, count: Column | None = None) -> DataFrame:
    """``(*keys, value, effective)`` of weighted rows, each ``count`` times; where all weights are zero a plain mean."""
    c = F.lit(1.0) if count is None else count
    w, plain = c * F.col("_w"), c.cast("double")
    sums = near.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * F.col(value)).alias("wx"), F.sum(w * w).alias("ww"), F.sum(plain).alias("n"), F.sum(plain * F.col(value)).alias("x"))
    some = F.col("w") > 0
    return sums.select(*keys, F.when(some, F.col("wx") / F.col("w")).when(F.col("n") > 0, F.col("x") / F.col("n")).alias("value"), F.when(some, F.col("w") * F.col("w") / F.col("ww")).otherwise(F.col("n")).alias("effective"))


def joined_sides(left: DataFrame, right: DataFrame, value: str, least: float) -> DataFrame:
    a, b = (local_means(near, value, "point").select("point", F.col("value").alias(n), F.col("effective").alias(f"{n}_n")) for near, n in ((left, "left"), (right, "right")))
    return a.join(b, "point").select("point", "left", "right", F.abs(F.col("left") - F.col("right")).alias("distance"), (F.least("left_n", "right_n") >= least).alias("supported"))


def compare_curves(left: DataFrame, right: DataFrame, grid: DataFrame, axis: str, value: str, k: int, least: float) -> DataFrame:
    """Point-wise distance of two local curves; points with too little behind either are not supported.

    Both sides are read within the radii of ``left``, the reference, so smoothing is the same and cancels.
    """
    reach = radii(left, grid, axis, k, clip=True)
    return joined_sides(side_at(left, reach, axis), side_at(right, reach, axis), value, least)


def curve_summary(points: DataFrame, *keys: str) -> DataFrame:
    """Over the supported points of each of ``keys``: ``conditional``, the mean distance; ``pooled``, the distance of the
    curves' means, which no spread of either side over the axis moves; and each curve's variation about its own mean."""
    whole = W.partitionBy(*keys)
    rows = points.filter("supported").withColumns({"_l": F.avg("left").over(whole), "_r": F.avg("right").over(whole)})
    return rows.groupBy(*keys).agg(
        F.avg(F.abs(F.col("left") - F.col("right"))).alias("conditional"), F.abs(F.avg("left") - F.avg("right")).alias("pooled"),
        F.avg(F.abs(F.col("left") - F.col("_l"))).alias("left_variation"), F.avg(F.abs(F.col("right") - F.col("_r"))).alias("right_variation"),
    )


def redrawn_curve(near: DataFrame, value: str, stream: str, replicates: int, seed: str) -> DataFrame:
    """``(point, _r, value)``: the curve when whole streams are drawn anew, each a Poisson number of times by a hash.

    Rows are combined to one for each point and stream first, so what is repeated is streams and not observations.
    """
    per = near.groupBy("point", stream).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col(value)).alias("wx"), F.count("*").alias("n"), F.sum(value).alias("x"))
    rep = per.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    c = poisson_weight(hashing.hash_fraction(seed, F.concat_ws(":", F.col(stream), "_r")))
    sums = rep.withColumn("_c", c).groupBy("point", "_r").agg(*[F.sum(F.col(x) * F.col("_c")).alias(x) for x in ("w", "wx", "n", "x")])
    return sums.select("point", "_r", F.when(F.col("w") > 0, F.col("wx") / F.col("w")).when(F.col("n") > 0, F.col("x") / F.col("n")).alias("value"))


def dealt_curve(near: DataFrame, observations: DataFrame, key: str, value: str, replicates: int, seed: str) -> DataFrame:
    """``(point, _r, value)``: the curve when the values of all observations are dealt anew over the axis.

    In a replicate the value of the i-th observation in the order of a hash goes to the place of the i-th one in the
    order of keys. Only the values dealt to the places of ``near`` are looked for: a first pass counts each replicate's
    hashes by their first digits, a second one orders the rows of those bins alone that hold a wanted rank.
    """
    from tidemark.operators.batching import global_rank

    n = observations.count()
    ranked = global_rank(observations.select(F.col(key).alias("_key")), ["_key"], "_i")
    places = keep(near.select("point", "_w", F.col(key).alias("_key")).join(ranked, "_key").select("point", "_w", "_i"), "places")
    digits = next(d for d in range(2, 65) if n <= 1024 * 16**d)
    rows = observations.select(F.col(key).alias("_key"), F.col(value).alias("_v")).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = rows.withColumn("_h", hashing.rank_key(seed, F.concat_ws(":", "_key", "_r"))).withColumn("_bin", F.substring("_h", 1, digits))
    upto = F.sum("_n").over(W.partitionBy("_r").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))  # a row for each bin
    bins = rows.groupBy("_r", "_bin").agg(F.count("*").alias("_n")).withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    size = n // 16**digits + 1  # ranks and bins meet by blocks of ranks
    block = lambda c: F.floor(c / size)
    bins = bins.withColumn("_block", F.explode(F.sequence(block(F.col("_before") + 1), block(F.col("_upto")))))
    wanted = places.select("_i", block(F.col("_i")).alias("_block")).distinct()
    here = bins.join(wanted, "_block").filter((F.col("_i") > F.col("_before")) & (F.col("_i") <= F.col("_upto")))
    here = keep(here.select("_r", "_bin", "_before").distinct(), "bins")
    place = F.col("_before") + F.row_number().over(W.partitionBy("_r", "_bin").orderBy("_h", "_key"))
    dealt = rows.join(held(here), ["_r", "_bin"]).withColumn("_i", place).select("_r", "_i", "_v")
    return local_means(places.join(dealt, "_i"), "_v", "point", "_r").select("point", "_r", "value")


def curve_levels(left: DataFrame, right: DataFrame, grid: DataFrame, axis: str, value: str, stream: str, key: str, k: int, replicates: int, seed: str, coverage: float = 2.0, least: float = 0.0) -> DataFrame:
    """``(kind, point, value, dispersion, level, flat)``: the readings of ``right`` against the reference ``left``, how far
    they move, and what they would be with nothing to find.

    Kinds: ``point``, the distance at a point; ``conditional`` and ``pooled`` as in ``curve_summary``; ``variation`` of
    ``right``. ``dispersion`` is the spread over replicates that draw the streams of ``right`` anew, the reference held
    fixed. ``level`` is the null level, the mean and ``coverage`` spreads of the distance between the two sides' own
    sampling errors, drawn anew independently: what curves of one behaviour differ by. ``flat`` is that of the variation
    (at a point: of the distance from the curve's mean) when the values of ``right`` are dealt anew over the axis, so
    that nothing depends on it. Errors are scaled by sqrt(n / (n - 1)) for n streams, which a redraw falls short by.
    Windows are those of the data as it is. ``key`` names an observation.
    """
    reach = keep(radii(left, grid, axis, k, clip=True), "radii")
    sides = [keep(side_at(d, reach, axis).select("point", "_w", F.col(value).alias("_v"), F.col(stream).alias("_s"), F.col(key).alias("_key")), "near") for d in (left, right)]
    points = keep(joined_sides(*sides, "_v", least), "curves")
    reps = []
    for d, near, name in zip((left, right), sides, ("left", "right")):
        n = F.broadcast(d.agg(F.countDistinct(stream).alias("_n")))
        scale = F.when(F.col("_n") > 1, F.sqrt(F.col("_n") / (F.col("_n") - 1))).otherwise(1.0)
        drawn = redrawn_curve(near, "_v", "_s", replicates, f"{seed}:{name}").withColumnRenamed("value", f"_{name}")
        reps.append(drawn.crossJoin(n).withColumn(f"_{name}_s", scale).drop("_n"))
    rows = keep(points.join(reps[0], "point").join(reps[1], ["point", "_r"]), "replicates")
    spread = lambda c: F.stddev_samp(c)
    above = lambda c: F.avg(c) + F.lit(coverage) * F.stddev_samp(c)
    model = rows.select("point", "_r", "left", F.col("_right").alias("right"), "supported", "_right_s")
    error = rows.select("point", "_r", "supported", ((F.col("_left") - F.col("left")) * F.col("_left_s")).alias("left"), ((F.col("_right") - F.col("right")) * F.col("_right_s")).alias("right"))
    flat = keep(dealt_curve(sides[1].withColumnRenamed("_key", key), right, key, value, replicates, f"{seed}:deal").join(points.select("point", "supported"), "point").withColumnRenamed("value", "right").withColumn("left", F.lit(0.0)), "dealt")
    per = points.select("point", F.col("distance").alias("value"))
    per = per.join(model.groupBy("point").agg((spread(F.abs(F.col("left") - F.col("right"))) * F.max("_right_s")).alias("dispersion")), "point")
    per = per.join(error.groupBy("point").agg(above(F.abs(F.col("left") - F.col("right"))).alias("level")), "point")
    centred = flat.filter("supported").withColumn("_c", F.avg("right").over(W.partitionBy("_r")))
    per = per.join(centred.groupBy("point").agg(above(F.abs(F.col("right") - F.col("_c"))).alias("flat")), "point", "left").withColumn("kind", F.lit("point"))
    now, drawn, null, dealt = curve_summary(points), curve_summary(model, "_r"), curve_summary(error, "_r"), curve_summary(flat, "_r")
    scale = model.agg(F.max("_right_s").alias("_s"))
    facts = now.crossJoin(drawn.agg(*[spread(c).alias(f"{c}_d") for c in ("conditional", "pooled", "right_variation")])).crossJoin(null.agg(*[above(c).alias(f"{c}_l") for c in ("conditional", "pooled")])).crossJoin(dealt.agg(above("right_variation").alias("_flat"))).crossJoin(scale)
    none = F.lit(None).cast("double")
    kinds = [("conditional", "conditional", F.col("conditional_l"), none), ("pooled", "pooled", F.col("pooled_l"), none), ("variation", "right_variation", none, F.col("_flat"))]
    made = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), none.alias("point"), F.col(c).alias("value"), (F.col(f"{c}_d") * F.col("_s")).alias("dispersion"), level.alias("level"), f.alias("flat")) for kind, c, level, f in kinds])).alias("m")
    return facts.select(made).select("m.*").unionByName(per.select("kind", F.col("point").cast("double"), "value", "dispersion", "level", "flat"))


def divergence_by_depth(rows: DataFrame, side: Column, depth: str, label: str) -> DataFrame:
    """``(depth, distance)``: total variation between the labels that two sides (true, false) have in force at each depth."""
    counted = rows.groupBy(F.col(depth).alias("depth"), F.col(label).alias("label")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    totals = counted.groupBy("depth").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    both = counted.join(F.broadcast(totals), "depth")  # a row for each depth
    return both.groupBy("depth").agg((F.sum(F.abs(F.col("a") / F.col("_a") - F.col("b") / F.col("_b"))) / 2).alias("distance"))


def settled_depth(rows: DataFrame, sequence: str, step: str, label: str) -> DataFrame:
    """One row: the depth after which no sequence's label changes any more; nothing deeper can differ from it.

    A sequence settles at the step after the last one whose label isn't its final one.
    """
    last = rows.groupBy(sequence).agg(F.max_by(label, step).alias("_final"))
    met = rows.join(last, sequence).filter(~F.col(label).eqNullSafe(F.col("_final")))
    moved = met.agg(F.max(step).alias("_m"))
    return moved.select((F.coalesce("_m", F.lit(0)) + 1).alias("settled"))


def half_divergence(points: DataFrame, floor: Column | None = None) -> DataFrame:
    """One row, ``half``: the depth at which half of the deepest excess is reached, in proportion between two depths.

    ``points(depth, excess)`` is a row for each depth. There is none for fewer than two depths, or where the deepest
    excess is no more than ``floor`` (0 without one).
    """
    whole = W.orderBy("depth")  # as many rows as there are depths
    ends = points.agg(F.max_by("excess", "depth").alias("_deep"), F.count("*").alias("_n"), (F.max(floor) if floor is not None else F.lit(0.0)).alias("_floor"))
    rows = points.withColumns({"_e": F.lag("excess").over(whole), "_d": F.lag("depth").over(whole)}).crossJoin(F.broadcast(ends))
    target = F.col("_deep") / 2
    at = F.when(F.col("_e").isNull(), F.col("depth").cast("double")).otherwise(F.col("_d") + (target - F.col("_e")) / (F.col("excess") - F.col("_e")) * (F.col("depth") - F.col("_d")))
    return rows.filter((F.col("_n") > 1) & (F.col("_deep") > F.col("_floor")) & (F.col("excess") >= target)).agg(F.min_by(at, "depth").alias("half"))


def leave_one_out(observations: DataFrame, order: Sequence[str], value: str, candidates: Sequence[int]) -> DataFrame:
    """Squared error of predicting each value from its k neighbours on either side in order, for each k."""
    from tidemark.operators.batching import global_rank

    ranked = global_rank(observations, order, "_n").withColumn("_b", F.floor(F.col("_n") / 4096))
    most = max(candidates)
    # each range of ranks brings the neighbours of its ends along, so no window spans all rows
    spread = ranked.withColumn("_h", F.explode(F.array_distinct(F.array(F.floor((F.col("_n") - most) / 4096), F.col("_b"), F.floor((F.col("_n") + most) / 4096)))))
    cell = W.partitionBy("_h").orderBy("_n")
    errors = []
    for k in candidates:
        before, after = cell.rowsBetween(-k, -1), cell.rowsBetween(1, k)
        total = sum((F.coalesce(F.sum(value).over(w), F.lit(0.0)) for w in (before, after)), F.lit(0.0))
        n = F.count(value).over(before) + F.count(value).over(after)
        errors.append(F.pow(F.col(value) - total / F.nullif(n, F.lit(0)), F.lit(2.0)).alias(f"_e{k}"))
    own = spread.select("_h", "_b", *errors).filter("_h = _b")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_e{k}").alias("e")) for k in candidates])
    return own.select(F.explode(pairs).alias("p")).groupBy("p.k").agg(F.avg("p.e").alias("error"))


def density_acceptance(counts: DataFrame, axis: str, weight: str, bandwidth: float, reach: int, floor_share: float) -> DataFrame:
    """Gaussian density over an integer axis and the acceptance that evens it out, never under ``floor_share``.

    ``counts`` has a row for each value of the axis, so the kernel's join is over values and not over rows.
    """
    other = counts.select(F.col(axis).alias("_x"), F.col(weight).alias("_w"))
    near = counts.select(axis).join(other, F.abs(F.col(axis) - F.col("_x")) <= reach)
    density = near.groupBy(axis).agg(F.sum(F.col("_w") * F.exp(-0.5 * F.pow((F.col(axis) - F.col("_x")) / F.lit(bandwidth), F.lit(2.0)))).alias("density"))
    least = F.min("density").over(W.partitionBy())
    return density.withColumn("accept", F.greatest(F.lit(floor_share), least / F.col("density")))
