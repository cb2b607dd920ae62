"""Curves, strengths, bootstraps and bounds."""

from pyspark.sql import functions as F

from tidemark.functions.shared import keep
from tidemark.operators import curves as V, dimension as D, ladder as L, uncertainty as Y
from tidemark.queries.joins import BY_YEAR, PAIRS, by_year, pairs
from tidemark.queries.scalars import SHARE
from tidemark.registry import query

YEARS = f"{BY_YEAR}, s AS (SELECT l_partkey, avg(value) AS mean, stddev_samp(value) AS spread, count(*)::INT AS n, count(DISTINCT series) AS series FROM y GROUP BY 1)"


@query("a_replicate_spread", f"WITH {YEARS} SELECT l_partkey, n, round(mean, 12) AS mean, round(spread, 9) AS spread, round(spread / sqrt(n), 9) AS error FROM s WHERE series = 1")
def _(t):
    s = by_year(t).groupBy("l_partkey").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.count("*").cast("int").alias("n"), F.countDistinct("series").alias("series")).filter("series = 1")
    return s.select("l_partkey", "n", F.round("mean", 12).alias("mean"), F.round("spread", 9).alias("spread"), F.round(F.col("spread") / F.sqrt("n"), 9).alias("error"))


CHI = ", ".join(f"({i}, {q}::DOUBLE)" for i, q in enumerate(Y.CHI2_05, 1))


@query("a_dispersion_bound", f"WITH {YEARS}, chi(dof, q) AS (VALUES {CHI}), b AS (SELECT l_partkey, n, CASE WHEN spread > 0 THEN spread * sqrt(dof / q) END AS bound FROM s LEFT JOIN chi ON dof = n - 1) SELECT l_partkey, round(bound, 8) AS bound, round(sqrt(2) * bound, 8) AS floor, CASE WHEN bound IS NULL THEN 'unknown' WHEN 0.05 > sqrt(2) * bound THEN 'cleared' ELSE 'within' END AS verdict FROM b")
def _(t):
    s = by_year(t).groupBy("l_partkey").agg(F.stddev_samp("value").alias("spread"), (F.count("*").cast("int") - 1).alias("dof"))
    b = Y.bounded(s, "spread", "dof").withColumn("floor", F.hypot("bound", "bound"))
    return b.select("l_partkey", F.round("bound", 8).alias("bound"), F.round("floor", 8).alias("floor"), Y.verdict(F.lit(0.05), F.col("floor")).alias("verdict"))


@query("a_seed_spread", """WITH r AS (SELECT l_suppkey % 3 AS arm, l_returnflag AS metric, extract('year' FROM l_shipdate)::INT AS workload, avg(l_discount + 0.0) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT metric, workload, count(*)::BIGINT AS arms, round(stddev_samp(v), 9) AS spread FROM r GROUP BY 1, 2 HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM r)""")
def _(t):
    r = t.steps.groupBy((F.col("l_suppkey") % 3).alias("arm"), F.col("l_returnflag").alias("metric"), F.year("l_shipdate").alias("workload")).agg(F.avg("l_discount").alias("v"))
    arms = r.agg(F.countDistinct("arm").alias("all"))
    cells = r.groupBy("metric", "workload").agg(F.count("*").alias("arms"), F.countDistinct("arm").alias("n"), F.round(F.stddev_samp("v"), 9).alias("spread"))
    return cells.join(arms, F.col("n") == F.col("all")).select("metric", "workload", "arms", "spread")


POISSON = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.73575888234288467 THEN 1 WHEN u < 0.91969860292860584 THEN 2 WHEN u < 0.98101184312384626 THEN 3 WHEN u < 0.99634015317265634 THEN 4 WHEN u < 0.99940581518241833 THEN 5 WHEN u < 0.99991675885071194 THEN 6 WHEN u < 0.99998980080332511 THEN 7 ELSE 8 END"


@query("a_bootstrap", f"""WITH g AS (SELECT l_orderkey, l_returnflag AS metric, sum(l_discount + 0.0) AS total, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, {SHARE.format('boot', "(l_orderkey || ':' || rep)")} AS u FROM g, unnest(range(1, 21)) x(rep)),
v AS (SELECT metric, rep, sum(total * {POISSON}) / sum(n * {POISSON}) AS v FROM r GROUP BY 1, 2) SELECT metric, round(stddev_samp(v), 9) AS dispersion, count(v)::BIGINT AS replicates FROM v GROUP BY 1""")
def _(t):
    totals = t.steps.groupBy("l_orderkey", F.col("l_returnflag").alias("metric")).agg(F.sum("l_discount").alias("total"), F.count("*").alias("n"))
    return Y.bootstrap(totals, "l_orderkey", ["metric"], 20, "boot").withColumn("dispersion", F.round("dispersion", 9))


@query("a_stratified_bootstrap", f"""WITH p AS (SELECT p_size, p_retailprice AS v, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_size) AS n FROM part), s AS (SELECT DISTINCT p_size, n, rep, slot FROM p, unnest(range(1, 21)) a(rep), unnest(range(1, n)) b(slot) WHERE n > 1),
d AS (SELECT p_size, n, rep, floor({SHARE.format('strata', "(p_size || ':' || rep || ':' || slot)")} * n) AS k FROM s), m AS (SELECT rep, sum(v * d.n / (d.n - 1)) / sum(d.n / (d.n - 1)) AS v FROM d JOIN p ON p.p_size = d.p_size AND p.k = d.k GROUP BY 1) SELECT round(stddev_samp(v), 6) AS dispersion, count(*)::BIGINT AS replicates FROM m""")
def _(t):
    return Y.stratified_bootstrap(t.part, "p_size", "p_partkey", "p_retailprice", 20, "strata").withColumn("dispersion", F.round("dispersion", 6))


def rounds_sql(rounds):
    """The rounds written out, more than it takes to settle; each is a table of its own."""
    low, top = 10.0 ** (-1200 / L.SCALE), 10.0 ** (1200 / L.SCALE)
    parts = [
        "sides AS MATERIALIZED (SELECT seat, other, sum(g) AS g, sum(p) AS p FROM (SELECT a AS seat, b AS other, (wins + draws + losses)::DOUBLE AS g, points AS p FROM pairs UNION ALL SELECT b, a, (wins + draws + losses)::DOUBLE, wins + draws + losses - points FROM pairs) WHERE g > 0 GROUP BY 1, 2)",
        "pts AS MATERIALIZED (SELECT seat, sum(p) AS points FROM sides GROUP BY 1)", "x0 AS MATERIALIZED (SELECT seat, 1.0::DOUBLE AS s FROM pts)",
    ]
    for i in range(rounds):
        parts.append(f"y{i} AS MATERIALIZED (SELECT seat, least({top}, greatest({low}, CASE WHEN points > 0 THEN points / load ELSE {low} END)) AS s FROM pts JOIN (SELECT d.seat, sum(g / (u.s + v.s)) AS load FROM sides d JOIN x{i} u ON u.seat = d.seat JOIN x{i} v ON v.seat = d.other GROUP BY 1) USING (seat))")
        parts.append(f"x{i + 1} AS MATERIALIZED (SELECT seat, least({top}, greatest({low}, s / (SELECT exp(avg(ln(s))) FROM y{i}))) AS s FROM y{i})")
    return ", ".join(parts)


BT_ROUNDS = 60


@query("a_bradley_terry", f"WITH {PAIRS}, {rounds_sql(BT_ROUNDS)}, r AS (SELECT seat, 400 * log10(s) AS r FROM x{BT_ROUNDS}) SELECT seat, round(r - (SELECT avg(r) FROM r WHERE seat < 5) + 1500, 3) AS rating, abs(abs(r) - 1200) <= 1e-6 AS separated, true AS anchored, true AS settled FROM r")
def _(t):
    anchors = t.nation.filter("n_nationkey < 5").select(F.col("n_nationkey").alias("seat"))
    return L.fitted_ratings(pairs(t), anchors, tolerance=1e-7).select("seat", F.round("rating", 3).alias("rating"), "separated", "anchored", "settled")


@query("a_multinomial_refit")
def _(t):
    fits = L.bradley_terry(L.redrawn(pairs(t), 20, "refit"), 10, ("rep",))
    return fits.groupBy("seat").agg(F.round(F.stddev_samp(F.log("strength")), 9).alias("dispersion"), F.count("*").alias("replicates"))


@query("a_fitted_rating", """WITH c AS (SELECT p_size * 20 AS r, count(*) AS n, sum((p_retailprice > 1000)::INT * 0.6) AS s FROM part GROUP BY 1), g AS (SELECT -1000 + i * 0.5::DOUBLE AS own FROM unnest(range(0, 8001)) x(i)),
o AS (SELECT own, sum(n / (1 + exp(least(15.0, greatest(-15.0, (r - own) * ln(10.0::DOUBLE) / 400))))) - (SELECT sum(s) FROM c) AS over FROM g, c GROUP BY 1), l AS (SELECT own, over, lag(over) OVER (ORDER BY own) AS before FROM o)
SELECT round(coalesce(max(CASE WHEN before < 0 AND over >= 0 THEN own - 0.5 + 0.5 * -before / (over - before) END), CASE WHEN min(over) >= 0 THEN -1000.0 ELSE 3000.0 END), 5)::DOUBLE AS rating FROM l""")
def _(t):
    rows = t.part.select((F.col("p_size") * 20).alias("rating"), F.when(F.col("p_retailprice") > 1000, 0.6).otherwise(0.0).alias("score"))
    return L.fitted_rating(rows, "rating", "score", -1000.0, 3000.0, 0.5).select(F.round("rating", 5).alias("rating"))


@query("a_rating_density", """WITH n AS (SELECT l_orderkey, count(*) AS plies FROM lineitem GROUP BY 1), c AS (SELECT floor(o_totalprice / 1000)::BIGINT AS rating, sum(plies) AS w FROM orders JOIN n ON l_orderkey = o_orderkey GROUP BY 1),
d AS (SELECT a.rating, sum(b.w * exp(-0.5 * ((a.rating - b.rating) / 25.0::DOUBLE) ** 2)) AS density FROM c a JOIN c b ON abs(a.rating - b.rating) <= 200 GROUP BY 1) SELECT rating, round(density, 6) AS density, round(greatest(0.2, min(density) OVER () / density), 9) AS accept FROM d""")
def _(t):
    plies = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("plies"))
    counts = t.orders.join(plies, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.floor(F.col("o_totalprice") / 1000).alias("rating")).agg(F.sum("plies").alias("w"))
    out = V.density_acceptance(counts, "rating", "w", 25.0, 200, 0.2)
    return out.select("rating", F.round("density", 6).alias("density"), F.round("accept", 9).alias("accept"))


def observed(t, condition=None, *more):
    plies = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("plies"))
    rows = t.orders.join(plies, F.col("l_orderkey") == F.col("o_orderkey"))
    return (rows.filter(condition) if condition is not None else rows).select("o_orderkey", "o_custkey", "o_totalprice", F.col("plies").cast("double").alias("plies"), *more)


def grid(t):
    return t.spark.createDataFrame([(50000.0,), (150000.0,), (250000.0,)], "point double")


OBS = "obs AS (SELECT o_orderkey, o_custkey, o_totalprice, plies::DOUBLE AS plies, o_orderpriority FROM orders JOIN (SELECT l_orderkey, count(*) AS plies FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def curve_sql(name, where, k):
    return f"""{name}_d AS (SELECT point, abs(o_totalprice - point) AS dist, plies FROM obs, (SELECT unnest([50000.0, 150000.0, 250000.0])::DOUBLE AS point) WHERE {where}), {name}_k AS (SELECT point, dist AS radius FROM {name}_d QUALIFY row_number() OVER (PARTITION BY point ORDER BY dist) = {k}),
 {name}_w AS (SELECT point, plies, (1 - least(1.0, dist / radius) ** 3) ** 3 AS w FROM {name}_d JOIN {name}_k USING (point) WHERE dist <= radius + 1e-9), {name} AS (SELECT point, sum(w * plies) / sum(w) AS value, sum(w) ** 2 / sum(w * w) AS effective, count(*) FILTER (WHERE w > 0)::BIGINT AS games FROM {name}_w GROUP BY 1)"""


@query("a_local_curve", f"WITH {OBS}, {curve_sql('c', 'true', 100)} SELECT point, round(value, 8) AS value, round(effective, 6) AS effective, games FROM c")
def _(t):
    out = V.local_curve(observed(t), grid(t), "o_totalprice", "plies", 100)
    return out.select("point", F.round("value", 8).alias("value"), F.round("effective", 6).alias("effective"), "games")


URGENT = "o_orderpriority = '1-URGENT'"


def both_curves(k=50):
    """Curves ``a`` (the reference) and ``b``, both within the radii of ``a``, and their points."""
    near = lambda name, where: f"""{name}_w AS (SELECT point, o_orderkey, o_custkey, plies, (1 - least(1.0, abs(o_totalprice - point) / radius) ** 3) ** 3 AS w FROM obs, a_k WHERE {where} AND abs(o_totalprice - point) <= radius + 1e-9),
 {name} AS (SELECT point, sum(w * plies) / sum(w) AS value, sum(w) ** 2 / sum(w * w) AS effective FROM {name}_w GROUP BY 1)"""  # noqa: E731
    return f"""{OBS}, a_k AS (SELECT point, dist AS radius FROM (SELECT point, abs(o_totalprice - point) AS dist FROM obs, (SELECT unnest([50000.0, 150000.0, 250000.0])::DOUBLE AS point) WHERE {URGENT}) QUALIFY row_number() OVER (PARTITION BY point ORDER BY dist) = {k}),
 {near('a', URGENT)}, {near('b', f'NOT ({URGENT})')}, pts AS (SELECT point, a.value AS l, b.value AS r, abs(a.value - b.value) AS distance, least(a.effective, b.effective) >= 20 AS supported FROM a JOIN b USING (point))"""


def two_sides(t):
    rows = keep(observed(t, None, "o_orderpriority"), "sides")  # read many times
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return rows.filter(urgent), rows.filter(~urgent)


@query("a_compare_curves", f"""WITH {both_curves()}, s AS (SELECT avg(distance) AS conditional, abs(avg(l) - avg(r)) AS pooled, avg(abs(l - ml)) AS lv, avg(abs(r - mr)) AS rv FROM (SELECT *, avg(l) OVER () AS ml, avg(r) OVER () AS mr FROM pts WHERE supported))
SELECT point, round(distance, 8) AS distance, supported, round(conditional, 8) AS conditional, round(pooled, 8) AS pooled, round(lv, 8) AS left_variation, round(rv, 8) AS right_variation FROM pts, s""")
def _(t):
    points = V.compare_curves(*two_sides(t), grid(t), "o_totalprice", "plies", 50, 20.0)
    summary = V.curve_summary(points).select(*[F.round(c, 8).alias(c) for c in ("conditional", "pooled", "left_variation", "right_variation")])
    return points.select("point", F.round("distance", 8).alias("distance"), "supported").crossJoin(F.broadcast(summary))


def redraw_sql(name, side, streams):
    u = SHARE.format(f"curve:{side}", "(o_custkey || ':' || rep)")
    return f"""{name}_r AS (SELECT point, rep, sum(w * c * plies) / nullif(sum(w * c), 0) AS v FROM (SELECT point, w, plies, rep, {POISSON} AS c FROM (SELECT *, {u} AS u FROM {name}_w, unnest(range(1, 21)) x(rep))) GROUP BY 1, 2),
 {name}_s AS (SELECT sqrt(n / (n - 1)) AS s FROM (SELECT count(DISTINCT o_custkey)::DOUBLE AS n FROM obs WHERE {streams}))"""


@query("a_curve_resample", f"""WITH {both_curves()}, {redraw_sql('a', 'left', URGENT)}, {redraw_sql('b', 'right', f'NOT ({URGENT})')},
 reps AS (SELECT p.*, a_r.rep, a_r.v AS lv, b_r.v AS rv, a_s.s AS ls, b_s.s AS rs FROM pts p JOIN a_r USING (point) JOIN b_r ON b_r.point = p.point AND b_r.rep = a_r.rep, a_s, b_s),
 own AS (SELECT o_orderkey, plies, row_number() OVER (ORDER BY o_orderkey) AS i FROM obs WHERE NOT ({URGENT})),
 dealt AS (SELECT rep, plies, row_number() OVER (PARTITION BY rep ORDER BY sha256('curve:deal' || chr(0) || o_orderkey || ':' || rep), o_orderkey) AS i FROM own, unnest(range(1, 21)) x(rep)),
 flat AS (SELECT point, rep, sum(w * d.plies) / sum(w) AS v FROM b_w JOIN own USING (o_orderkey) JOIN dealt d ON d.i = own.i GROUP BY 1, 2),
 centred AS (SELECT point, rep, abs(v - avg(v) OVER (PARTITION BY rep)) AS x FROM flat JOIN pts USING (point) WHERE supported),
 m AS (SELECT *, avg(rv) FILTER (WHERE supported) OVER (PARTITION BY rep) AS mid, (lv - l) * ls AS el, (rv - r) * rs AS er FROM reps),
 per AS (SELECT rep, avg(abs(l - rv)) AS c, abs(avg(l) - avg(rv)) AS p, avg(abs(rv - mid)) AS v, avg(abs(el - er)) AS nc, abs(avg(el) - avg(er)) AS np, max(rs) AS rs FROM m WHERE supported GROUP BY 1),
 s AS (SELECT avg(distance) AS c, abs(avg(l) - avg(r)) AS p, avg(abs(r - mr)) AS v FROM (SELECT *, avg(r) OVER () AS mr FROM pts WHERE supported)),
 f AS (SELECT avg(v) + 2 * stddev_samp(v) AS flat FROM (SELECT rep, avg(x) AS v FROM centred GROUP BY 1)),
 sums AS (SELECT stddev_samp(c) * max(rs) AS cd, stddev_samp(p) * max(rs) AS pd, stddev_samp(v) * max(rs) AS vd, avg(nc) + 2 * stddev_samp(nc) AS cl, avg(np) + 2 * stddev_samp(np) AS pl FROM per),
 points AS (SELECT point, max(distance) AS value, stddev_samp(abs(l - rv)) * max(rs) AS dispersion, avg(abs(el - er)) + 2 * stddev_samp(abs(el - er)) AS level FROM m GROUP BY 1),
 pf AS (SELECT point, avg(x) + 2 * stddev_samp(x) AS flat FROM centred GROUP BY 1),
 everything AS (SELECT 'point' AS kind, point, value, dispersion, level, flat FROM points LEFT JOIN pf USING (point) UNION ALL SELECT 'conditional', NULL, c, cd, cl, NULL FROM s, sums UNION ALL SELECT 'pooled', NULL, p, pd, pl, NULL FROM s, sums UNION ALL SELECT 'variation', NULL, v, vd, NULL, flat FROM s, sums, f)
SELECT kind, point, round(value, 7) AS value, round(dispersion, 7) AS dispersion, round(level, 7) AS level, round(flat, 7) AS flat FROM everything""")
def _(t):
    out = V.curve_levels(*two_sides(t), grid(t), "o_totalprice", "plies", "o_custkey", "o_orderkey", 50, 20, "curve", least=20.0)
    return out.select("kind", "point", *[F.round(c, 7).alias(c) for c in ("value", "dispersion", "level", "flat")])


@query("a_bandwidth_cv", f"WITH {OBS}, r AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM obs) " + " UNION ALL ".join(f"SELECT {k} AS k, round(avg((plies - (coalesce(b, 0) + coalesce(a, 0)) / (nb + na)) ** 2), 7) AS error FROM (SELECT plies, sum(plies) OVER (ORDER BY n ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS b, sum(plies) OVER (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) AS a, count(*) OVER (ORDER BY n ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS nb, count(*) OVER (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) AS na FROM r)" for k in (5, 20)))
def _(t):
    out = V.leave_one_out(observed(t).select("o_totalprice", "o_orderkey", "plies"), ["o_totalprice", "o_orderkey"], "plies", (5, 20))
    return out.select("k", F.round("error", 7).alias("error"))


# the label in force after a step is the greatest one so far; depths go down to where no order's label moves
@query("a_depth_divergence", """WITH {STEPS}, r AS (SELECT l_orderkey, step, max(l_returnflag || l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY step) AS label FROM steps), fin AS (SELECT l_orderkey, max_by(label, step) AS f FROM r GROUP BY 1),
z AS (SELECT coalesce(max(step), 0) + 1 AS settled FROM r JOIN fin USING (l_orderkey) WHERE label <> f), x AS (SELECT step AS depth, label, count(*) FILTER (WHERE l_orderkey % 2 = 0) AS a, count(*) FILTER (WHERE l_orderkey % 2 = 1) AS b FROM r, z WHERE step <= settled GROUP BY 1, 2),
d AS (SELECT depth, sum(abs(a / sa::DOUBLE - b / sb::DOUBLE)) / 2 AS distance FROM (SELECT *, sum(a) OVER (PARTITION BY depth) AS sa, sum(b) OVER (PARTITION BY depth) AS sb FROM x) GROUP BY 1),
n AS (SELECT *, lag(distance) OVER (ORDER BY depth) AS e, lag(depth) OVER (ORDER BY depth) AS before, (SELECT max_by(distance, depth) FROM d) / 2 AS target FROM d),
h AS (SELECT min_by(CASE WHEN e IS NULL THEN depth::DOUBLE ELSE before + (target - e) / (distance - e) * (depth - before) END, depth) AS half FROM n WHERE distance >= target AND (SELECT count(*) FROM d) > 1 AND target > 0)
SELECT depth, round(distance, 9) AS distance, settled::INT AS settled, round(half, 7) AS half FROM d, z, h""")
def _(t):
    from pyspark.sql import Window as W

    run = W.partitionBy("l_orderkey").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    rows = keep(t.steps.select("l_orderkey", "step", F.max(F.concat("l_returnflag", "l_linestatus")).over(run).alias("label")), "labels")
    settled = V.settled_depth(rows, "l_orderkey", "step", "label")
    kept = rows.crossJoin(F.broadcast(settled)).filter("step <= settled")
    points = keep(V.divergence_by_depth(kept, F.col("l_orderkey") % 2 == 0, "step", "label"), "depths")
    half = V.half_divergence(points.withColumnRenamed("distance", "excess"))
    return points.crossJoin(F.broadcast(settled)).crossJoin(F.broadcast(half)).select("depth", F.round("distance", 9).alias("distance"), "settled", F.round("half", 7).alias("half"))


PLIES, THRESHOLD = 4, 0.004
TRANSITIONS = "n AS (SELECT l_returnflag || l_suppkey % 20 AS state, lead(l_returnflag || l_suppkey % 20) OVER (PARTITION BY l_orderkey ORDER BY step) AS nxt FROM steps), tr AS (SELECT state, nxt, n / sum(n) OVER (PARTITION BY state)::DOUBLE AS p FROM (SELECT state, nxt, count(*) AS n FROM n GROUP BY 1, 2)), moves AS (FROM tr WHERE nxt IS NOT NULL)"


def ledger_sql(moves, known, plies=PLIES, threshold=THRESHOLD):
    """The walk level by level: ``f0`` is given, each next frontier is merged by state."""
    known = f"state IN ({known})" if known else "false"
    parts = []
    for i in range(plies):
        parts.append(f"f{i + 1} AS (SELECT m.nxt AS state, sum(f.mass * m.p) AS mass FROM f{i} f JOIN {moves} m USING (state) WHERE f.mass >= {threshold} AND m.p > 0 GROUP BY 1)")
    rows = " UNION ALL ".join(
        f"SELECT CASE WHEN {known} THEN 'pruned' ELSE 'unsettled' END AS kind, state, mass FROM f{i} WHERE mass < {threshold} UNION ALL SELECT 'terminal', f.state, mass * greatest(0, 1 - coalesce(q.spent, 0)) FROM f{i} f LEFT JOIN (SELECT state, sum(p) AS spent FROM {moves} GROUP BY 1) q USING (state) WHERE f.mass >= {threshold}"
        for i in range(plies)
    )
    return f"{', '.join(parts)}, ledger AS ({rows} UNION ALL SELECT 'settled', state, mass FROM f{plies}) SELECT kind, state, round(sum(mass), 9) AS mass FROM ledger WHERE mass > 0 GROUP BY 1, 2"


def transitions(t):
    """Shares of what follows a state; the ends of orders are what the shares leave over."""
    from pyspark.sql import Window as W

    state = F.concat("l_returnflag", (F.col("l_suppkey") % 20).cast("string"))
    rows = t.steps.select(state.alias("state"), F.lead(state).over(W.partitionBy("l_orderkey").orderBy("step")).alias("next"))
    counted = rows.groupBy("state", "next").agg(F.count("*").alias("n"))
    return counted.select("state", "next", (F.col("n") / F.sum("n").over(W.partitionBy("state"))).alias("p")).filter("next is not null")


@query("a_path_mass", f"WITH {{STEPS}}, {TRANSITIONS}, f0 AS (SELECT min(state) AS state, 1.0::DOUBLE AS mass FROM moves), {ledger_sql('moves', 'SELECT state FROM tr WHERE left(state, 1) = chr(82)')}")
def _(t):
    tr = keep(transitions(t), "transitions")
    start = tr.agg(F.min("state").alias("state")).withColumn("mass", F.lit(1.0))
    ledger = D.path_mass(tr, start, PLIES, THRESHOLD, tr.select("state").filter("startswith(state, 'R')"))
    return ledger.select("kind", "state", F.round("mass", 9).alias("mass"))


@query("f_response_verdict", f"""WITH {both_curves()} SELECT point, CASE WHEN distance > 2 THEN 'mismatch' WHEN distance <= 0.2 THEN 'matches' WHEN distance <= 0.5 THEN 'average' ELSE 'divergent' END AS verdict FROM pts""")
def _(t):
    out = V.compare_curves(*two_sides(t), grid(t), "o_totalprice", "plies", 50, 20.0)
    d = F.col("distance")
    return out.select("point", F.when(d > 2, "mismatch").when(d <= 0.2, "matches").when(d <= 0.5, "average").otherwise("divergent").alias("verdict"))
