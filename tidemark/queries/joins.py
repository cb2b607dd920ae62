"""Joins."""

from pyspark.sql import Window as W, functions as F

from tidemark.functions import hashing as H
from tidemark.functions.shared import parted, shared_path
from tidemark.operators import compare as C, dimension as D, selection as X
from tidemark.queries.scalars import RANK, SHARE, SPLIT
from tidemark.registry import query

YEAR = "extract('year' FROM l_shipdate)::INT"


@query("j_marked_anti", "SELECT l_orderkey, step FROM (WITH {STEPS} SELECT * FROM steps) s WHERE l_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) AND l_partkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def _(t):
    return X.without_marked(t.steps, t.customer.filter("c_custkey % 10 = 0"), "c_custkey", ["l_suppkey", "l_partkey"]).select("l_orderkey", "step")


@query("j_leak_semi", f"SELECT DISTINCT o_custkey FROM orders WHERE {SPLIT} = 'test' AND o_custkey IN (SELECT o_custkey FROM orders WHERE {SPLIT} = 'train')")
def _(t):
    rows = t.orders.withColumn("split", H.split_of("split", F.col("o_orderkey"), 0.2, 0.1))
    return rows.filter("split = 'test'").join(rows.filter("split = 'train'"), "o_custkey", "left_semi").select("o_custkey").distinct()


@query("j_containment_anti", f"WITH a AS (SELECT o_orderkey FROM orders WHERE {SHARE.format('gen', 'o_orderkey')} < 0.2), b AS (SELECT o_orderkey FROM orders WHERE {SHARE.format('gen', 'o_orderkey')} < 0.3) SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b))::BIGINT AS missing, (SELECT count(*) FROM (FROM b EXCEPT FROM a))::BIGINT AS added")
def _(t):
    part = lambda f: t.orders.filter(H.hash_fraction("gen", F.col("o_orderkey")) < f).select("o_orderkey")
    old, new = part(0.2), part(0.3)
    missing = old.join(new, "o_orderkey", "left_anti").agg(F.count("*").alias("missing"))
    return missing.crossJoin(new.join(old, "o_orderkey", "left_anti").agg(F.count("*").alias("added")))


@query("j_leakage_recipe", f"WITH held AS (SELECT o_orderkey, {SPLIT} AS split FROM orders WHERE {SHARE.format('gen', 'o_orderkey')} < 0.2) SELECT 'verified' AS state, count(*) FILTER (WHERE split = 'train')::BIGINT AS leaked, count(*)::BIGINT AS held FROM held UNION ALL SELECT 'unverified', NULL, count(*)::BIGINT FROM held")
def _(t):
    from tidemark.plans.pools import check_leakage, write_recipe

    held = t.orders.filter(H.hash_fraction("gen", F.col("o_orderkey")) < 0.2)
    path = shared_path(t.spark, "recipe")
    write_recipe(t.spark, path, seed="split", validation=0.2, test=0.1)
    same = check_leakage(held, "o_orderkey", path, seed="split", validation=0.2, test=0.1)
    return same.unionByName(check_leakage(held, "o_orderkey", path, seed="split", validation=0.2, test=0.2))


@query("j_unanswered_queue", "SELECT user_id, count(*)::BIGINT AS games FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1 ORDER BY user_id % 4 = 1 DESC, games DESC, user_id LIMIT 10")
def _(t):
    counted = t.events.groupBy("user_id").agg(F.count("*").alias("games"))
    open_ = counted.join(t.customer.filter("c_custkey % 3 = 0"), F.col("c_custkey") == F.col("user_id"), "left_anti")
    first = t.customer.filter("c_custkey % 4 = 1").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("prio"))
    return open_.join(first, "user_id", "left").orderBy(F.col("prio").isNotNull().desc(), F.desc("games"), "user_id").limit(10).select("user_id", "games")


@query("j_restrict_inner", "WITH n AS (SELECT user_id, count(*) AS games FROM events GROUP BY 1) SELECT user_id, games::BIGINT AS games, c_acctbal < 0 AS marked FROM n JOIN customer ON c_custkey = user_id")
def _(t):
    halves = [t.events.filter(F.col("event_id") % 2 == i).groupBy("user_id").agg(F.count("*").alias("games")) for i in (0, 1)]
    counted = halves[0].unionByName(halves[1]).groupBy("user_id").agg(F.sum("games").alias("games"))
    return counted.join(t.customer, F.col("c_custkey") == F.col("user_id")).select("user_id", "games", (F.col("c_acctbal") < 0).alias("marked"))


@query("j_book_deepest", "WITH {STEPS}, h AS (SELECT l_orderkey, max_by(p_brand, step) AS code, max_by(p_name, step) AS name, max(step) AS depth FROM steps JOIN part ON p_partkey = l_partkey AND p_size <= 15 GROUP BY 1) SELECT DISTINCT s.l_orderkey, code, name, depth FROM steps s LEFT JOIN h USING (l_orderkey)")
def _(t):
    book = t.part.filter("p_size <= 15").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code"), F.col("p_name").alias("name"))
    return D.deepest(t.steps, book, "l_orderkey", "step", "l_partkey", ["code", "name"])


@query("j_continuations", """WITH {STEPS}, d AS (SELECT l_orderkey, max(step) AS deep, max_by(p_brand, step) AS brand, max_by(p_type, step) AS type, max_by(p_name, step) AS name FROM steps JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_partkey, max(deep) AS available, count(DISTINCT brand)::BIGINT AS n_brand, count(DISTINCT type)::BIGINT AS n_type, count(DISTINCT name)::BIGINT AS n_name FROM (SELECT DISTINCT l_orderkey, l_partkey FROM steps) JOIN d USING (l_orderkey) GROUP BY 1""")
def _(t):
    steps = t.as_steps(parted(t.lineitem, "l_orderkey"))
    paths = steps.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "step", "l_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name"))
    return D.continuations(paths, "l_orderkey", "l_partkey", "step", ["brand", "type", "name"])


@query("j_adjudicate", "WITH {STEPS} SELECT l_returnflag AS predicate, count(*)::BIGINT AS n, sum((l_suppkey % 4 = l_partkey % 4)::INT)::BIGINT AS successes, round(sum(l_tax), 6) AS mass FROM steps JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def _(t):
    scored = t.steps.select("l_orderkey", "step", F.col("l_returnflag").alias("predicate"), F.col("l_tax").alias("mass"), (F.col("l_suppkey") % 4).alias("chosen"))
    inputs = t.steps.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "step", F.col("l_returnflag").alias("predicate"), F.array(F.col("l_partkey") % 4).alias("winning"))
    both = inputs.join(scored, ["l_orderkey", "step", "predicate"], "left")
    both = both.withColumn("chosen", F.when(F.col("mass").isNull(), F.raise_error(F.lit("a score is missing")).cast("bigint")).otherwise(F.col("chosen")))
    return both.groupBy("predicate").agg(F.count("*").alias("n"), F.count_if(F.array_contains("winning", F.col("chosen"))).alias("successes"), F.round(F.sum("mass"), 6).alias("mass"))


@query("j_slice_labels", "WITH {STEPS} SELECT n_name AS nation, o_orderpriority AS priority, count(*)::BIGINT AS n, round(avg(l_discount), 9) AS loss FROM steps JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def _(t):
    labels = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = t.steps.join(labels, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("loss"))


@query("j_pool_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def _(t):
    ids = t.lineitem.filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("j_cost_quality", "WITH c AS (SELECT user_id, max_by(value, ts) AS cost FROM events WHERE event_type = 'click' GROUP BY 1), q AS (SELECT user_id, max_by(value, ts) AS quality FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id, cost, quality FROM c JOIN q USING (user_id)")
def _(t):
    newest = lambda kind, name: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max_by("value", "ts").alias(name))
    return newest("click", "cost").join(newest("purchase", "quality"), "user_id")


@query("j_best_within", "WITH b AS (SELECT unnest([1000, 20000, 60000, 150000, 400000]) AS budget) SELECT budget::BIGINT AS budget, max_by(o_orderkey, (o_custkey, -o_totalprice, o_orderkey)) AS label, max(o_custkey) AS quality FROM b LEFT JOIN orders ON o_totalprice <= budget GROUP BY 1")
def _(t):
    points = t.orders.select(F.col("o_totalprice").alias("cost"), F.col("o_custkey").alias("quality"), F.col("o_orderkey").alias("label"))
    budgets = t.spark.createDataFrame([(x,) for x in (1000, 20000, 60000, 150000, 400000)], "budget long")
    return C.best_within(points, budgets, "cost", "budget", "quality", "label").select("budget", "label", "quality")


BY_YEAR = "y AS (SELECT l_partkey, extract('year' FROM l_shipdate)::INT AS year, round(avg(l_discount + 0.0), 9) AS value, max(l_suppkey % 2) AS series FROM lineitem GROUP BY 1, 2)"


def by_year(t):
    return t.lineitem.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(F.round(F.avg(F.col("l_discount") + 0.0), 9).alias("value"), F.max(F.col("l_suppkey") % 2).alias("series"))


@query("j_delta", f"""WITH {BY_YEAR}, b AS (FROM y WHERE year = 1994), c AS (FROM y WHERE year = 1995)
SELECT coalesce(b.l_partkey, c.l_partkey) AS l_partkey, b.value AS baseline, c.value AS current, CASE WHEN b.value IS NULL THEN 'added' WHEN c.value IS NULL THEN 'removed' WHEN b.series <> c.series THEN 'incomparable' ELSE 'comparable' END AS state,
 CASE WHEN b.series = c.series THEN round(c.value - b.value, 8) END AS delta FROM b FULL JOIN c ON b.l_partkey = c.l_partkey""")
def _(t):
    y = by_year(t)
    out = C.deltas(y.filter("year = 1994"), y.filter("year = 1995"), ["l_partkey"], "value", "series")
    return out.withColumn("delta", F.round("delta", 8))


@query("j_delta_environment", """WITH n AS (SELECT user_id, event_type AS env, max(ts) AS newest, max_by(value, ts) AS value FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC) AS k FROM n)
SELECT a.user_id, b.env AS before, a.env AS after, round(a.value - b.value, 8) AS delta FROM r a JOIN r b ON a.user_id = b.user_id AND a.k = 1 AND b.k = 2""")
def _(t):
    newest = t.events.groupBy("user_id", F.col("event_type").alias("env")).agg(F.max("ts").alias("newest"), F.max_by("value", "ts").alias("value"))
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("newest")))
    top = newest.withColumn("k", k).filter("k <= 2").groupBy("user_id").agg(*[F.max(F.when(F.col("k") == i, F.struct("env", "value"))).alias(n) for i, n in ((1, "a"), (2, "b"))])
    return top.filter("b is not null").select("user_id", F.col("b.env").alias("before"), F.col("a.env").alias("after"), F.round(F.col("a.value") - F.col("b.value"), 8).alias("delta"))


@query("j_pair_workloads", """WITH a AS (SELECT DISTINCT l_returnflag || '' AS w FROM lineitem WHERE l_returnflag <> 'A'), b AS (SELECT DISTINCT l_returnflag AS w FROM lineitem WHERE l_returnflag <> 'R'),
u AS (SELECT a.w AS l, b.w AS r FROM a FULL JOIN b ON a.w = b.w) SELECT l AS current, r AS baseline FROM u WHERE l IS NOT NULL AND r IS NOT NULL UNION ALL SELECT max(l), max(r) FROM u WHERE l IS NULL OR r IS NULL HAVING count(l) = 1 AND count(r) = 1""")
def _(t):
    flags = t.lineitem.select(F.col("l_returnflag").alias("w")).distinct()
    a, b = flags.filter("w <> 'A'"), flags.filter("w <> 'R'")
    both = a.withColumn("current", F.col("w")).join(b.withColumn("baseline", F.col("w")), "w", "full").drop("w")
    whole = F.col("current").isNotNull() & F.col("baseline").isNotNull()
    left = both.filter(~whole).agg(F.max("current").alias("current"), F.max("baseline").alias("baseline"), F.count("current").alias("n"), F.count("baseline").alias("m")).filter("n = 1 and m = 1")
    return both.filter(whole).unionByName(left.select("current", "baseline"))


@query("j_provenance_diff", "WITH p AS (SELECT event_id, user_id, props->>'k' AS k, event_type AS e, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) SELECT a.event_id, 'k' AS field, a.k AS before, b.k AS after FROM p a JOIN p b ON a.nxt = b.event_id WHERE a.k IS DISTINCT FROM b.k UNION ALL SELECT a.event_id, 'e', a.e, b.e FROM p a JOIN p b ON a.nxt = b.event_id WHERE a.e <> b.e")
def _(t):
    fields = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("e"), F.col("event_type")))
    rows = t.events.select("event_id", "user_id", "ts", fields.alias("left"))
    rows = rows.withColumn("right", F.lead("left").over(W.partitionBy("user_id").orderBy("ts"))).filter("right is not null")
    return C.map_differences(rows, ["event_id"], "left", "right")


PARTS = 1_000_000_000  # added to part numbers, which would clash with those of suppliers
EDGES = f"e AS (SELECT DISTINCT l_suppkey AS a, {PARTS} + l_partkey AS b FROM lineitem)"


def links(t):
    return t.lineitem.select(F.col("l_suppkey").alias("a"), (PARTS + F.col("l_partkey")).alias("b"))


# each round a node takes the least label around it; DuckDB says so if some label still moves after the last one
ROUNDS = 12
COMPONENTS = (
    f"WITH {EDGES}, s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), c0 AS (SELECT DISTINCT a AS node, a AS label FROM s), "
    + ", ".join(f"c{i + 1} AS (SELECT node, least(any_value(label), min(o)) AS label FROM (SELECT c.node, c.label, d.label AS o FROM c{i} c JOIN s ON s.a = c.node JOIN c{i} d ON d.node = s.b) GROUP BY 1)" for i in range(ROUNDS))
    + f", c AS (SELECT node, label AS component, CASE WHEN (SELECT count(*) FROM c{ROUNDS} JOIN c{ROUNDS - 1} p USING (node) WHERE p.label <> c{ROUNDS}.label) > 0 THEN error('labels still move') END AS settled FROM c{ROUNDS})"
)


@query("j_components", f"{COMPONENTS} SELECT node, component FROM c WHERE settled IS NULL")
def _(t):
    e = links(t)
    return C.classes(e, e.select(F.col("a").alias("node")).union(e.select("b")))


@query("j_overlay_groups", f"{COMPONENTS} SELECT component, l_returnflag AS label, min(l_orderkey * 100 + l_linenumber) AS first_trace, count(*)::BIGINT AS n FROM c JOIN lineitem ON node = l_suppkey WHERE settled IS NULL GROUP BY 1, 2")
def _(t):
    e = links(t)
    found = C.classes(e, e.select(F.col("a").alias("node")))
    traces = t.lineitem.join(found, F.col("node") == F.col("l_suppkey")).select("component", F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("trace"))
    return traces.groupBy("component", "label").agg(F.min("trace").alias("first_trace"), F.count("*").alias("n"))


# chains of two and of four hops written out; a pair further apart would show as a missing chain
@query("j_bridge_chain", f"""WITH {EDGES}, q AS (SELECT DISTINCT b AS source, b + 1 AS target FROM e WHERE (b - {PARTS}) % 50 = 0 AND b + 1 IN (SELECT b FROM e)),
two AS (SELECT source, target, min(x.a) AS s FROM q JOIN e x ON x.b = source JOIN e y ON y.b = target AND y.a = x.a GROUP BY 1, 2),
four AS (SELECT source, target, min((x.a, m.b, y.a)) AS p FROM q JOIN e x ON x.b = source JOIN e m ON m.a = x.a JOIN e z ON z.b = m.b JOIN e y ON y.a = z.a AND y.b = target WHERE (source, target) NOT IN (SELECT (source, target) FROM two) GROUP BY 1, 2)
SELECT source, target, unnest([0, 1, 2]) AS hop, unnest([source, s, target]) AS node FROM two UNION ALL SELECT source, target, unnest([0, 1, 2, 3, 4]), unnest([source, p[1], p[2], p[3], target]) FROM four""")
def _(t):
    part = F.col("b") - F.pmod(F.col("b") - PARTS, F.lit(50))  # of each fifty parts the first, and the one after it
    near = links(t).select("b", part.alias("source")).filter("b - source <= 1")
    pairs = near.groupBy("source").agg(F.min("b").alias("first"), F.max("b").alias("target")).filter("first = source and target = source + 1")
    return C.shortest_chains(pairs, links(t))


@query("j_exact_floor", f"""WITH {BY_YEAR}, m AS (SELECT year, avg(value) AS value, max(series) AS series FROM y GROUP BY 1), f AS (SELECT year, stddev_samp(value) AS spread FROM y WHERE year % 2 = 0 GROUP BY 1)
SELECT m.year, round(spread, 9) AS floor, CASE WHEN spread IS NULL THEN 'no_record' WHEN series <> 1 THEN 'other_series' ELSE 'applies' END AS reason FROM m LEFT JOIN f USING (year)""")
def _(t):
    y = by_year(t)
    floors = y.filter("year % 2 = 0").groupBy("year").agg(F.stddev_samp("value").alias("spread"))
    seen = y.groupBy("year").agg(F.max("series").alias("series")).join(floors, "year", "left")
    return seen.select("year", F.round("spread", 9).alias("floor"), F.when(F.col("spread").isNull(), "no_record").when(F.col("series") != 1, "other_series").otherwise("applies").alias("reason"))


@query("j_round_robin", "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def _(t):
    a, b = t.nation.alias("a"), F.broadcast(t.nation.alias("b"))  # seats are few: one row each, 25 nations
    return a.join(b, F.expr("a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("two"))


GAMES = "games AS (SELECT c_nationkey AS x, s_nationkey AS y, CASE WHEN l_quantity > 30 THEN 1.0 WHEN l_quantity > 20 THEN 0.5 WHEN l_quantity > 3 THEN 0.0 END AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey)"
PAIRS = f"{GAMES}, g AS (SELECT least(x, y) AS a, greatest(x, y) AS b, CASE WHEN x > y THEN 1 - s ELSE s END AS s FROM games), pairs AS (SELECT a, b, count(*) FILTER (WHERE s = 1)::BIGINT AS wins, count(*) FILTER (WHERE s = 0.5)::BIGINT AS draws, count(*) FILTER (WHERE s = 0)::BIGINT AS losses, count(*) FILTER (WHERE s IS NULL)::BIGINT AS unfinished, coalesce(sum(s), 0)::DOUBLE AS points FROM g GROUP BY 1, 2)"


def pairs(t):
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    score = F.when(F.col("l_quantity") > 30, 1.0).when(F.col("l_quantity") > 20, 0.5).when(F.col("l_quantity") > 3, 0.0)
    return C.pair_outcomes(rows.filter("c_nationkey <> s_nationkey"), "c_nationkey", "s_nationkey", score)


@query("j_pair_outcomes", f"WITH {PAIRS} SELECT * FROM pairs")
def _(t):
    return pairs(t)


@query("j_paired_subset", f"WITH {{STEPS}}, d AS (SELECT *, {SHARE.format('dose', '(l_orderkey * 100 + step)')} AS draw FROM steps), k AS (SELECT l_orderkey, step FROM d WHERE draw < 0.3) SELECT round(avg(CASE WHEN draw < 0.3 THEN l_discount END), 9) AS treated, round(avg(l_tax) FILTER (WHERE (l_orderkey, step) IN (SELECT (l_orderkey, step) FROM k)), 9) AS control FROM d")
def _(t):
    rows = t.steps.withColumn("draw", H.hash_fraction("dose", F.col("l_orderkey") * 100 + F.col("step")))
    treated = rows.filter("draw < 0.3")
    control = t.steps.join(treated, ["l_orderkey", "step"], "left_semi").agg(F.round(F.avg("l_tax"), 9).alias("control"))
    return treated.agg(F.round(F.avg("l_discount"), 9).alias("treated")).crossJoin(control)


@query("j_merge_totals", "SELECT l_orderkey, 'loss' AS metric, round(sum(l_discount + 0.0), 6) AS total, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'mass', round(sum(l_tax + 0.0), 6), count(*)::BIGINT FROM lineitem GROUP BY 1")
def _(t):
    one = lambda name, c: t.steps.groupBy("l_orderkey").agg(F.round(F.sum(c), 6).alias("total"), F.count("*").alias("n")).withColumn("metric", F.lit(name))
    merged = one("loss", "l_discount").unionByName(one("mass", "l_tax"))
    return D.checked_dimension(merged.withColumn("key", F.concat_ws("|", "l_orderkey", "metric")), "key").select("l_orderkey", "metric", "total", "n")


@query("j_frequency_tail", "WITH f AS (SELECT p_brand, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM part WHERE p_size > 25 GROUP BY 1), l AS (SELECT p_brand, avg(l_discount + 0.0) AS loss FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT p_brand, round(loss, 9) AS loss, round(coalesce(share, 0), 9) AS share FROM l LEFT JOIN f USING (p_brand)")
def _(t):
    counted = t.part.filter("p_size > 25").groupBy("p_brand").agg(F.count("*").alias("n"))
    share = counted.select("p_brand", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))
    loss = t.steps.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.avg("l_discount").alias("loss"))
    return loss.join(share, "p_brand", "left").select("p_brand", F.round("loss", 9).alias("loss"), F.round(F.coalesce("share", F.lit(0.0)), 9).alias("share"))


@query("j_calibrate", "SELECT floor(l_quantity / 10)::BIGINT AS bucket, count(*)::BIGINT AS n, round(avg((l_returnflag = 'R')::INT), 9) AS observed, round(avg(l_tax + 0.0), 9) AS predicted FROM lineitem GROUP BY 1")
def _(t):
    mass = t.steps.select("l_orderkey", "step", F.col("l_tax").alias("mass"))
    truth = t.steps.select("l_orderkey", "step", F.floor(F.col("l_quantity") / 10).alias("bucket"), (F.col("l_returnflag") == "R").cast("int").alias("hit"))
    return truth.join(mass, ["l_orderkey", "step"]).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 9).alias("observed"), F.round(F.avg("mass"), 9).alias("predicted"))


GRID = "grid AS (SELECT unnest([50000.0, 150000.0, 250000.0])::DOUBLE AS point), d AS (SELECT point, o_orderkey, abs(o_totalprice - point) AS dist FROM orders, grid), k AS (SELECT point, dist AS radius FROM d QUALIFY row_number() OVER (PARTITION BY point ORDER BY dist) = 25)"


@query("j_knn_range", f"WITH {GRID} SELECT point, o_orderkey, round(radius, 6) AS radius FROM d JOIN k USING (point) WHERE dist <= radius + 1e-9")
def _(t):
    grid = t.spark.createDataFrame([(50000.0,), (150000.0,), (250000.0,)], "point double")
    near = C.within_radius(t.orders.select("o_orderkey", "o_totalprice"), grid, "o_totalprice", 25)
    return near.select("point", "o_orderkey", F.round("radius", 6).alias("radius"))
