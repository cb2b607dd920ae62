"""Aggregations: counts, coverage, slices, rates and distances."""

from pyspark.sql import Window as W, functions as F

from tidemark.functions import hashing as H, parsing as P
from tidemark.functions.shared import keep, parted
from tidemark.operators import dimension as D, metrics as M, quantiles as Q, selection as X
from tidemark.queries.joins import PAIRS, pairs
from tidemark.queries.scalars import SPLIT
from tidemark.queries.selections import SCREEN, screened
from tidemark.registry import query


def avg9(c):
    return F.round(F.avg(c), 9)


@query("a_archive_stats", f"WITH {SCREEN}, n AS (SELECT l_orderkey, count(*) AS plies FROM lineitem GROUP BY 1) SELECT coalesce(reason, 'accepted') AS reason, count(*)::BIGINT AS games, sum(coalesce(plies, 0))::BIGINT AS plies, min(plies)::BIGINT AS least, max(plies)::BIGINT AS most, min(o_totalprice) AS low, max(o_totalprice) AS high FROM screened LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    plies = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("plies"))
    rows = screened(t).join(plies, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("games"), F.sum(F.coalesce("plies", F.lit(0))).alias("plies"), F.min("plies").alias("least"), F.max("plies").alias("most"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("a_axis_by_split", f"SELECT o_orderpriority AS axis, count(*) FILTER (WHERE s = 'train')::BIGINT AS train, count(*) FILTER (WHERE s = 'validation')::BIGINT AS validation, count(*) FILTER (WHERE s = 'test')::BIGINT AS test FROM (SELECT *, {SPLIT} AS s FROM orders) GROUP BY 1")
def _(t):
    rows = t.orders.withColumn("split", H.split_of("split", F.col("o_orderkey"), 0.2, 0.1))
    return rows.groupBy(F.col("o_orderpriority").alias("axis")).pivot("split", ["train", "validation", "test"]).count().fillna(0)


@query("a_rollup_archives", "SELECT extract('year' FROM o_orderdate)::INT AS archive, o_orderstatus AS status, count(*)::BIGINT AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ROLLUP (1, 2)")
def _(t):
    return t.orders.select(F.year("o_orderdate").alias("archive"), F.col("o_orderstatus").alias("status"), "o_totalprice").rollup("archive", "status").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("a_int_coverage", "WITH x AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_acctbal < 0 THEN NULL ELSE floor(c_acctbal)::BIGINT END AS v, CASE WHEN c_custkey % 6 = 0 THEN 'unavailable' WHEN c_acctbal < 0 THEN 'rejected' ELSE 'present' END AS status FROM customer) SELECT status, count(*)::BIGINT AS n, min(v) AS low, max(v) AS high FROM x GROUP BY 1")
def _(t):
    text = F.when(F.col("c_custkey") % 6 != 0, F.floor("c_acctbal").cast("string"))
    return t.customer.select(P.optional_int(text).alias("p")).groupBy("p.status").agg(F.count("*").alias("n"), F.min("p.value").cast("long").alias("low"), F.max("p.value").cast("long").alias("high"))


@query("a_pool_coverage", """WITH {STEPS}, l AS (SELECT 'flag' AS dimension, l_returnflag AS value FROM steps UNION ALL SELECT 'side', (step % 2)::VARCHAR FROM steps UNION ALL SELECT 'phase', CASE WHEN step <= 2 THEN 'opening' ELSE 'later' END FROM steps UNION ALL SELECT 'year', extract('year' FROM l_shipdate)::VARCHAR FROM steps)
SELECT dimension, value, count(*)::BIGINT AS n FROM l GROUP BY 1, 2""")
def _(t):
    return M.long_counts(t.steps, flag=F.col("l_returnflag"), side=F.col("step") % 2, phase=F.when(F.col("step") <= 2, "opening").otherwise("later"), year=F.year("l_shipdate"))


@query("a_account_counts", "SELECT name, count(*)::BIGINT AS games FROM (SELECT 's' || l_suppkey AS name FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem) WHERE name NOT LIKE '%7' GROUP BY 1")
def _(t):
    both = t.lineitem.select(F.explode(F.array(F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"))).alias("name"))
    counted = both.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("games"))
    return counted.filter(P.is_account(F.col("name")) & ~F.col("name").endswith("7"))


@query("a_census_coverage", "WITH n AS (SELECT user_id, count(*) AS games FROM events GROUP BY 1), j AS (SELECT n.*, c_acctbal FROM n LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 3 <> 0) SELECT count(*)::BIGINT AS accounts, sum(games)::BIGINT AS slots, count(c_acctbal)::BIGINT AS queried, count(*) FILTER (WHERE c_acctbal < 0)::BIGINT AS marked, round(coalesce(sum(CASE WHEN c_acctbal IS NOT NULL THEN games END), 0) / sum(games)::DOUBLE, 9) AS covered FROM j")
def _(t):
    counted = t.events.groupBy("user_id").agg(F.count("*").alias("games"))
    rows = counted.join(t.customer.filter("c_custkey % 3 <> 0"), F.col("c_custkey") == F.col("user_id"), "left")
    seen = F.col("c_acctbal").isNotNull()
    return rows.agg(F.count("*").alias("accounts"), F.sum("games").alias("slots"), F.count_if(seen).alias("queried"), F.count_if(F.col("c_acctbal") < 0).alias("marked"), F.round(F.sum(F.when(seen, F.col("games")).otherwise(0)) / F.sum("games"), 9).alias("covered"))


SLICED = "sliced AS (SELECT l_orderkey, l_discount, l_tax, l_returnflag, o_orderpriority, p_brand, l_linestatus, l_quantity FROM steps JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"


def sliced(t):
    rows = t.steps.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    cases = F.filter(F.array(F.when(F.col("l_quantity") > 40, "large"), F.when(F.col("l_linestatus") == "O", "open")), lambda c: c.isNotNull())
    return rows.withColumn("cases", cases)


@query("a_slice_table", f"""WITH {{STEPS}}, {SLICED}, s AS (SELECT 'overall' AS dimension, 'all' AS value, * FROM sliced UNION ALL SELECT 'l_returnflag', l_returnflag, * FROM sliced UNION ALL SELECT 'o_orderpriority', o_orderpriority, * FROM sliced UNION ALL SELECT 'p_brand', p_brand, * FROM sliced
 UNION ALL SELECT 'cases', 'large', * FROM sliced WHERE l_quantity > 40 UNION ALL SELECT 'cases', 'open', * FROM sliced WHERE l_linestatus = 'O') SELECT dimension, value, count(*)::BIGINT AS n, round(avg(l_discount), 9) AS loss, round(avg(l_tax), 9) AS mass FROM s GROUP BY 1, 2""")
def _(t):
    return M.slice_table(sliced(t), ["l_returnflag", "o_orderpriority", "p_brand"], "cases", F.count("*").alias("n"), avg9("l_discount").alias("loss"), avg9("l_tax").alias("mass"))


@query("a_position_summary", """WITH x AS (SELECT label, list_transform(embedding, lambda v: v::DOUBLE) AS s, embedding[label % 64 + 1]::DOUBLE AS own FROM embeddings), r AS (SELECT label, ln(list_sum(list_transform(s, lambda v: exp(v)))) - own AS loss, len(list_filter(s, lambda v: v > own)) + 1 AS rank FROM x)
SELECT label, count(*)::BIGINT AS n, round(avg(loss), 8) AS loss, round(avg((rank <= 1)::INT), 9) AS top1, round(avg((rank <= 5)::INT), 9) AS top5, round(ln(64.0::DOUBLE), 9) AS uniform FROM r GROUP BY 1""")
def _(t):
    from tidemark.functions.scores import policy_columns
    from tidemark.queries.scalars import _scores

    cols = policy_columns(F.col("scores"), F.transform("scores", lambda v: F.lit(True)), F.col("target"))
    rows = _scores(t).select("label", "scores", cols["loss"].alias("loss"), cols["rank"].alias("rank"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 8).alias("loss"), avg9((F.col("rank") <= 1).cast("int")).alias("top1"), avg9((F.col("rank") <= 5).cast("int")).alias("top5"), F.round(F.max(F.log(F.size("scores").cast("double"))), 9).alias("uniform"))


@query("a_per_game_totals", "WITH {STEPS}, m AS (SELECT l_orderkey, 'loss' AS metric, l_discount AS v FROM steps UNION ALL SELECT l_orderkey, 'loss/' || l_returnflag, l_discount FROM steps UNION ALL SELECT l_orderkey, 'mass', l_tax FROM steps) SELECT l_orderkey, metric, round(sum(v), 6) AS total, count(*)::BIGINT AS n FROM m GROUP BY 1, 2")
def _(t):
    item = lambda name, v: F.struct(name.alias("metric"), F.col(v).alias("v"))
    rows = t.steps.select("l_orderkey", F.explode(F.array(item(F.lit("loss"), "l_discount"), item(F.concat(F.lit("loss/"), "l_returnflag"), "l_discount"), item(F.lit("mass"), "l_tax"))).alias("m"))
    return rows.groupBy("l_orderkey", "m.metric").agg(F.round(F.sum("m.v"), 6).alias("total"), F.count("*").alias("n"))


FEATURES = "features AS (SELECT l_orderkey, count(*) AS length, count(DISTINCT l_suppkey)::DOUBLE / count(*) AS distinct_share, count(*) - count(DISTINCT l_suppkey) AS repeats, sum(CASE WHEN step % 2 = 1 THEN l_quantity ELSE -l_quantity END) AS balance, sha256(string_agg(l_suppkey::VARCHAR, ',' ORDER BY step)) AS trajectory, max_by(l_returnflag, step) AS ended FROM steps GROUP BY 1)"


def features(t):
    order = F.transform(F.array_sort(F.collect_list(F.struct("step", "l_suppkey"))), lambda s: s["l_suppkey"].cast("string"))
    side = F.when(F.col("step") % 2 == 1, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return t.steps.groupBy("l_orderkey").agg(F.count("*").alias("length"), (F.size(F.collect_set("l_suppkey")) / F.count("*")).alias("distinct_share"), (F.count("*") - F.size(F.collect_set("l_suppkey"))).alias("repeats"), F.sum(side).alias("balance"), F.sha2(F.array_join(order, ","), 256).alias("trajectory"), F.max_by("l_returnflag", "step").alias("ended"))


@query("a_game_features", f"WITH {{STEPS}}, {FEATURES} SELECT l_orderkey, length, round(distinct_share, 9) AS distinct_share, repeats, balance, trajectory, ended FROM features")
def _(t):
    return features(t).withColumn("distinct_share", F.round("distinct_share", 9))


@query("a_game_distribution", f"WITH {{STEPS}}, {FEATURES} SELECT ended, count(*)::BIGINT AS games, round(avg(length), 9) AS length, round(avg(distinct_share) FILTER (WHERE length > 1), 9) AS distinct_share, round(count(DISTINCT trajectory)::DOUBLE / count(*), 9) AS distinct_games FROM features GROUP BY 1")
def _(t):
    return features(t).groupBy("ended").agg(F.count("*").alias("games"), avg9("length").alias("length"), avg9(F.when(F.col("length") > 1, F.col("distinct_share"))).alias("distinct_share"), F.round(F.countDistinct("trajectory") / F.count("*"), 9).alias("distinct_games"))


@query("a_label_distribution", "WITH {STEPS}, l AS (SELECT l_orderkey, max_by(p_brand, step) FILTER (WHERE p_size <= 15) AS label, count(DISTINCT p_brand) FILTER (WHERE p_size <= 15) AS reachable FROM steps JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT coalesce(label, 'unclassified') AS label, count(*)::BIGINT AS n, count(*) FILTER (WHERE reachable = 1)::BIGINT AS destinations FROM l GROUP BY 1")
def _(t):
    named = F.col("p_size") <= 15
    brand = F.when(named, F.col("p_brand"))
    rows = t.steps.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    per = rows.groupBy("l_orderkey").agg(F.max_by("p_brand", F.when(named, F.col("step"))).alias("label"), F.min(brand).alias("first"), F.max(brand).alias("last")).withColumn("reachable", D.choices(F.col("first"), F.col("last")))
    return per.groupBy(F.coalesce("label", F.lit("unclassified")).alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("reachable") == 1).alias("destinations"))


@query("a_family_share", "WITH f AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT p_brand, n::BIGINT AS n, round(n / sum(n) OVER ()::DOUBLE, 9) AS share, CASE WHEN n / sum(n) OVER ()::DOUBLE >= 0.045 THEN 'common' WHEN n / sum(n) OVER ()::DOUBLE >= 0.035 THEN 'usual' ELSE 'rare' END AS tier FROM f")
def _(t):
    counted = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    return counted.withColumn("s", share).select("p_brand", "n", F.round("s", 9).alias("share"), F.when(F.col("s") >= 0.045, "common").when(F.col("s") >= 0.035, "usual").otherwise("rare").alias("tier"))


@query("a_weighted_slope", "SELECT l_returnflag, round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2), 7) AS slope, round(regr_slope(y, x), 7) AS plain FROM (SELECT l_returnflag, l_quantity AS x, l_discount + 0.0 AS y, 1 + l_suppkey % 3 AS w FROM lineitem) GROUP BY 1")
def _(t):
    x, y = F.col("l_quantity"), F.col("l_discount") + 0.0
    return t.lineitem.groupBy("l_returnflag").agg(F.round(M.weighted_slope(x, y, 1 + F.col("l_suppkey") % 3), 7).alias("slope"), F.round(F.regr_slope(y, x), 7).alias("plain"))


@query("a_order_accuracy", """WITH y AS (SELECT c_nationkey, extract('year' FROM o_orderdate) AS year, count(*) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
p AS (SELECT a.c_nationkey, avg(CASE WHEN b.v > a.v THEN 1.0 WHEN b.v = a.v THEN 0.5 ELSE 0.0 END) AS all_pairs FROM y a JOIN y b ON a.c_nationkey = b.c_nationkey AND a.year < b.year GROUP BY 1),
n AS (SELECT c_nationkey, avg(CASE WHEN nxt > v THEN 1.0 WHEN nxt = v THEN 0.5 ELSE 0.0 END) AS neighbours FROM (SELECT *, lead(v) OVER (PARTITION BY c_nationkey ORDER BY year) AS nxt FROM y) WHERE nxt IS NOT NULL GROUP BY 1)
SELECT c_nationkey, round(all_pairs, 9) AS all_pairs, round(neighbours, 9) AS neighbours FROM p JOIN n USING (c_nationkey)""")
def _(t):
    years = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("v"))
    return M.order_accuracy(years, ["c_nationkey"], "year", "v").select("c_nationkey", F.round("all_pairs", 9).alias("all_pairs"), F.round("neighbours", 9).alias("neighbours"))


@query("a_ladder_reading", "WITH y AS (SELECT c_mktsegment AS seat, c_nationkey AS target, avg(c_acctbal) / 100 AS fitted FROM customer GROUP BY 1, 2) SELECT seat, round(avg(abs(fitted - target)), 7) AS error, round(max(fitted) - min(fitted), 7) AS span, round(regr_slope(fitted, target), 7) AS slope FROM y GROUP BY 1")
def _(t):
    fitted = t.customer.groupBy(F.col("c_mktsegment").alias("seat"), F.col("c_nationkey").alias("target")).agg((F.avg("c_acctbal") / 100).alias("fitted"))
    return fitted.groupBy("seat").agg(F.round(F.avg(F.abs(F.col("fitted") - F.col("target"))), 7).alias("error"), F.round(F.max("fitted") - F.min("fitted"), 7).alias("span"), F.round(F.regr_slope("fitted", "target"), 7).alias("slope"))


@query("a_seat_totals", f"WITH {PAIRS}, s AS (SELECT a AS seat, wins + draws + losses AS games, points FROM pairs UNION ALL SELECT b, wins + draws + losses, wins + draws + losses - points FROM pairs) SELECT seat, sum(games)::BIGINT AS games, sum(points) AS points FROM s GROUP BY 1")
def _(t):
    return M.seat_totals(pairs(t))


@query("a_decision_cells", "SELECT event_type, count(*) FILTER (WHERE value > 50)::BIGINT AS followed, count(*) FILTER (WHERE value <= 50)::BIGINT AS departed, round(avg(value) FILTER (WHERE value <= 50), 8) AS regret, max(value) FILTER (WHERE value <= 50) AS worst FROM events GROUP BY GROUPING SETS ((), (event_type))")
def _(t):
    off = F.when(F.col("value") <= 50, F.col("value"))
    cells = t.events.rollup("event_type").agg(F.count_if(F.col("value") > 50).alias("followed"), F.count_if(F.col("value") <= 50).alias("departed"), F.round(F.avg(off), 8).alias("regret"), F.max(off).alias("worst"))
    return cells


SUPPORT = "per AS (SELECT l_orderkey, {0} count(*) AS c, count(*) FILTER (WHERE l_returnflag = 'R') AS x, count(*) FILTER (WHERE l_linestatus = 'O') AS y FROM lineitem GROUP BY {1})"


@query("a_rate_support", f"WITH {SUPPORT.format('', '1')} SELECT sum(c)::BIGINT AS opportunities, count(*)::BIGINT AS clusters, round(sum(x) / sum(c)::DOUBLE, 9) AS first_rate, round(sum(y) / sum(c)::DOUBLE, 9) AS second_rate, round((sum(x) - sum(y)) / sum(c)::DOUBLE, 9) AS gap, round(sum(c)::DOUBLE ** 2 / sum(c * c), 6) AS effective FROM per")
def _(t):
    out = M.rate_support(t.lineitem, "l_orderkey", [], F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return out.withColumns({k: F.round(k, 9) for k in ("first_rate", "second_rate", "gap")} | {"effective": F.round("effective", 6)})


@query("a_adjudication", """WITH p AS (SELECT l_orderkey, l_returnflag AS predicate, floor(l_quantity / 20)::BIGINT AS band, l_linestatus, l_tax + 0.0 AS rank FROM lineitem), per AS (SELECT predicate, band, l_orderkey, count(*) AS c, count(*) FILTER (WHERE l_linestatus = 'O') AS x, sum(rank) AS r FROM p GROUP BY 1, 2, 3)
SELECT predicate, band, sum(c)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS games, round(sum(x) / sum(c)::DOUBLE, 9) AS rate, round(sum(r) / sum(c), 8) AS rank FROM per GROUP BY GROUPING SETS ((predicate), (predicate, band))""")
def _(t):
    rows = t.steps.select(F.col("l_returnflag").alias("predicate"), F.floor(F.col("l_quantity") / 20).alias("band"), "l_orderkey", "l_linestatus", "l_tax")
    per = parted(rows, "l_orderkey").groupBy("predicate", "band", "l_orderkey").agg(F.count("*").alias("c"), F.count_if(F.col("l_linestatus") == "O").alias("x"), F.sum("l_tax").alias("r"))
    # an order is one row of its group at each level, so counting rows counts orders: none is repeated for a set or a distinct count
    whole = per.groupBy("predicate", "l_orderkey").agg(*[F.sum(c).alias(c) for c in "cxr"]).withColumn("band", F.lit(None).cast("long"))
    figures = F.sum("c").alias("n"), F.count("l_orderkey").alias("games"), F.round(F.sum("x") / F.sum("c"), 9).alias("rate"), F.round(F.sum("r") / F.sum("c"), 8).alias("rank")
    return per.groupBy("predicate", "band").agg(*figures).unionByName(whole.groupBy("predicate", "band").agg(*figures))


BINS = "b AS (SELECT event_type, floor(ln(1 + abs(value)) / 0.25)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1, 2)"


def bins(t):
    return t.events.groupBy("event_type", F.floor(F.log(1 + F.abs("value")) / 0.25).alias("bin")).agg(F.count("*").alias("n"))


@query("a_log_histogram", f"WITH {BINS}, c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS c, sum(n) OVER (PARTITION BY event_type) AS total FROM b) SELECT event_type, min(bin) FILTER (WHERE c >= total * 0.1::DOUBLE) AS q10, min(bin) FILTER (WHERE c >= total * 0.5::DOUBLE) AS q50, min(bin) FILTER (WHERE c >= total * 0.9::DOUBLE) AS q90 FROM c GROUP BY 1")
def _(t):
    return M.bin_quantiles(bins(t), ["event_type"], (0.1, 0.5, 0.9))


@query("a_wasserstein", """WITH b AS (SELECT event_type, floor(value / 5)::BIGINT AS bin, count(*) FILTER (WHERE event_id % 2 = 0) AS l, count(*) FILTER (WHERE event_id % 2 = 1) AS r FROM events GROUP BY 1, 2),
s AS (SELECT *, abs(sum(l) OVER w / sum(l) OVER (PARTITION BY event_type)::DOUBLE - sum(r) OVER w / sum(r) OVER (PARTITION BY event_type)::DOUBLE) * coalesce(lead(bin) OVER w - bin, 0) AS a FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bin)) SELECT event_type, round(sum(a) * 5, 7) AS distance FROM s GROUP BY 1""")
def _(t):
    half = lambda i: F.count_if(F.col("event_id") % 2 == i)
    rows = t.events.groupBy("event_type", F.floor(F.col("value") / 5).alias("bin")).agg(half(0).alias("l"), half(1).alias("r"))
    return M.wasserstein(rows, ["event_type"], "l", "r", 5.0).withColumn("distance", F.round("distance", 7))


@query("a_total_variation", "WITH a AS (SELECT l_returnflag || l_linestatus AS label, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM lineitem WHERE l_quantity < 20 GROUP BY 1), b AS (SELECT l_returnflag AS label, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM lineitem WHERE l_quantity > 40 GROUP BY 1 UNION ALL SELECT 'RF', 0.0) SELECT round(sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2, 9) AS distance FROM a FULL JOIN b ON a.label = b.label")
def _(t):
    left = t.lineitem.filter("l_quantity < 20").groupBy(F.concat("l_returnflag", "l_linestatus").alias("label")).agg(F.count("*").alias("n"))
    right = t.lineitem.filter("l_quantity > 40").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    return M.total_variation(left, right, "label").select(F.round("distance", 9).alias("distance"))


@query("a_corruption_delta", "SELECT treatment, round(avg(v) - (SELECT avg(l_discount + 0.0) FROM lineitem), 9) AS delta FROM (SELECT 'tax' AS treatment, l_tax + 0.0 AS v FROM lineitem UNION ALL SELECT 'quantity', l_quantity / 100 FROM lineitem) GROUP BY 1")
def _(t):
    both = t.steps.select("l_discount", F.explode(F.array(F.struct(F.lit("tax").alias("treatment"), F.col("l_tax").alias("v")), F.struct(F.lit("quantity").alias("treatment"), (F.col("l_quantity") / 100).alias("v")))).alias("x"))
    return both.groupBy("x.treatment").agg(F.round(F.avg("x.v") - F.avg("l_discount"), 9).alias("delta"))


@query("a_cross_conditioning", """WITH c AS (SELECT floor(p_size / 10)::BIGINT AS band, l_returnflag AS value, avg(l_discount + 0.0) AS loss, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT band, min_by(value, (loss, value)) AS best, round(min(loss), 9) AS loss, round(max(loss) - min(loss), 9) AS penalty, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def _(t):
    rows = t.steps.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    cells = rows.groupBy(F.floor(F.col("p_size") / 10).alias("band"), F.col("l_returnflag").alias("value")).agg(F.avg("l_discount").alias("loss"), F.count("*").alias("n")).filter("n >= 20")
    return cells.groupBy("band").agg(F.min_by("value", F.struct("loss", "value")).alias("best"), F.round(F.min("loss"), 9).alias("loss"), F.round(F.max("loss") - F.min("loss"), 9).alias("penalty"), F.sum("n").alias("n"))


@query("a_median_halves", """WITH x AS (SELECT p_brand, l_quantity AS s, l_discount + 0.0 AS v FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT p_brand, quantile_cont(s, 0.5) AS m FROM x GROUP BY 1)
SELECT p_brand, m AS median, round(avg(v) FILTER (WHERE s <= m), 9) AS low, round(avg(v) FILTER (WHERE s > m), 9) AS high FROM x JOIN m USING (p_brand) GROUP BY 1, 2""")
def _(t):
    rows = t.steps.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("p_brand", F.col("l_quantity").alias("s"), F.col("l_discount").alias("v"))
    rows = keep(rows, "halves")
    m = Q.percentiles(rows, ["p_brand"], "s", {"median": 0.5})  # one row for each brand, and no more than there are brands
    low = F.col("s") <= F.col("median")
    return rows.join(Q.held(m), "p_brand").groupBy("p_brand", "median").agg(avg9(F.when(low, F.col("v"))).alias("low"), avg9(F.when(~low, F.col("v"))).alias("high"))


@query("a_termination_calibration", "WITH b AS (SELECT floor(l_quantity / 10)::BIGINT AS bucket, count(*) AS n, avg((l_returnflag = 'R')::INT) AS o, avg(l_tax + 0.0) AS p FROM lineitem GROUP BY 1) SELECT count(*)::BIGINT AS buckets, round(sum(n * abs(o - p)) / sum(n), 9) AS gap, round(sum(n * (p - o)) / sum(n), 9) AS bias FROM b")
def _(t):
    b = t.steps.groupBy(F.floor(F.col("l_quantity") / 10).alias("bucket")).agg(F.count("*").alias("n"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("o"), F.avg("l_tax").alias("p"))
    mean = lambda c: F.round(F.sum(F.col("n") * c) / F.sum("n"), 9)
    return b.agg(F.count("*").alias("buckets"), mean(F.abs(F.col("o") - F.col("p"))).alias("gap"), mean(F.col("p") - F.col("o")).alias("bias"))


@query("a_line_completion", "WITH g AS (SELECT l_orderkey, min((l_returnflag <> 'A')::INT) AS complete, product(1 - (l_discount + 0.0)) AS p, count(*) AS n FROM lineitem GROUP BY 1) SELECT n::BIGINT AS length, count(*)::BIGINT AS items, sum(complete)::BIGINT AS complete, round(avg(p), 8) AS probability FROM g GROUP BY 1")
def _(t):
    per = t.steps.groupBy("l_orderkey").agg(F.min((F.col("l_returnflag") != "A").cast("int")).alias("complete"), F.product(1 - F.col("l_discount")).alias("p"), F.count("*").alias("length"))
    return per.groupBy("length").agg(F.count("*").alias("items"), F.sum("complete").alias("complete"), F.round(F.avg("p"), 8).alias("probability"))


@query("a_candidates_coverage", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT count(*)::BIGINT AS strata, min(n)::BIGINT AS least, quantile_cont(n, 0.5)::DOUBLE AS median, max(n)::BIGINT AS most, sum(least(n, 3))::BIGINT AS selected FROM c")
def _(t):
    c = t.part.groupBy("p_size").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("strata"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), F.sum(F.least("n", F.lit(3))).alias("selected"))


@query("a_min_detectable", "SELECT p_brand, count(*)::BIGINT AS n, round((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) * sqrt(2 * 0.25::DOUBLE / count(*)), 9) AS difference FROM part GROUP BY 1")
def _(t):
    from tidemark.operators.uncertainty import detectable

    return t.part.groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", "n", F.round(detectable(F.col("n")), 9).alias("difference"))


@query("a_gain_bands", "WITH x AS (SELECT l_suppkey % 2 AS arm, floor(l_quantity / 10)::BIGINT AS band, l_returnflag, l_tax + 0.0 AS mass FROM lineitem) SELECT arm, band, count(*)::BIGINT AS opportunities, round(avg((l_returnflag = 'R')::INT), 9) AS selected, round(avg(mass), 9) AS mass FROM x GROUP BY 1, 2")
def _(t):
    return t.steps.groupBy((F.col("l_suppkey") % 2).alias("arm"), F.floor(F.col("l_quantity") / 10).alias("band")).agg(F.count("*").alias("opportunities"), avg9((F.col("l_returnflag") == "R").cast("int")).alias("selected"), avg9("l_tax").alias("mass"))


@query("a_guardrails", "SELECT count(*) FILTER (WHERE o_totalprice < 20000)::BIGINT AS early, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 300000)::BIGINT AS claimable, (SELECT count(*) FROM (SELECT v FROM (VALUES ('F'), ('O'), ('P'), ('X')) x(v) EXCEPT SELECT o_orderstatus FROM orders))::BIGINT AS silent FROM orders")
def _(t):
    enabled = t.spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "o_orderstatus string")
    silent = enabled.join(t.orders.select("o_orderstatus").distinct(), "o_orderstatus", "left_anti").agg(F.count("*").alias("silent"))
    return t.orders.agg(F.count_if(F.col("o_totalprice") < 20000).alias("early"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)).alias("claimable")).crossJoin(silent)


@query("a_identity_digest", "WITH i AS (SELECT DISTINCT sha256(o_custkey::VARCHAR) AS h FROM orders) SELECT sha256(concat_ws('|', count(*)::VARCHAR, "
       + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::HUGEINT::VARCHAR" for i in range(8)) + ")) AS digest, count(*)::BIGINT AS n FROM i")
def _(t):
    return X.identity_digest(t.orders, "o_custkey")


@query("a_latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def _(t):
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rest = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return Q.percentiles(t.events, ["event_type"], "value", shares).join(rest, "event_type").select("event_type", *[F.round(c, 6).alias(c) for c in shares], "mean", "least", "most")


@query("a_interval_summary", """WITH i AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) // 10 AS k, event_type, value FROM events)
SELECT user_id, k::BIGINT AS interval, count(*)::BIGINT AS steps, round(avg(value), 8) AS mean, min(value) AS least, max(value) AS most, round(coalesce(sum(value) FILTER (WHERE event_type = 'error'), 0) / sum(value), 8) AS overhead FROM i GROUP BY 1, 2 HAVING sum(value) > 0""")
def _(t):
    k = F.floor((F.row_number().over(W.partitionBy("user_id").orderBy("ts")) - 1) / 10)
    rows = t.events.select("user_id", k.alias("interval"), "event_type", "value")
    out = rows.groupBy("user_id", "interval").agg(F.count("*").alias("steps"), F.round(F.avg("value"), 8).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("s"), F.sum(F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0)).alias("e"))
    return out.filter("s > 0").withColumn("overhead", F.round(F.col("e") / F.col("s"), 8)).drop("s", "e")
