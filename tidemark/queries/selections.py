"""Filters with ordered reasons, orders with limits, set operations, and the pool they make up."""

from pyspark.sql import functions as F

from tidemark.functions import hashing as H, parsing as P
from tidemark.operators import selection as X
from tidemark.queries.scalars import RANK, SHARE, SPEED, SPLIT, U
from tidemark.registry import query

ORD = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate::DATE AS day"


def orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("day"))


SCREEN = """screened AS (SELECT o.*, CASE WHEN o_orderstatus = 'P' THEN 'unsupported_variant' WHEN o_orderpriority LIKE '5%' THEN 'nonstandard_start' WHEN c_mktsegment = 'MACHINERY' THEN 'bot'
 WHEN o_totalprice < 1000 THEN 'speed_mismatch' WHEN o_custkey % 10 = 0 THEN 'marked' WHEN c_custkey IS NULL THEN 'missing_key' END AS reason FROM orders o LEFT JOIN customer c ON c_custkey = o_custkey)"""


def screened(t):
    rows = orders(t).join(t.customer.select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return X.screened(rows, ("unsupported_variant", F.col("o_orderstatus") == "P"), ("nonstandard_start", F.col("o_orderpriority").startswith("5")), ("bot", F.col("c_mktsegment") == "MACHINERY"), ("speed_mismatch", F.col("o_totalprice") < 1000), ("marked", F.col("o_custkey") % 10 == 0), ("missing_key", F.col("c_custkey").isNull()))


@query("p_screen_reject", f"WITH {SCREEN} SELECT coalesce(reason, 'accepted') AS reason, count(*)::BIGINT AS n FROM screened GROUP BY 1")
def _(t):
    return X.reason_counts(screened(t))


@query("p_body_reject", f"""WITH {SCREEN}, body AS (SELECT l_orderkey, count(*) AS n, bool_or(l_quantity >= 50) AS illegal FROM lineitem GROUP BY 1)
SELECT coalesce(reason, CASE WHEN illegal THEN 'illegal_step' WHEN coalesce(n, 0) < 3 THEN 'too_short' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'invalid_result' END, 'accepted') AS reason, count(*)::BIGINT AS n FROM screened LEFT JOIN body ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    body = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("steps"), F.bool_or(F.col("l_quantity") >= 50).alias("illegal"))
    rows = screened(t).withColumnRenamed("reason", "header").join(body, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = X.screened(rows, ("illegal_step", F.col("illegal")), ("too_short", F.coalesce("steps", F.lit(0)) < 3), ("invalid_result", ~F.col("o_orderstatus").isin("F", "O")))
    return X.reason_counts(rows.withColumn("reason", F.coalesce("header", "reason")))


@query("p_bot", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE NOT (lower(c_mktsegment) = 'machinery' OR s_acctbal < 0)")
def _(t):
    rows = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"))
    return rows.filter(~((F.lower("c_mktsegment") == "machinery") | (F.col("s_acctbal") < 0))).select("c_custkey", "s_suppkey")


@query("p_selection_reason", f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE floor(o_totalprice / 1000)::BIGINT END AS rating, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 600 END AS initial, o_custkey FROM orders)
SELECT coalesce(CASE WHEN initial IS NULL THEN 'missing_control' WHEN rating IS NULL THEN 'missing_rating' WHEN {SPEED.format('initial')} = 'blitz' THEN 'speed' WHEN initial < 10 OR initial > 550 THEN 'initial_bounds' WHEN rating < 20 OR rating >= 350 THEN 'rating_band' WHEN o_custkey % 10 = 0 THEN 'marked' END, 'accepted') AS reason, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 13 != 0, F.floor(F.col("o_totalprice") / 1000)).alias("rating"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 600).alias("initial"))
    rules = (("missing_control", F.col("initial").isNull()), ("missing_rating", F.col("rating").isNull()), ("speed", P.speed_band(F.col("initial"), F.lit(0)) == "blitz"),
             ("initial_bounds", ~F.col("initial").between(10, 550)), ("rating_band", (F.col("rating") < 20) | (F.col("rating") >= 350)), ("marked", F.col("o_custkey") % 10 == 0))
    return X.reason_counts(X.screened(rows, *rules))


@query("p_view_reason", f"""WITH n AS (SELECT l_orderkey, count(*) AS plies FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, o_orderdate::DATE AS day, coalesce(plies, 0) AS plies FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
r AS (SELECT *, CASE WHEN plies < 2 THEN 'too_short' WHEN plies > 12 THEN 'too_long' WHEN o_orderkey % 17 = 0 THEN 'missing_date' WHEN day < DATE '1993-01-01' THEN 'before' WHEN day >= DATE '1998-01-01' THEN 'after' END AS reason FROM x)
SELECT o_orderkey FROM r WHERE reason IS NULL ORDER BY {RANK.format('view', 'o_orderkey')} LIMIT 300""")
def _(t):
    plies = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("plies"))
    rows = orders(t).join(plies, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("plies", F.coalesce("plies", F.lit(0)))
    day = F.when(F.col("o_orderkey") % 17 != 0, F.col("day"))
    kept = X.screened(rows, ("too_short", F.col("plies") < 2), ("too_long", F.col("plies") > 12), ("missing_date", day.isNull()), ("before", day < F.lit("1993-01-01").cast("date")), ("after", day >= F.lit("1998-01-01").cast("date")))
    return X.hash_top(kept.filter("reason is null"), "view", "o_orderkey", 300).select("o_orderkey")


@query("p_reference_reason", """WITH x AS (SELECT o_orderkey, o_orderstatus, floor(o_totalprice / 1000) AS a, floor(c_acctbal / 20) AS b, n_regionkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)
SELECT coalesce(CASE WHEN b IS NULL OR b < 0 THEN 'missing_rating' WHEN abs(a - b) > 200 THEN 'gap' WHEN n_regionkey = 3 THEN 'unreachable' END, 'accepted') AS reason, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def _(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    a, b = F.floor(F.col("o_totalprice") / 1000), F.floor(F.col("c_acctbal") / 20)
    return X.reason_counts(X.screened(rows, ("missing_rating", b.isNull() | (b < 0)), ("gap", F.abs(a - b) > 200), ("unreachable", F.col("n_regionkey") == 3)))


@query("p_puzzle_candidate", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 40 AND p_retailprice >= 905 AND p_brand <> 'Brand#11'")
def _(t):
    return t.part.filter(F.col("p_size").between(5, 40) & (F.col("p_retailprice") >= 905) & (F.col("p_brand") != "Brand#11")).select("p_partkey", "p_size")


@query("p_hash_share", f"SELECT o_orderkey, {U.format(RANK.format('share', 'o_orderkey'))}::HUGEINT < (0.1::DOUBLE * 18446744073709551616.0::DOUBLE)::HUGEINT AS in_tenth FROM orders WHERE {U.format(RANK.format('share', 'o_orderkey'))}::HUGEINT < (0.3::DOUBLE * 18446744073709551616.0::DOUBLE)::HUGEINT")
def _(t):
    return t.orders.filter(H.in_share("share", F.col("o_orderkey"), 0.3)).select("o_orderkey", H.in_share("share", F.col("o_orderkey"), 0.1).alias("in_tenth"))


@query("p_size_dial", "SELECT o_orderstatus, least(floor(count(*) * 0.25::DOUBLE), 200)::BIGINT AS size FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(X.size_dial(F.count("*"), 0.25, 200).cast("long").alias("size"))


@query("p_weighted_thinning", f"""WITH n AS (SELECT l_orderkey, count(*) AS plies FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, floor(o_totalprice / 100000)::BIGINT AS a, o_custkey % 4 AS b, (plies + 1) // 2 AS wa, plies // 2 AS wb FROM orders JOIN n ON l_orderkey = o_orderkey)
SELECT o_orderkey FROM x WHERE {SHARE.format('thin', 'o_orderkey')} < ((CASE WHEN a < 4 THEN 1.0::DOUBLE / (a + 1) ELSE 1.0 END) * wa + (1.0::DOUBLE / (b + 1)) * wb) / (wa + wb)""")
def _(t):
    plies = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("plies"))
    rows = t.orders.join(plies, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("a"), (F.col("o_custkey") % 4).alias("b"), F.ceil(F.col("plies") / 2).alias("wa"), F.floor(F.col("plies") / 2).alias("wb"))
    accept = t.spark.range(4).select(F.col("id").alias("value"), (F.lit(1.0) / (F.col("id") + 1)).alias("accept"))
    return X.thinned(rows, accept, "thin", "o_orderkey", (("a", F.col("wa")), ("b", F.col("wb")))).select("o_orderkey")


@query("p_ended_by", """WITH s AS (SELECT l_orderkey, max_by(l_discount + 0.0, l_shipdate::VARCHAR || l_linenumber || lpad(l_partkey::VARCHAR, 9, '0')) * 10 AS share FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey, o_orderstatus AS result, CASE o_orderkey % 4 WHEN 0 THEN 'abandoned' WHEN 1 THEN 'time_forfeit' WHEN 2 THEN 'normal' END AS said, share FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT CASE WHEN said = 'abandoned' THEN 'abandonment' WHEN said = 'time_forfeit' THEN CASE WHEN share > 0.5 THEN 'abandonment' ELSE 'clock_expiry' END WHEN said = 'normal' THEN CASE WHEN result = 'F' THEN 'resignation' WHEN result = 'O' THEN 'draw_agreement' ELSE 'unknown' END ELSE 'unknown' END AS ended, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def _(t):
    from tidemark.operators.windows import ended_by

    last = F.max_by("l_discount", "step") * 10
    share = t.steps.groupBy("l_orderkey").agg(last.alias("share"))
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "abandoned").when(k == 1, "time_forfeit").when(k == 2, "normal")
    rows = t.orders.join(share, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy(ended_by(said, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", F.col("share"), 0.5).alias("ended")).agg(F.count("*").alias("n"))


@query("p_quality_gate")
def _(t):
    rows = screened(t).filter("reason is null")
    return X.require(rows, overlap=F.col("o_custkey") % 10 == 0, no_price=F.col("o_totalprice").isNull())


@query("o_hash_top_n", f"SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 ORDER BY {RANK.format('top', 'o_orderkey')}, o_orderkey LIMIT 50")
def _(t):
    return X.hash_top(t.orders.filter("o_totalprice > 50000"), "top", "o_orderkey", 50).select("o_orderkey")


@query("o_first_accepted", f"WITH {SCREEN} SELECT o_orderkey, (SELECT count(*) FROM screened WHERE reason IS NULL) > 100 AS more FROM screened WHERE reason IS NULL ORDER BY o_orderkey LIMIT 100")
def _(t):
    return X.first_and_more(screened(t).filter("reason is null").select("o_orderkey"), "o_orderkey", 100)


@query("o_priority_queue", "SELECT user_id, count(*)::BIGINT AS games FROM events GROUP BY 1 ORDER BY user_id % 5 = 0 DESC, games DESC, user_id LIMIT 12")
def _(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("games")).orderBy((F.col("user_id") % 5 == 0).desc(), F.desc("games"), "user_id").limit(12)


@query("o_top_scores", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS score, unnest(range(0, len(embedding))) AS place FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, place) AS rank FROM x)
SELECT vec_id, max(place) FILTER (WHERE rank = 1)::INT AS best, round(count(*) FILTER (WHERE place % 3 = 1)::DOUBLE / 5, 6) AS disallowed FROM r WHERE rank <= 5 GROUP BY 1""")
def _(t):
    from tidemark.functions.scores import top_scores

    top = t.embeddings.select("vec_id", top_scores(F.transform("embedding", lambda v: v.cast("double")), 5).alias("top"))
    return top.select("vec_id", F.get("top", F.lit(0))["at"].alias("best"), F.round(F.size(F.filter("top", lambda z: z["at"] % 3 == 1)) / F.lit(5.0), 6).alias("disallowed"))


@query("o_id_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    from tidemark.operators.batching import global_rank

    return global_rank(t.orders.filter("o_orderstatus = 'P'").select("o_orderkey"), ["o_orderkey"], "place")


YEAR = "extract('year' FROM o_orderdate)::INT"


@query("u_append_union", f"SELECT {YEAR} AS archive, count(*)::BIGINT AS n, min(o_orderkey) AS first FROM orders WHERE {YEAR} IN (1993, 1995) GROUP BY 1")
def _(t):
    rows = t.orders.withColumn("archive", F.year("o_orderdate"))
    return rows.filter("archive = 1993").unionByName(rows.filter("archive = 1995")).groupBy("archive").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("u_train_intersect", f"SELECT o_custkey FROM orders WHERE {SPLIT} = 'test' INTERSECT SELECT o_custkey FROM orders WHERE {SPLIT} = 'validation'")
def _(t):
    rows = t.orders.withColumn("split", H.split_of("split", F.col("o_orderkey"), 0.2, 0.1))
    return rows.filter("split = 'test'").select("o_custkey").intersect(rows.filter("split = 'validation'").select("o_custkey"))


@query("u_generation_except", f"SELECT o_orderkey FROM orders WHERE {SHARE.format('gen', 'o_orderkey')} < 0.3 EXCEPT SELECT o_orderkey FROM orders WHERE {SHARE.format('gen', 'o_orderkey')} < 0.2")
def _(t):
    part = lambda f: t.orders.filter(H.hash_fraction("gen", F.col("o_orderkey")) < f).select("o_orderkey")
    return part(0.3).subtract(part(0.2))


@query("u_vocab_union", """WITH a AS (SELECT l_returnflag || l_linestatus AS label, count(*) AS n FROM lineitem WHERE l_quantity <= 25 GROUP BY 1), b AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0)::BIGINT AS n_left, coalesce(b.n, 0)::BIGINT AS n_right FROM a FULL JOIN b ON a.label = b.label""")
def _(t):
    left = t.lineitem.filter("l_quantity <= 25").groupBy(F.concat("l_returnflag", "l_linestatus").alias("label")).agg(F.count("*").alias("n_left"))
    right = t.lineitem.filter("l_quantity > 25").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n_right"))
    both = left.select("label").union(right.select("label")).distinct()
    return both.join(left, "label", "left").join(right, "label", "left").fillna(0)


@query("u_shared_cells", "SELECT p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 49 GROUP BY 1 HAVING count(DISTINCT extract('year' FROM l_shipdate)) = (SELECT count(DISTINCT extract('year' FROM l_shipdate)) FROM lineitem WHERE l_quantity >= 49)")
def _(t):
    rows = t.lineitem.filter("l_quantity >= 49").withColumn("arm", F.year("l_shipdate"))
    arms = rows.agg(F.countDistinct("arm").alias("arms"))
    cells = rows.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.countDistinct("arm").alias("n"))
    return cells.join(arms, F.col("n") == F.col("arms")).select("p_brand")


@query("u_silent_options", "SELECT v AS option FROM (VALUES ('F'), ('O'), ('P'), ('X')) x(v) EXCEPT SELECT o_orderstatus FROM orders")
def _(t):
    enabled = t.spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "option string")
    return enabled.subtract(t.orders.select("o_orderstatus").distinct())  # few values: made distinct before they meet in tasks


@query("u_unreachable", "SELECT DISTINCT p_type FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity < 2 EXCEPT SELECT p_type FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49 AND p_size > 48")
def _(t):
    rows = t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"))
    return rows.filter("l_quantity < 2").select("p_type").subtract(rows.filter("l_quantity > 49 and p_size > 48").select("p_type").distinct())
