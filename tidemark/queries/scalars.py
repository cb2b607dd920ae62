"""Projections and scalar functions."""

from pyspark.sql import functions as F

from tidemark.functions import hashing as H, parsing as P, scores as S
from tidemark.registry import query


@query("f_source_key", r"""SELECT page_id, nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/([A-Za-z0-9_-]+)/?$', 1), '') AS key,
 substr(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/([A-Za-z0-9_-]+)/?$', 1), ''), 1, 8) AS short_key FROM pages""")
def _(t):
    return t.pages.select("page_id", P.source_key(F.col("url")).alias("key"), P.source_key(F.col("url"), 8).alias("short_key"))


@query("f_optional_int", r"""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'k' || event_id ELSE props->>'k' END AS text FROM events)
SELECT event_id, CASE WHEN regexp_full_match(trim(text), '[0-9]{1,9}') THEN trim(text)::INT END AS value,
 CASE WHEN text IS NULL OR trim(text) IN ('', '?', '-') THEN 'unavailable' WHEN regexp_full_match(trim(text), '[0-9]{1,9}') THEN 'present' ELSE 'rejected' END AS status FROM x""")
def _(t):
    text = F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, F.concat(F.lit("k"), F.col("event_id"))).otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", P.optional_int(text).alias("p")).select("event_id", "p.*")


CONTROL = "CASE l_linenumber WHEN 1 THEN '-' WHEN 2 THEN 'x+' || l_suppkey ELSE l_quantity::INT * 15 || '+' || l_linenumber END"


@query("f_time_control", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {CONTROL} AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN c LIKE '%+%' AND c NOT LIKE 'x%' THEN split_part(c, '+', 1)::INT END AS initial,
 CASE WHEN c LIKE '%+%' AND c NOT LIKE 'x%' THEN split_part(c, '+', 2)::INT END AS increment,
 CASE WHEN c = '-' THEN 'unavailable' WHEN c LIKE 'x%' THEN 'rejected' ELSE 'present' END AS status FROM x""")
def _(t):
    text = F.when(F.col("l_linenumber") == 1, "-").when(F.col("l_linenumber") == 2, F.concat(F.lit("x+"), "l_suppkey")).otherwise(F.concat((F.col("l_quantity").cast("int") * 15).cast("string"), F.lit("+"), "l_linenumber"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("c"))
    initial, increment = P.time_control(F.col("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", initial["value"].alias("initial"), increment["value"].alias("increment"), initial["status"].alias("status"))


@query("f_clock_text_ms", """SELECT event_id, (extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 + extract('second' FROM ts)::INT)::BIGINT * 1000 + (event_id % 10)::BIGINT * 100 AS ms,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE 100 END AS precision_ms FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, NULL, 1000 FROM events WHERE event_id % 3 = 0""")
def _(t):
    good = F.concat(F.date_format("ts", "H:mm:ss"), F.lit("."), (F.col("event_id") % 10).cast("string"))
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, good).otherwise(F.date_format("ts", "H:99:ss")).alias("c"))
    return rows.select("event_id", P.clock_ms(F.col("c")).alias("ms"), P.clock_precision_ms(F.col("c")).alias("precision_ms"))


@query("f_date_status", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE o_orderdate::DATE END AS day,
 CASE o_orderkey % 5 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'rejected' ELSE 'present' END AS status FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "????.??.??").when(k == 1, F.date_format("o_orderdate", "yyyy.MM.41")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    return t.orders.select("o_orderkey", P.dotted_date(text).alias("d")).select("o_orderkey", F.col("d.value").alias("day"), "d.status")


@query("f_normalize_text", """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '--' ELSE ' ' || o_orderpriority || '!' END AS t FROM orders)
SELECT o_orderkey, nullif(trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_'), '') AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'rejected' ELSE 'present' END AS status FROM x""")
def _(t):
    text = F.when(F.col("o_orderkey") % 7 == 0, "--").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("!")))
    return t.orders.select("o_orderkey", P.normalized(text).alias("n")).select("o_orderkey", "n.*")


@query("f_pool_from_label", r"SELECT p_partkey, 'pool_' || nullif(regexp_extract(lower(p_type), '\b(economy|standard|promo)\b', 1), '') AS pool FROM part")
def _(t):
    return t.part.select("p_partkey", P.pool_from_label(F.col("p_type"), ("economy", "standard", "promo"), "pool").alias("pool"))


SPEED = "CASE WHEN {0} <= 29 THEN 'ultrabullet' WHEN {0} <= 179 THEN 'bullet' WHEN {0} <= 479 THEN 'blitz' WHEN {0} <= 1499 THEN 'rapid' WHEN {0} <= 21599 THEN 'classical' ELSE 'correspondence' END"


@query("f_speed_band", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {SPEED.format('((l_extendedprice / 10)::BIGINT + 40 * (l_linenumber - 1))')} AS speed FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice / 10) * 10 AS l_extendedprice FROM lineitem)")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.speed_band(F.floor(F.col("l_extendedprice") / 10), F.col("l_linenumber") - 1).alias("speed"))


@query("f_fixed_width_bucket", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'unclassified' ELSE lpad((floor(o_totalprice / 1000 / 50)::BIGINT * 50)::VARCHAR, 4, '0') || '-' || lpad((floor(o_totalprice / 1000 / 50)::BIGINT * 50 + 49)::VARCHAR, 4, '0') END AS bucket FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", P.fixed_bucket(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 1000), 50).alias("bucket"))


@query("f_named_band", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'middle' ELSE 'high' END AS band FROM customer")
def _(t):
    return t.customer.select("c_custkey", P.named_band(F.col("c_acctbal"), [("debt", 0), ("low", 2500), ("middle", 7500), ("high", None)]).alias("band"))


@query("f_phase_label", """WITH {STEPS}, x AS (SELECT l_orderkey, step, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY step DESC) AS left_over FROM steps)
SELECT l_orderkey, step, CASE WHEN left_over <= 40 THEN 'endgame' WHEN step <= 2 THEN 'opening' ELSE 'middlegame' END AS phase FROM x""")
def _(t):
    from pyspark.sql import Window as W

    left = F.sum("l_quantity").over(W.partitionBy("l_orderkey").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0))
    return t.steps.withColumn("left", left).select("l_orderkey", "step", P.phase(F.col("left"), F.col("step"), 40, 2).alias("phase"))


@query("f_weighted_balance", "SELECT l_orderkey, sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS balance FROM lineitem GROUP BY 1")
def _(t):
    sign = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", -1.0).otherwise(0.0)
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(sign * F.col("l_quantity")).alias("balance"))


U = "('0x' || substr({}, 1, 16))::UBIGINT"
RANK = "sha256('{}' || chr(0) || {})"


@query("f_derive_id", f"SELECT o_orderkey, ({U.format(RANK.format('shop', 'o_orderkey'))})::VARCHAR AS id FROM orders")
def _(t):
    return t.orders.select("o_orderkey", H.derive_id(F.lit("shop"), F.col("o_orderkey")).cast("string").alias("id"))


@query("f_salted_digest", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE substr(sha256('salt' || chr(0) || lower(trim(c_name))), 1, 32) END AS digest FROM customer")
def _(t):
    return t.customer.select("c_custkey", H.salted_digest(F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit(" "), F.upper("c_name"))).otherwise("?"), "salt").alias("digest"))


@query("f_rank_key", f"SELECT o_orderkey, {RANK.format('rank', 'o_orderkey')} AS rank_key FROM orders")
def _(t):
    return t.orders.select("o_orderkey", H.rank_key("rank", F.col("o_orderkey")).alias("rank_key"))


SHARE = f"({U.format(RANK)})::DOUBLE / 18446744073709551616.0::DOUBLE"
SPLIT = f"CASE WHEN {SHARE.format('split', 'o_orderkey')} < 0.1 THEN 'test' WHEN {SHARE.format('split', 'o_orderkey')} < 0.1::DOUBLE + 0.2::DOUBLE THEN 'validation' ELSE 'train' END"


@query("f_split_assign", f"SELECT o_orderkey, {SPLIT} AS split FROM orders")
def _(t):
    return t.orders.select("o_orderkey", H.split_of("split", F.col("o_orderkey"), 0.2, 0.1).alias("split"))


@query("f_hash_parity_side", f"SELECT o_orderkey, (('0x' || substr({RANK.format('side', 'o_orderkey')}, 1, 2))::INT % 2)::INT AS side FROM orders")
def _(t):
    return t.orders.select("o_orderkey", H.parity_side("side", F.col("o_orderkey")).alias("side"))


@query("f_name_levels", "SELECT p_partkey, split_part(n, ':', 1) AS family, split_part(n, ':', 1) || ':' || split_part(n, ':', 2) AS variation, n AS line FROM (SELECT p_partkey, replace(p_name, ' ', ':') || ':' || p_brand AS n FROM part)")
def _(t):
    family, variation, line = P.name_levels(F.concat(F.translate("p_name", " ", ":"), F.lit(":"), "p_brand"))
    return t.part.select("p_partkey", family.alias("family"), variation.alias("variation"), line.alias("line"))


@query("f_is_account", "SELECT 'u' || user_id AS kind, true AS ok FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT c_name, regexp_full_match(c_name, '[A-Za-z0-9_-]*[A-Za-z0-9][A-Za-z0-9_-]*') FROM customer UNION ALL SELECT '--' || n_nationkey, true FROM nation UNION ALL SELECT '-_', false FROM region")
def _(t):
    names = t.events.select(F.concat(F.lit("u"), "user_id").alias("kind")).distinct().union(t.customer.select("c_name")).union(t.nation.select(F.concat(F.lit("--"), "n_nationkey"))).union(t.region.select(F.lit("-_")))
    return names.select("kind", P.is_account(F.col("kind")).alias("ok"))


@query("f_prefix_slice", "WITH {STEPS} SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY step) FILTER (WHERE step <= 3) AS prefix, count(*)::BIGINT AS n FROM steps GROUP BY 1")
def _(t):
    seq = F.transform(F.array_sort(F.collect_list(F.struct("step", "l_suppkey"))), lambda s: s["l_suppkey"].cast("string"))
    return t.steps.groupBy("l_orderkey").agg(seq.alias("s")).select("l_orderkey", F.array_join(F.slice("s", 1, 3), ",").alias("prefix"), F.size("s").cast("long").alias("n"))


@query("f_flag_mask", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_returnflag = 'R')::INT + 2 * (l_linestatus = 'O')::INT + 4 * (l_quantity > 25)::INT)::INT AS mask, (l_linestatus = 'O') AS open FROM lineitem")
def _(t):
    mask = P.flag_mask(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity") > 25)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mask.alias("mask"), (F.bit_get(mask, F.lit(1)) == 1).alias("open"))


@query("f_log_bin", "SELECT event_id, floor(ln(1 + abs(value)) / 0.25)::BIGINT AS bin FROM events")
def _(t):
    return t.events.select("event_id", F.floor(F.log(1 + F.abs("value")) / 0.25).alias("bin"))


@query("f_expected_score", "SELECT c_custkey, p_partkey, round(1 / (1 + exp(least(15.0, greatest(-15.0, (p_retailprice - c_acctbal) * ln(10.0::DOUBLE) / 400)))), 9) AS expected FROM customer JOIN part ON c_custkey = p_partkey")
def _(t):
    return t.customer.join(t.part, F.col("c_custkey") == F.col("p_partkey")).select("c_custkey", "p_partkey", F.round(S.expected_score(F.col("c_acctbal"), F.col("p_retailprice")), 9).alias("expected"))


def _scores(t):
    scores = F.transform("embedding", lambda v: v.cast("double"))
    n = F.size(scores)
    allowed = F.transform(scores, lambda v, i: (i % 3 != 1) | (i == F.pmod(F.col("label"), n)))
    return t.embeddings.select("vec_id", "label", scores.alias("scores"), allowed.alias("allowed"), F.pmod("label", n).alias("target"))


EMB = """x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS s, label % len(embedding) AS target FROM embeddings),
k AS (SELECT *, list_filter(s, lambda v, i: (i - 1) % 3 <> 1 OR i - 1 = target) AS kept, list_filter(s, lambda v, i: NOT ((i - 1) % 3 <> 1 OR i - 1 = target)) AS barred, s[target + 1] AS own FROM x),
e AS (SELECT *, ln(list_sum(list_transform(s, lambda v: exp(v)))) AS everything, ln(list_sum(list_transform(kept, lambda v: exp(v)))) AS legal FROM k)"""


@query("f_policy_columns", f"""WITH {EMB} SELECT vec_id, round(everything - own, 8) AS loss, round(legal - own, 8) AS allowed_loss, round(exp(legal - everything), 8) AS allowed_mass, round(list_max(kept) - list_max(barred), 8) AS margin,
 (len(list_filter(kept, lambda v: v > own)) + 1)::INT AS rank, list_max(barred) > list_max(kept) AS top1_disallowed, round(ln(len(kept)) - (legal - own), 8) AS lift FROM e""")
def _(t):
    cols = S.policy_columns(F.col("scores"), F.col("allowed"), F.col("target"))
    rounded = [F.round(c, 8).alias(k) if k not in ("rank", "top1_disallowed") else c.alias(k) for k, c in cols.items()]
    return _scores(t).select("vec_id", *rounded)


@query("f_action_set_mass", f"""WITH {EMB}, p AS (SELECT *, list_filter(range(0, len(s)), lambda i: i % 7 = label % 7) AS chosen FROM e), b AS (SELECT *, list_max(list_transform(chosen, lambda i: s[i + 1])) AS best FROM p)
SELECT vec_id, round(list_sum(list_transform(chosen, lambda i: exp(s[i + 1]))) / exp(everything), 8) AS mass, (len(list_filter(s, lambda v: v > best)) + 1)::INT AS best_rank, list_filter(chosen, lambda i: s[i + 1] = best)[1]::INT AS top FROM b""")
def _(t):
    chosen = F.filter(F.sequence(F.lit(0), F.size("scores") - 1), lambda i: i % 7 == F.col("label") % 7)
    mass, rank, top = S.set_mass(F.col("scores"), F.col("chosen"))
    return _scores(t).withColumn("chosen", chosen).select("vec_id", F.round(mass, 8).alias("mass"), rank.alias("best_rank"), top.alias("top"))


@query("f_policy_divergence", """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS p FROM embeddings), y AS (SELECT a.vec_id, a.p, b.p AS q FROM x a JOIN x b ON b.vec_id = a.vec_id + 1),
z AS (SELECT *, ln(list_sum(list_transform(p, lambda v: exp(v)))) AS a, ln(list_sum(list_transform(q, lambda v: exp(v)))) AS b FROM y)
SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda v: exp(v[1] - a) * ((v[1] - a) - (v[2] - b)))), 8) AS divergence, list_position(p, list_max(p)) = list_position(q, list_max(q)) AS same_top FROM z""")
def _(t):
    x = _scores(t).select("vec_id", F.col("scores").alias("p"))
    pairs = x.join(x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    top = lambda c: F.array_position(c, F.array_max(c))
    return pairs.select("vec_id", F.round(S.divergence(F.col("p"), F.col("q")), 8).alias("divergence"), (top("p") == top("q")).alias("same_top"))


@query("f_move_time", """WITH x AS (SELECT event_id, user_id, (value * 1000)::BIGINT AS clock, lag((value * 1000)::BIGINT, 2) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM (SELECT *, floor(value) AS v FROM events) e)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE before + 100 - clock END AS spent FROM (SELECT event_id, user_id, (floor(value) * 10)::BIGINT AS clock, lag((floor(value) * 10)::BIGINT, 2) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)""")
def _(t):
    from pyspark.sql import Window as W

    clock = (F.floor("value") * 10).cast("long")
    before = F.lag(clock, 2).over(W.partitionBy("user_id").orderBy("ts"))
    return t.events.select("event_id", F.when(F.col("event_id") % 5 != 0, before + 100 - clock).alias("spent"))


@query("f_content_digest", "SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus)) AS digest FROM orders")
def _(t):
    return t.orders.select("o_orderkey", H.content_digest(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("digest"))


@query("f_series_fingerprint", "SELECT event_type, sha256(concat_ws(chr(31), event_type, '1', 'events', 'k=' || (user_id % 3))) AS series, count(*)::BIGINT AS n FROM events GROUP BY event_type, user_id % 3")
def _(t):
    workload = F.array_join(F.transform(F.array_sort(F.map_entries(F.create_map(F.lit("k"), (F.col("user_id") % 3).cast("string")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return t.events.groupBy("event_type", H.content_digest(F.col("event_type"), F.lit("1"), F.lit("events"), workload).alias("series")).agg(F.count("*").alias("n"))


@query("f_flatten_map", """WITH k AS (SELECT event_id, event_type, user_id, (props::JSON ->> '$.k') AS k FROM events)
SELECT event_id, 'k' AS key, k AS value FROM k UNION ALL SELECT event_id, 'run.user', user_id::VARCHAR FROM k UNION ALL SELECT event_id, 'run.source.type', event_type FROM k WHERE event_id % 3 = 0""")
def _(t):
    source = F.when(F.col("event_id") % 3 == 0, F.struct(F.col("event_type").alias("type")))
    run = F.to_json(F.struct(F.col("user_id").alias("user"), source.alias("source")))
    settings = F.concat(F.regexp_replace("props", r"\}\s*$", ', "run": '), run, F.lit("}"))
    return t.events.select("event_id", F.explode(F.array_sort(P.flattened(settings))).alias("e")).select("event_id", "e.key", "e.value")


@query("f_waypoint_share", """WITH {STEPS}, path AS (SELECT l_orderkey, max(step) FILTER (WHERE p_size <= 10) AS depth, count(*) AS available, count(DISTINCT p_brand) FILTER (WHERE p_size <= 10) AS reachable, min(p_brand) FILTER (WHERE p_size <= 10) AS label FROM steps JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_orderkey, CASE WHEN reachable = 1 THEN label END AS destination, coalesce(depth, 0)::DOUBLE / available AS share FROM path""")
def _(t):
    from tidemark.operators.dimension import choices, destination, theory_share

    named = F.col("p_size") <= 10
    brand = F.when(named, F.col("p_brand"))
    path = t.steps.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(
        F.max(F.when(named, F.col("step"))).alias("depth"), F.count("*").alias("available"), F.min(brand).alias("label"), F.max(brand).alias("last")
    ).withColumn("reachable", choices(F.col("label"), F.col("last")))
    return path.select("l_orderkey", destination(F.col("label"), F.col("reachable")).alias("destination"), theory_share(F.col("depth"), F.col("available")).alias("share"))
