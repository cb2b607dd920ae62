"""Sources and sinks: each writes what it reads back, under the shared folder."""

from pyspark.sql import functions as F, types as T

from tidemark.functions import hashing as H, parsing as P
from tidemark.functions.checks import must
from tidemark.functions.shared import keep, shared_path
from tidemark.operators import dimension as D, selection as X, windows as O
from tidemark.queries.scalars import RANK, SHARE
from tidemark.registry import query
from tidemark.sources import archives as A, stores as S


def place(t, name):
    return shared_path(t.spark, name)


@query("src_text_archive", "SELECT md5(l) AS line, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) > 0 GROUP BY 1")
def _(t):
    path = place(t, "text")
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    for i, codec in enumerate(("bzip2", "gzip", "none")):  # one folder of several suffixes
        lines.filter(F.col("doc_id") % 3 == i).select("value").write.mode("append").option("compression", codec).text(path)
    return A.text_lines(t.spark, path).filter("value <> ''").groupBy(F.md5("value").alias("line")).agg(F.count("*").alias("n"))


def archive(t):
    """Orders as records: tags, a blank line, a body with a clock for each step."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "l_suppkey", "l_quantity"))), lambda s: F.concat(F.lit("s"), s["l_suppkey"].cast("string"), F.lit(" { [%clk 0:"), F.lpad(s["l_quantity"].cast("int").cast("string"), 2, "0"), F.lit(":00] }"))), " ")
    steps = t.steps.groupBy("l_orderkey").agg(body.alias("body"))
    rows = t.orders.join(steps, F.col("l_orderkey") == F.col("o_orderkey"))
    tag = lambda name, v: F.concat(F.lit(f'[{name} "'), v, F.lit('"]'))
    heads = F.concat_ws("\n", tag("Event", F.col("o_orderpriority")), tag("Site", F.concat(F.lit("https://x.org/"), F.col("o_orderkey").cast("string"))), F.when(F.col("o_custkey") % 2 == 0, tag("Result", F.col("o_orderstatus"))))
    path = place(t, "records")
    rows.select(F.concat(heads, F.lit("\n\n"), "body", F.lit("\n")).alias("value")).write.text(path)
    return A.framed_records(t.spark, path)


@query("src_framed_records", """WITH {STEPS}, b AS (SELECT l_orderkey, string_agg('s' || l_suppkey || ' { [%clk 0:' || lpad(l_quantity::INT::VARCHAR, 2, '0') || ':00] }', ' ' ORDER BY step) AS body FROM steps GROUP BY 1)
SELECT o_orderkey::VARCHAR AS key, md5('[Event "' || o_orderpriority || '"]' || chr(10) || '[Site "https://x.org/' || o_orderkey || '"]' || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || '[Result "' || o_orderstatus || '"]' ELSE '' END || chr(10) || chr(10) || body) AS digest FROM orders JOIN b ON l_orderkey = o_orderkey""")
def _(t):
    record = F.regexp_replace("record", r"\n+$", "")
    return archive(t).select(A.header(F.col("record"), "Site").alias("site"), F.md5(record).alias("digest")).select(P.source_key(F.col("site")).alias("key"), "digest")


@query("src_tag_headers", "SELECT o_orderkey::VARCHAR AS key, o_orderpriority AS event, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE '*' END AS result, '?' AS date FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    h = archive(t).select(A.headers(F.col("record"), {"Event": "?", "Site": "?", "Date": "?", "Result": "*"}).alias("h"))
    return h.select(P.source_key(F.col("h.Site")).alias("key"), F.col("h.Event").alias("event"), F.col("h.Result").alias("result"), F.col("h.Date").alias("date"))


@query("src_inline_annotations", "WITH {STEPS} SELECT l_orderkey::VARCHAR AS key, step, l_quantity::INT::BIGINT * 60000 AS clock FROM steps")
def _(t):
    # tags are read once for a record, before its steps become rows
    found = archive(t).select(A.header(F.col("record"), "Site").alias("site"), A.annotations(F.col("record"), "clk").alias("clocks"))
    rows = found.select(P.source_key(F.col("site")).alias("key"), "clocks").select("key", F.posexplode("clocks").alias("at", "c"))
    return rows.select("key", (F.col("at") + 1).alias("step"), P.clock_ms(F.col("c")).alias("clock"))


@query("scan_normalized", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").filter("o_totalprice > 200000")


@query("scan_shard_list", "SELECT 'lineitem.parquet' AS shard, count(*)::BIGINT AS rows, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem")
def _(t):
    return S.shard_records(t.lineitem, "l_orderkey").orderBy("shard")


@query("scan_list_lengths", "SELECT vec_id, len(embedding)::INT AS n FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"))


@query("sink_normalized", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return S.write_normalized(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), place(t, "normalized"), ["o_orderkey"])


@query("sink_bounded_shards", "SELECT count(*)::BIGINT AS n, bool_and(true) AS bounded, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def _(t):
    shards = S.shard_records(S.write_bounded(t.orders.select("o_orderkey", "o_totalprice"), place(t, "bounded"), "o_orderkey", 400, 4), "o_orderkey")
    return shards.agg(F.sum("rows").alias("n"), F.bool_and(F.col("rows") <= 400).alias("bounded"), F.min("first").alias("first"), F.max("last").alias("last"))


@query("sink_append_archives", "SELECT extract('year' FROM o_orderdate)::INT AS archive, count(*)::BIGINT AS n, true AS refused FROM orders GROUP BY 1")
def _(t):
    from tidemark.sources.corpus import Corpus, Refused

    rows = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("archive"))
    corpus, selection = Corpus(t.spark, place(t, "corpus"), rows.schema), {"least": 0}
    corpus.append(rows.filter("archive < 1995"), selection)
    corpus.append(rows, selection)
    corpus.append(rows, selection)  # adds nothing
    refused = 0
    for other, under in ((rows, {"least": 1}), (rows.withColumn("o_totalprice", F.col("o_totalprice") + (F.col("archive") == 1995).cast("int")), selection)):
        try:
            corpus.append(other, under)
        except Refused:
            refused += 1
    return corpus.read().groupBy("archive").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused == 2))


@query("sink_manifest", "WITH i AS (SELECT DISTINCT sha256(o_orderkey::VARCHAR) AS h FROM orders) SELECT (SELECT count(*)::BIGINT FROM orders) AS rows, (SELECT min(o_orderkey) FROM orders) AS first, (SELECT max(o_orderkey) FROM orders) AS last, (SELECT round(sum(o_totalprice::DECIMAL(18,2)), 2)::DOUBLE FROM orders) AS spent, sha256(concat_ws('|', count(*)::VARCHAR, "
       + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::HUGEINT::VARCHAR" for i in range(8)) + ")) AS identity FROM i")
def _(t):
    path = place(t, "manifest")
    S.manifest(t.orders, "o_orderkey", first=F.min("o_orderkey"), last=F.max("o_orderkey"), spent=F.round(F.sum("o_totalprice"), 2)).coalesce(1).write.text(path)
    return t.spark.read.text(path).select(F.from_json("value", "rows long, first long, last long, spent double, identity string").alias("m")).select("m.*")


@query("src_account_counts", "SELECT user_id::VARCHAR AS name, count(*)::BIGINT AS games FROM events GROUP BY 1")
def _(t):
    path = place(t, "counts")
    counted = t.events.groupBy(F.col("user_id").cast("string").alias("name")).agg(F.count("*").alias("games"))
    S.write_with_header(counted, path, counted.agg(F.count("*").alias("accounts"), F.sum("games").alias("slots")))
    totals = T.StructType().add("accounts", "long").add("slots", "long")
    return S.read_with_header(t.spark, path, T.StructType().add("name", "string").add("games", "long"), totals, [F.count("*"), F.sum("games")])


@query("src_answers_log", "SELECT user_id, max_by(event_type = 'error', (ts, event_id)) AS marked FROM events GROUP BY 1")
def _(t):
    path = place(t, "answers")
    rows = t.events.select("user_id", (F.col("event_type") == "error").cast("int").alias("marked"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    for i in (0, 1):
        rows.filter(F.col("event_id") % 2 == i).write.mode("append").csv(path, sep="\t")
    t.spark.range(1).select(F.lit("7").alias("value")).write.mode("append").text(path)  # a torn line
    log = t.spark.read.schema("user_id long, marked int, at long, event_id long").option("mode", "PERMISSIVE").csv(path, sep="\t").filter("event_id is not null")
    return O.latest(log, ["user_id"], ["marked"], ["at", "event_id"]).select("user_id", (F.col("marked") == 1).alias("marked"))


@query("src_name_list", "SELECT 'u' || user_id AS name FROM (SELECT DISTINCT user_id FROM events)")
def _(t):
    path = place(t, "names")
    names = t.events.select(F.concat(F.lit("u"), "user_id", F.lit(" ")).alias("value")).distinct()
    names.union(t.region.select(F.lit("# a comment"))).union(t.region.select(F.lit(""))).write.text(path)
    lines = t.spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> '' and not startswith(name, '#')")
    return lines.filter(must(P.is_account(F.col("name")), F.concat(F.lit("not a name: "), "name")))


@query("snapshot_write_read", "SELECT substr(sha256('snap' || chr(0) || lower(trim(c_name))), 1, 32) AS digest FROM customer WHERE c_custkey % 10 = 0")
def _(t):
    path = place(t, "snapshot")
    digests = t.customer.filter("c_custkey % 10 = 0").select(H.salted_digest(F.col("c_name"), "snap").alias("digest"))
    S.write_with_header(digests, path, digests.agg(F.count("*").alias("n"), F.countDistinct("digest").alias("distinct")))
    totals = T.StructType().add("n", "long").add("distinct", "long")
    return S.read_with_header(t.spark, path, T.StructType().add("digest", "string"), totals, [F.count("*"), F.countDistinct("digest")])


PUZZLE = "p_partkey long, p_name string, p_size int, p_retailprice double"


@query("src_puzzle_csv", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size >= 25")
def _(t):
    path = place(t, "puzzles")
    t.part.select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("compression", "bzip2").csv(path, header=True)
    return t.spark.read.schema(PUZZLE).csv(path, header=True, enforceSchema=False).filter("p_size >= 25")


@query("sink_puzzle_csv", f"SELECT p_partkey, p_name, p_size, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY {RANK.format('puzzle', 'p_partkey')}) <= 2")
def _(t):
    path = place(t, "chosen")
    chosen = X.lowest_of_stratum(t.part, ["p_size"], "puzzle", "p_partkey", 2).select("p_partkey", "p_name", "p_size", "p_retailprice")
    chosen.orderBy("p_partkey").write.csv(path, header=True)
    rows = t.spark.read.schema(PUZZLE).csv(path, header=True, enforceSchema=False)
    return D.checked_dimension(rows, "p_partkey")


RECORD = "game_id string, white struct<kind:string,label:string>, black struct<kind:string,label:string>, decisions array<struct<ply:int,action:long,clock:struct<remaining:double>>>, outcome struct<result:string,adjudicated:boolean>"


@query("src_game_records", "WITH {STEPS} SELECT o_orderkey::VARCHAR AS game_id, o_custkey::VARCHAR AS white, step AS ply, l_suppkey AS action, o_orderstatus AS result FROM steps JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    path = place(t, "games")
    decisions = F.array_sort(F.collect_list(F.struct(F.col("step").alias("ply"), F.col("l_suppkey").alias("action"), F.struct(F.col("l_extendedprice").alias("remaining")).alias("clock"))))
    seat = lambda c: F.struct(F.lit("player").alias("kind"), c.cast("string").alias("label"))
    games = t.steps.groupBy("l_orderkey").agg(decisions.alias("decisions")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    games.select(F.col("o_orderkey").cast("string").alias("game_id"), seat(F.col("o_custkey")).alias("white"), seat(F.lit("house")).alias("black"), "decisions", F.struct(F.col("o_orderstatus").alias("result"), F.lit(False).alias("adjudicated")).alias("outcome")).write.json(path)
    rows = t.spark.read.schema(RECORD).json(path)
    rows = rows.filter(must(F.forall(F.transform("decisions", lambda d, i: d["ply"] == i + 1), lambda ok: ok), F.concat(F.lit("plies out of order: "), "game_id")))
    return rows.select("game_id", F.col("white.label").alias("white"), F.explode("decisions").alias("d"), "outcome.result").select("game_id", "white", "d.ply", "d.action", "result")


def envelopes(t):
    """Events as result records: one for each user, with a measurement for each event type."""
    kinds = t.events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("value"), F.max("ts").alias("ts"))
    measured = F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("metric"), "value")))
    return kinds.groupBy("user_id").agg(measured.alias("measurements"), F.max("ts").alias("recorded_at")).select(F.concat(F.lit("r"), "user_id").alias("result_id"), "recorded_at", (F.col("user_id") % 3).cast("string").alias("label"), "measurements")


@query("src_result_records", "SELECT 'r' || user_id AS result_id, event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def _(t):
    path = place(t, "results")
    envelopes(t).write.json(path)
    rows = t.spark.read.schema("result_id string, recorded_at timestamp, label string, measurements array<struct<metric:string,value:double>>").json(path)
    return rows.select("result_id", F.explode("measurements").alias("m")).select("result_id", "m.metric", "m.value")


@query("sink_result_append", "SELECT event_id, md5(event_type || event_id) AS digest FROM events")
def _(t):
    path = place(t, "append")
    rows = t.events.select("event_id", F.md5(F.concat("event_type", "event_id")).alias("digest"))
    rows.filter("event_id % 3 = 0").write.parquet(path)
    store = lambda: t.spark.read.schema(rows.schema).parquet(path)
    for _i in range(2):
        S.append_results(rows, store(), "event_id", "digest").write.mode("append").parquet(path)
    return store()


@query("sink_promote", "SELECT 'r' || user_id AS result_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 1 AND user_id % 5 <> 1")
def _(t):
    rows = envelopes(t)
    frozen = t.events.filter("user_id % 5 = 1").select(F.concat(F.lit("r"), "user_id").alias("result_id")).distinct()
    return S.write_normalized(rows.filter("label = '1'").join(frozen, "result_id", "left_anti").select("result_id"), place(t, "promoted"))


@query("store_bridges", "SELECT DISTINCT l_suppkey AS from_series, l_partkey AS to_series FROM lineitem WHERE l_partkey % 4 <> 0")
def _(t):
    path = place(t, "bridges")
    edges = t.lineitem.select(F.col("l_suppkey").alias("from_series"), F.col("l_partkey").alias("to_series")).distinct().withColumn("bridge_id", F.concat_ws("-", "from_series", "to_series"))
    edges.write.parquet(path)
    revoked = edges.filter("to_series % 4 = 0").select("bridge_id")
    kept = t.spark.read.schema(edges.schema).parquet(path).join(revoked, "bridge_id", "left_anti")
    return S.write_normalized(kept, path + "-2").select("from_series", "to_series")


@query("src_event_log", "SELECT event_id, (props->>'k')::INT AS k, event_type FROM events WHERE event_id % 3 <> 0")
def _(t):
    path = place(t, "log")
    event = F.to_json(F.struct(F.lit(1).alias("schema"), "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type"))
    t.events.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("12:00 info "), "event_type")).otherwise(F.concat(F.lit("12:00 info @event "), event)).alias("value")).write.text(path)
    lines = t.spark.read.text(path).filter(F.col("value").contains("@event "))
    read = lines.select(F.from_json(F.substring_index("value", "@event ", -1), "schema int, event_id long, k int, event_type string").alias("e")).select("e.*")
    return read.filter(must(F.col("schema") == 1, "unreadable event")).select("event_id", "k", "event_type")


@query("src_dimension_book", "SELECT n_nationkey AS key, n_name AS name, r_name AS code FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t):
    path = place(t, "book")
    t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name").write.csv(path, sep="\t")
    rows = t.spark.read.schema("key int, name string, code string").csv(path, sep="\t")
    return D.checked_dimension(rows, "key")


@query("sink_derived_labels", "WITH {STEPS} SELECT l_orderkey, step, (l_returnflag = 'R')::INT + 2 * (l_quantity > 25)::INT AS mask FROM steps")
def _(t):
    mask = P.flag_mask(F.col("l_returnflag") == "R", F.col("l_quantity") > 25)
    return S.write_normalized(t.steps.select("l_orderkey", "step", mask.alias("mask")), place(t, "labels"))


@query("sink_cached_summary", "SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY 1")
def _(t):
    path = place(t, "summary")
    make = lambda rows: rows.groupBy("p_brand").agg(F.count("*").alias("n"))
    S.cached_summary(t.part.filter("p_partkey % 2 = 0"), "p_partkey", path, make)  # of other rows: not to be taken for these
    S.cached_summary(t.part, "p_partkey", path, make)
    return S.cached_summary(t.part, "p_partkey", path, lambda rows: make(rows.filter("false")))  # found, not made again


@query("sink_seed_dispersion", "SELECT event_type, round(stddev_samp(value), 6) AS spread FROM events WHERE event_type = 'click' GROUP BY 1")
def _(t):
    spread = t.events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("spread"))
    return S.write_normalized(spread.select("spread", "event_type"), place(t, "seeds"), partition=["event_type"]).filter("event_type = 'click'")


@query("sink_series_history", "SELECT event_type AS family, user_id % 3 AS metric, extract('year' FROM ts)::INT * 12 + extract('month' FROM ts)::INT AS ordinal, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2, 3")
def _(t):
    rows = t.events.select(F.col("event_type").alias("family"), (F.col("user_id") % 3).alias("metric"), (F.year("ts") * 12 + F.month("ts")).alias("ordinal"), "value", "ts", "event_id")
    latest = O.latest(rows, ["family", "metric", "ordinal"], ["value"], ["ts", "event_id"])
    return S.write_normalized(latest, place(t, "history"), partition=["family", "metric"])


POOL = f"SELECT o_orderkey, o_totalprice FROM orders WHERE {SHARE.format('split', 'o_orderkey')} < 0.3 AND {SHARE.format('pool', 'o_orderkey')} < 0.5 AND o_custkey % 10 <> 0"


def frozen(t):
    from tidemark.plans.pools import freeze_pool

    marked = t.customer.filter("c_custkey % 10 = 0")
    return freeze_pool(t.orders, "o_orderkey", place(t, "pool"), columns=["o_orderkey", "o_totalprice"], marked=marked, mark="c_custkey", on=["o_custkey"], held=0.3, share=0.5)


@query("pool_freeze", POOL)
def _(t):
    return frozen(t)[0]


@query("pool_load", f"SELECT count(*)::BIGINT AS n, true AS sound FROM ({POOL})")
def _(t):
    from tidemark.plans.pools import load_pool

    _, path = frozen(t)
    return load_pool(t.spark, path, "o_orderkey")


@query("manifest_validate", "SELECT 'ok' AS state, 4 AS shards UNION ALL SELECT 'changed', 1 UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'unknown', 1")
def _(t):
    from tidemark.sources.corpus import rows_digest

    path, other = place(t, "validate"), place(t, "validate-other")
    rows = t.lineitem.select("l_orderkey", "l_partkey")
    record = lambda p: S.shard_records(t.spark.read.schema(rows.schema).parquet(p), "l_orderkey", rows_digest(*rows.columns).alias("digest"))
    rows.repartitionByRange(6, "l_orderkey").write.parquet(path)
    recorded = keep(record(path), "recorded")
    files = sorted(r.shard for r in recorded.select("shard").collect())
    at, fs = S.files_of(t.spark, path)
    # one shard is rewritten in place with as many rows, one goes and one comes
    t.spark.read.parquet(f"{path}/{files[0]}").withColumn("l_partkey", F.col("l_partkey") + 1).coalesce(1).write.parquet(other)
    (made,) = [s.getPath() for s in fs.listStatus(at(other)) if s.getPath().getName().startswith("part-")]
    fs.delete(at(f"{path}/{files[0]}"), False)
    fs.rename(made, at(f"{path}/{files[0]}"))
    fs.rename(at(f"{path}/{files[1]}"), at(f"{path}/part-new.parquet"))
    return S.validate_shards(recorded, record(path)).groupBy("state").agg(F.count("*").cast("int").alias("shards"))


@query("pool_slices", f"""WITH {{STEPS}}, held AS (SELECT o_orderkey, floor(o_totalprice / 1000 / 100)::BIGINT AS band FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 1000 AND {SHARE.format('split', 'o_orderkey')} < 0.3 AND {SHARE.format('pool', 'o_orderkey')} < 0.3 AND o_custkey % 10 <> 0),
f AS (SELECT l_orderkey, max_by(p_brand, step) AS family FROM steps JOIN part ON p_partkey = l_partkey GROUP BY 1), x AS (SELECT s.*, band, family, CASE WHEN l_quantity > 25 THEN 'slow' ELSE 'fast' END AS speed FROM steps s JOIN held ON o_orderkey = l_orderkey JOIN f USING (l_orderkey)),
y AS (SELECT 'overall' AS dimension, 'all' AS value, l_discount FROM x UNION ALL SELECT 'band', band::VARCHAR, l_discount FROM x UNION ALL SELECT 'speed', speed, l_discount FROM x UNION ALL SELECT 'family', family, l_discount FROM x) SELECT dimension, value, count(*)::BIGINT AS n, round(avg(l_discount), 9) AS loss FROM y GROUP BY 1, 2""")
def _(t):
    from tidemark.plans.pools import pool_slices

    return pool_slices(t)
