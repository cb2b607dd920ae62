"""Streams over files of the events and orders, dropped in order."""

from pyspark.sql import functions as F

from tidemark.functions.shared import shared_path
from tidemark.queries.estimates import ledger_sql
from tidemark.queries.windows import CONFIGURATION, epoch, epoch_sql
from tidemark.registry import SQL, query
from tidemark.streaming import streams as Z


FILES = 4  # in each third


def place(t, name):
    return shared_path(t.spark, name)


def dropped(t, rows, key, parts=3):
    """Rows as files that arrive one after the other, in order of a key."""
    path, at = shared_path(t.spark, "drop"), F.col(key).cast("double")
    bounds = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)]).alias("b")).first()["b"] or []
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = rows.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.repartitionByRange(FILES, key).sortWithinPartitions(key).write.mode("append").parquet(path)
    return Z.files(t.spark, path, rows.schema, FILES)


@query("s_incremental_archives", "SELECT extract('year' FROM o_orderdate)::INT AS archive, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(t):
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("archive"))
    return Z.incremental_archives(dropped(t, rows, "o_orderkey"), shared_path(t.spark, "stream-corpus"), "archive", place(t, "archives")).groupBy("archive").agg(F.count("*").alias("n"))


@query("s_running_counts", "SELECT user_id, count(*)::BIGINT AS games FROM events GROUP BY 1")
def _(t):
    counts = dropped(t, t.events.select("event_id", "user_id"), "event_id").groupBy("user_id").agg(F.count("*").alias("games"))
    return Z.last_of(Z.state_table(counts, shared_path(t.spark, "counts"), place(t, "running"), "update"), ["user_id"])


@query("s_latest_answer", "SELECT user_id, max_by(value, ts) AS value FROM events GROUP BY 1")
def _(t):
    latest = dropped(t, t.events.select("event_id", "user_id", "ts", "value"), "event_id").groupBy("user_id").agg(F.max_by("value", "ts").alias("value"))
    return Z.last_of(Z.state_table(latest, shared_path(t.spark, "answers"), place(t, "answers-progress"), "update"), ["user_id"])


@query("s_dedup_append", "SELECT event_id, md5(event_type || event_id) AS digest FROM events")
def _(t):
    rows = t.events.select("event_id", F.md5(F.concat("event_type", "event_id")).alias("digest"), F.col("ts").cast("timestamp").alias("ts"))
    return Z.append_once(dropped(t, rows.unionByName(rows), "ts"), shared_path(t.spark, "once"), "event_id", "digest", "ts", place(t, "once-progress")).select("event_id", "digest")


@query("s_interval_drain", "SELECT date_trunc('day', ts)::DATE AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS total, max(value) AS most, max_by(value, ts) AS last FROM events GROUP BY 1")
def _(t):
    stream = dropped(t, t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value"), "ts").withWatermark("ts", "1 day")
    drained = stream.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"), F.max_by("value", "ts").alias("last"))
    rows = Z.state_table(drained.select(F.col("w.start").alias("start"), "n", "total", "most", "last"), shared_path(t.spark, "drain"), place(t, "drain-progress"), "update")
    out = Z.last_of(rows, ["start"])
    return out.select(F.to_date("start").alias("day"), "n", F.round("total", 4).alias("total"), "most", "last")


@query("s_session_fold", SQL["w_fold_log"])
def _(t):
    stream = dropped(t, t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"), "ts")
    folded = Z.fold_sessions(stream, shared_path(t.spark, "fold"), place(t, "fold-progress"), "signup")
    return folded.select("event_id", "state", "since")


@query("s_resume_cursor", f"WITH {epoch_sql(1)} SELECT span, batch, slot, o_orderkey FROM p1 WHERE span > 1 OR (span = 1 AND batch >= 3)")
def _(t):
    from tidemark.plans import epochs as E

    plan, cursor = place(t, "plan"), place(t, "cursor")
    for number in (0, 1):
        E.write_plan(epoch(t, number), plan)
    E.write_cursor(t.orders, "o_orderkey", cursor, CONFIGURATION, epoch=1, span=1, batch=3)
    return E.resumed(t.spark, plan, E.read_cursor(t.orders, "o_orderkey", cursor, CONFIGURATION)).select(F.col("span").cast("long").alias("span"), "batch", "slot", "o_orderkey")


@query("x_metric_registry", "SELECT event_type AS metric, CASE WHEN event_type IN ('click', 'view') THEN 'use' ELSE 'sale' END AS family, count(*)::BIGINT AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(t):
    from tidemark.operators.measures import Registry

    registry = Registry()
    for name, family in (("click", "use"), ("view", "use"), ("purchase", "sale"), ("signup", "sale")):
        registry.register(name, family=family, direction="up", version=1)
    return t.events.join(F.broadcast(registry.frame(t.spark)), F.col("event_type") == F.col("metric")).groupBy("metric", "family").agg(F.count("*").alias("n"))


@query("x_measurements", "SELECT l_orderkey, 'loss' AS metric, round(avg(l_discount + 0.0), 9) AS value, count(*)::BIGINT AS sample_size FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'mass', round(avg(l_tax + 0.0), 9), count(*)::BIGINT FROM lineitem GROUP BY 1")
def _(t):
    from tidemark.operators.measures import Registry, measurements

    registry = Registry()
    registry.register("loss", family="fit", direction="down", version=1)
    registry.register("mass", family="fit", direction="up", version=1)
    rows = t.steps.groupBy("l_orderkey").agg(F.round(F.avg("l_discount"), 9).alias("loss"), F.round(F.avg("l_tax"), 9).alias("mass"), F.count("*").alias("n"))
    return measurements(rows, ["l_orderkey"], ["loss", "mass"], "n", registry)


LOTTERY = "moves AS (SELECT s AS state, unnest(CASE WHEN s % 10 = 0 THEN [{'n': s * 7 % 997, 'p': 0.6}] ELSE [{'n': (s * 7 + 1) % 997, 'p': 0.5}, {'n': (s * 3 + 2) % 997, 'p': 0.3}] END, recursive := true) FROM (SELECT DISTINCT unnest(range(0, 997)) AS s UNION SELECT l_suppkey FROM lineitem)), mv AS (SELECT state, n AS nxt, sum(p)::DOUBLE AS p FROM moves GROUP BY 1, 2)"


@query("x_policy_plugin", f"WITH {LOTTERY}, f0 AS (SELECT l_suppkey AS state, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS mass FROM lineitem GROUP BY 1), {ledger_sql('mv', None, 3, 0.001)}")
def _(t):
    from tidemark.operators.dimension import mass_ledger
    from tidemark.operators.measures import played

    def lottery(states):  # a policy of a batch of numbers: two ways on, one for every tenth, and a rest that stops
        return [{s * 7 % 997: 0.6} if s % 10 == 0 else {(s * 7 + 1) % 997: 0.5, (s * 3 + 2) % 997: 0.3} for s in states]

    lines = t.lineitem.groupBy(F.col("l_suppkey").alias("state")).agg(F.count("*").alias("n"))
    start = lines.crossJoin(F.broadcast(t.lineitem.agg(F.count("*").alias("all")))).select("state", (F.col("n") / F.col("all")).alias("mass"))
    return mass_ledger(start, played(lottery), 3, 0.001).select("kind", "state", F.round("mass", 9).alias("mass"))


@query("x_quantity_plugin", "SELECT o_orderstatus AS side, count(*)::BIGINT AS games, round(avg(ln(o_totalprice)), 8) AS value FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
def _(t):
    from tidemark.operators.measures import compared

    return compared(t.orders, F.when(F.col("o_totalprice") > 50000, F.log("o_totalprice")), "o_orderstatus").select("side", "games", F.round("value", 8).alias("value"))
