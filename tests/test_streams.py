"""State that is kept, that goes, and that outlives a restart."""

import datetime as dt

import pytest

from tidemark.streaming import streams as Z

DAY = dt.datetime(2024, 1, 1)


def add(spark, drop, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(drop)


def test_once_over_restarts_conflicts_and_expiry(spark, tmp_path):
    drop, out, progress = (f"file://{tmp_path}/{n}" for n in ("drop", "out", "progress"))
    schema = "k long, digest string, ts timestamp, note string"
    at = lambda d: DAY + dt.timedelta(days=d)
    run = lambda p=progress: Z.append_once(Z.files(spark, drop, spark.read.parquet(drop).schema), out, "k", "digest", "ts", p, horizon_days=7, buckets=4)
    add(spark, drop, [(1, "a", at(0), "x"), (2, "b", at(0), "x"), (2, "b", at(0), "twice")], schema)
    assert sorted((r.k, r.digest) for r in run().collect()) == [(1, "a"), (2, "b")]
    add(spark, drop, [(2, "b", at(1), "again"), (3, "c", at(2), "x")], schema)
    assert sorted(r.k for r in run().collect()) == [1, 2, 3]  # goes on from the state, which was written in another run
    add(spark, drop, [(4, "d", at(40), "x")], schema)
    add(spark, drop, [(5, "e", at(41), "x")], schema)
    run()
    add(spark, drop, [(1, "other", at(42), "known no more")], schema)  # the watermark has passed the horizon: forgotten
    assert sorted((r.k, r.digest) for r in run().collect()) == [(1, "a"), (1, "other"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    add(spark, drop, [(5, "changed", at(43), "x")], schema)
    with pytest.raises(Exception, match="conflicting record: 5"):
        run()


def test_sessions_leave_the_state_when_idle(spark, tmp_path):
    drop, out, progress = (f"file://{tmp_path}/{n}" for n in ("drop", "out", "progress"))
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    at = lambda d: DAY + dt.timedelta(days=d)
    run = lambda: {r.event_id: (r.state, r.since) for r in Z.fold_sessions(Z.files(spark, drop, spark.read.parquet(drop).schema), out, progress, "start", idle_days=5).collect()}
    add(spark, drop, [(1, at(0), 7, "x"), (2, at(0), 8, "start"), (3, at(1), 8, "x")], schema)
    assert run() == {1: (None, 0), 2: (2, 0), 3: (2, 1)}
    add(spark, drop, [(4, at(2), 8, "x"), (5, at(2), 7, "start")], schema)
    assert run() == {1: (None, 0), 2: (2, 0), 3: (2, 1), 4: (2, 2), 5: (5, 0)}  # over a restart
    add(spark, drop, [(6, at(30), 9, "start")], schema)
    run()
    add(spark, drop, [(7, at(31), 8, "x"), (8, at(31), 9, "x")], schema)
    got = run()
    assert (got[7], got[8]) == ((None, 0), (6, 1))  # 8 was idle and starts anew, 9 was not


def test_settings_of_the_session_stay(spark):
    before = spark.conf.get(Z.STORE, None)
    with Z.state_store(spark):
        assert spark.conf.get(Z.STORE) == Z.ROCKS
    assert spark.conf.get(Z.STORE, None) == before


class State:
    """A map state and its handle, counting what is asked of them."""

    def __init__(self):
        self.held, self.looked, self.walked, self.timers = {}, 0, 0, []

    def getMapState(self, *_):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def exists(self):
        return bool(self.held)

    def getValue(self, k):  # noqa: N802
        self.looked += 1
        return self.held.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self.held[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.held[k]

    def iterator(self):
        self.walked += 1
        return iter(list(self.held.items()))


def test_a_bucket_has_few_timers_and_is_walked_once_for_those_that_pass_together():
    import pandas as pd

    state, once = State(), Z.Once(["k", "d"], "k", "d", 7 * Z.DAY_MS)
    once.init(state)
    chunks = [pd.DataFrame({"k": range(i, i + 10), "d": ["x"] * 10, "event_ms": range(i, i + 10)}) for i in range(0, 50, 5)]
    assert sum(len(f) for f in once.handleInputRows((0,), iter(chunks), None)) == 55
    assert state.timers == [8 * Z.DAY_MS] and state.looked < 100  # the first chunk met an empty state

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 9 * Z.DAY_MS)  # noqa: N815

    for _ in range(3):
        list(once.handleExpiredTimer((0,), Times, None))
    assert state.walked == 1 and not state.held
