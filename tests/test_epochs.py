"""Plans of epochs: whole, drawn anew for each, and resumed where a reader stopped."""

import pytest

from tidemark.plans import epochs as E

OPTIONS = {"seed": "s", "groups": 2, "size": 5}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, None if i % 11 == 0 else f"g{i % 7 if i % 3 else 0}") for i in range(160)], "id long, grp string")


def ordered(plan):
    return [r.id for r in sorted(plan.collect(), key=lambda r: (r.span, r.batch, r.slot))]


def test_epochs_differ_and_repeat(spark, rows):
    one, again, two = (E.epoch_plan(rows.repartition(p), "id", "grp", epoch=e, **OPTIONS) for p, e in ((3, 0), (5, 0), (3, 1)))
    assert ordered(one) == ordered(again) != ordered(two)
    assert sorted(ordered(one)) == sorted(ordered(two)) == list(range(160))
    group = {r.id: r.grp for r in rows.collect()}
    spans = {}
    for r in one.collect():
        spans.setdefault(r.span, {}).setdefault(r.batch, []).append(r.slot)
    for batches in spans.values():
        assert sorted(batches) == list(range(len(batches))) and sum(len(b) != 5 for b in batches.values()) <= 1
        assert all(sorted(b) == list(range(len(b))) for b in batches.values())
    for s in spans:
        assert len({group[r.id] for r in one.filter(f"span = {s}").collect()}) <= 2
    whole = E.epoch_plan(rows, "id", "grp", epoch=0, drop_last=True, **OPTIONS)
    assert {n for n, in whole.groupBy("span", "batch").count().select("count").collect()} == {5}


def test_a_reader_goes_on_where_it_stopped(spark, rows, tmp_path):
    plan, cursor = f"file://{tmp_path}/plan", f"file://{tmp_path}/cursor"
    for e in (0, 1):
        E.write_plan(E.epoch_plan(rows, "id", "grp", epoch=e, **OPTIONS), plan)
    full = ordered(E.epoch_plan(rows, "id", "grp", epoch=1, **OPTIONS))
    E.write_cursor(rows, "id", cursor, OPTIONS, epoch=1, span=1, batch=2)
    at = E.read_cursor(rows.orderBy("grp"), "id", cursor, dict(reversed(OPTIONS.items())))
    rest = E.resumed(spark, plan, at)
    assert 0 < len(ordered(rest)) < 160 and ordered(rest) == full[-len(ordered(rest)) :]
    scan = rest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "(span" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    with pytest.raises(E.Mismatch, match="other data"):
        E.read_cursor(rows.filter("id <> 3"), "id", cursor, OPTIONS)
    with pytest.raises(E.Mismatch, match="another configuration"):
        E.read_cursor(rows, "id", cursor, OPTIONS | {"size": 6})
    (tmp_path / "cursor2").mkdir()
    (tmp_path / "cursor2" / "part").write_text('{"digest":"x"}')
    with pytest.raises(E.Mismatch, match="incomplete"):
        E.read_cursor(rows, "id", f"file://{tmp_path}/cursor2", OPTIONS)
