"""The snapshot on disk: history stays as it is, a repeated or cut-off run changes nothing; a replay skips days that are not healthy."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import scd2
from shelfmark.operators.dates import DateWindow
from shelfmark.plans.pipeline import CHECKED, CLOSED, GRAIN, Warehouse
from shelfmark.sources import generator, store
from shelfmark.sources.raw import SOURCES

DAYS = [datetime(2025, 3, d) for d in (1, 2, 3)]
MONEY = "decimal(22,2)"


def mart(spark, net):
    rows = [(s, date(2025, 2, d), 5, net if d == 1 else 100) for s in (1, 2) for d in (1, 2)]
    df = spark.createDataFrame(rows, "store_id int, order_date date, orders_count long, n int")
    return df.select(*GRAIN, "orders_count", F.col("n").cast(MONEY).alias("revenue_gross"), F.lit(0).cast(MONEY).alias("returns_amount"), F.col("n").cast(MONEY).alias("revenue_net"))


def as_set(df):
    rows = [tuple(r) for r in df.select(*GRAIN, *CHECKED, "scd_id", "updated_at", "valid_from", "valid_to").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def house(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    for i, day in enumerate(DAYS):
        house.save("sales", mart(spark, 100 + i), None)
        house.take_snapshot(day)
    return house


def test_history_equals_that_of_one_table_and_is_not_rewritten(spark, house, tmp_path):
    want = scd2.first_snapshot(mart(spark, 100), GRAIN, DAYS[0])
    for i in (1, 2):
        want = scd2.snapshot(want, mart(spark, 100 + i), GRAIN, CHECKED, DAYS[i])
    assert as_set(house.versions()) == as_set(want) and house.versions().count() == 8
    assert set(house.view().folders("closed_versions")) == {f"{CLOSED}={d}" for d in ("2025-03-02", "2025-03-03")}
    before = house.view().folders("closed_versions")
    house.save("sales", mart(spark, 200), None)
    house.take_snapshot(datetime(2025, 3, 4))
    after = house.view().folders("closed_versions")
    assert {k: after[k] for k in before} == before and len(after) == 3
    assert house.versions().count() == 10 and house.revisions().count() == 6


def test_a_repeated_run_changes_nothing(house):
    before = as_set(house.versions())
    house.take_snapshot(DAYS[2])
    assert as_set(house.versions()) == before


def test_a_snapshot_of_a_window_equals_that_of_all_and_touches_its_days_only(spark, house, tmp_path):
    """The mart changes on one day; a window around it gives the same history and leaves the other days' files."""
    at, window = datetime(2025, 3, 4), DateWindow(date(2025, 2, 1), date(2025, 2, 1))
    house.save("sales", mart(spark, 300), None)
    before = house.view().folders("open_versions")
    house.take_snapshot(at, window)
    after = house.view().folders("open_versions")
    assert before.keys() == after.keys() and before["order_date=2025-02-02"] == after["order_date=2025-02-02"] and before["order_date=2025-02-01"] != after["order_date=2025-02-01"]
    whole = Warehouse(spark, f"{tmp_path}/whole")
    for i, day in enumerate([*DAYS, at]):
        whole.save("sales", mart(spark, 300 if day == at else 100 + i), None)
        whole.take_snapshot(day)
    assert as_set(house.versions()) == as_set(whole.versions())
    plan = house.view().read("open_versions")
    house.take_snapshot(at, window)
    assert as_set(house.versions()) == as_set(whole.versions()) and plan.count() == 4


def test_a_run_cut_off_between_any_two_steps_leaves_the_last_version(spark, house, monkeypatch):
    """Whatever write, listing or rename of a run fails, readers see the version before it, and the next run does the whole work."""
    steps = ["children", "write_text", "move_to_new"]
    before, number = as_set(house.versions()), house.view().version
    fail_at, finished = 0, False
    while not finished:
        calls = []

        def lost(real):
            def call(*args):
                calls.append(real.__name__)
                if len(calls) > fail_at:
                    raise OSError("driver lost")
                return real(*args)

            return call

        with monkeypatch.context() as m:
            for name in steps:
                m.setattr(store, name, lost(getattr(store, name)))
            m.setattr(store, "remove", lambda *args: None)  # a lost driver does not clear up either
            try:
                with house.together():
                    house.save("sales", mart(spark, 200), None)
                    house.take_snapshot(datetime(2025, 3, 4))
                finished = True
            except OSError:
                fail_at += 1
        if not finished:
            assert house._change is None and house.view().version == number and as_set(house.versions()) == before
    assert fail_at >= 6 and house.view().version == number + 1
    assert len(as_set(house.versions())) == 10 and house.versions().filter("valid_to is null").count() == 4
    gone = house.tables.expire(keep=1)
    assert gone and len(as_set(house.versions())) == 10


def test_replay_skips_days_without_orders(spark, tmp_path):
    last, gap = date(2025, 1, 10), date(2025, 1, 12)
    bad = generator.Defects(frozenset({gap}), frozenset(), frozenset(), frozenset(), ())
    chain = generator.Chain(start=date(2025, 1, 1), end=date(2025, 1, 14), stores=2, defects=bad)
    house = Warehouse(spark, str(tmp_path))
    for name in SOURCES:
        house.land(name, generator.generate(spark, chain, name))
    house.build()
    seen = []

    def land(day):
        seen.append(day)
        house.land("returns", generator.generate(spark, chain, "returns", day, day), [day])

    assert house.replay(last, land, days=2) == [date(2025, 1, 11), date(2025, 1, 13)]
    assert seen == [last + timedelta(days=i) for i in (1, 2, 3)]
    assert house.versions().agg(F.min("valid_from")).first()[0] == datetime(2025, 1, 11)
