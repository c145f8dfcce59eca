"""The declared gates stop the daily run before the marts are built."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfmark.plans.gates import DECLARED, GateFailed, enforce_declared
from shelfmark.plans.pipeline import Warehouse
from shelfmark.sources import generator, store
from shelfmark.sources.raw import SOURCES

CHAIN = generator.Chain(start=date(2025, 1, 1), end=date(2025, 1, 8), stores=2)


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("gates")))
    for name in SOURCES:
        house.land(name, generator.generate(spark, CHAIN, name))
    return house


def last(column, value):
    """value in the row with the largest key, the column as it is elsewhere."""
    return lambda df, key: df.withColumn(column, F.when(F.col(key) == df.agg(F.max(key)).first()[0], F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))


@pytest.mark.parametrize(
    ("name", "column", "value", "gate"),
    [
        ("orders", "store_id", 99, "stg_orders.store_id relationship"),
        ("orders", "status", "lost", "stg_orders.status accepted_values"),
        ("orders", "channel", "fax", "stg_orders.channel accepted_values"),
        ("returns", "order_id", -1, "stg_returns.order_id relationship"),
        ("cancellations", "reason", None, "stg_cancellations.reason not_null"),
        ("store_traffic", "visitors", -1, "stg_store_traffic.visitors not_negative"),
    ],
)
def test_a_bad_row_stops_the_run_before_the_marts(spark, house, name, column, value, gate):
    good = generator.generate(spark, CHAIN, name)
    house.land(name, last(column, value)(good, {"orders": "order_id", "returns": "return_id", "cancellations": "cancellation_id", "store_traffic": "traffic_date"}[name]))
    with pytest.raises(GateFailed, match=gate):
        house.build()
    assert not store.exists(spark, house.path("sales"))
    house.land(name, good)


def test_all_generic_gates_are_declared_and_run(house, monkeypatch):
    house.build()
    seen = {}
    monkeypatch.setattr("shelfmark.plans.gates.enforce_declared", lambda tables: seen.update(got := enforce_declared(tables)) or got)
    house.run(date(2025, 1, 8))
    kinds = [k.split()[-1] for k in seen]
    want = {"not_null": 56, "unique_grain": 9, "not_negative": 8, "unique": 5, "relationship": 5, "accepted_values": 4}
    assert {k: kinds.count(k) for k in want} == want and len(kinds) == 87 and not any(seen.values())
    assert {k.split(" ")[0].split(".")[0] for k in seen} == set(DECLARED)
