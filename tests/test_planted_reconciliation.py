"""The two checks of planted defects name a build that loses outliers or late arrivals together with the raw layer."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfmark.plans.pipeline import Warehouse
from shelfmark.plans.reconcile import reconcile
from shelfmark.sources import generator
from shelfmark.sources.raw import SOURCES

NO_ORDERS, OUTLIERS = date(2025, 1, 20), date(2025, 1, 22)
BAD = generator.Defects(frozenset({NO_ORDERS}), frozenset({date(2025, 1, 21)}), frozenset({OUTLIERS}), frozenset({OUTLIERS}), ((1, date(2025, 1, 10), date(2025, 1, 24), 0.0),))
CHAIN = generator.Chain(start=date(2025, 1, 1), end=date(2025, 1, 24), stores=3, defects=BAD)


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("planted")))
    for name in SOURCES:
        house.land(name, generator.generate(spark, CHAIN, name))
    house.build()
    return house


def failed(house):
    return {c.name for c in reconcile(house, planted=True) if not c.passed}


def test_all_31_checks_pass_and_the_planted_ones_can_fail(spark, house):
    found = reconcile(house, planted=True)
    assert [c for c in found if not c.passed] == [] and len(found) == 31
    items, returns = (generator.generate(spark, CHAIN, name) for name in ("order_items", "returns"))
    house.land("order_items", items.filter("line_amount >= 0 and quantity <> 0"))
    house.land("returns", returns.filter(F.col("returned_date") != F.lit(NO_ORDERS)))
    house.build()
    assert failed(house) == {"returns still arrive on days without orders", "outliers are not filtered out"}
