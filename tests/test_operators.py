from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import digest, scd2
from shelfmark.operators.dates import DateWindow
from shelfmark.operators.grain import bounds, dedup_by_grain, dense_spine, mismatches, rolling_full_mean
from shelfmark.plans import gates, layers, marts
from shelfmark.sources import raw, store

D = date(2025, 3, 10)
ORDER = "order_id long, store_id int, order_ts timestamp_ntz, order_date date, channel string, status string, customer_id long"
ITEM = "order_id long, order_date date, line_no int, sku string, quantity int, unit_price decimal(10,2), line_amount decimal(12,2)"


def item(order=1, line=1, amount="10.00", quantity=1, sku="a", day=D):
    return (order, day, line, sku, quantity, Decimal("10.00"), Decimal(amount))


def order(number=1, status="placed", channel="offline", day=D, store_id=1):
    return (number, store_id, datetime.combine(day, datetime.min.time()), day, channel, status, None)


@pytest.fixture()
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def test_dedup_keeps_the_smallest_and_counts(make):
    rows = [item(), item(), item(order=2, amount="10.00"), item(order=2, amount="-10.00"), item(order=3)]
    got = {r.order_id: (r.line_amount, r.source_copies) for r in layers.stage_order_items(make(rows, ITEM)).collect()}
    assert got == {1: (Decimal("10.00"), 2), 2: (Decimal("-10.00"), 2), 3: (Decimal("10.00"), 1)}


def test_dedup_of_null_keys_and_values(make):
    df = make([(None, 1, None), (None, 1, 5), (1, 1, None)], "a int, b int, c int")
    assert sorted(map(tuple, dedup_by_grain(df, ["a", "b"], ["c"]).collect()), key=repr) == sorted([(None, 1, None, 2), (1, 1, None, 1)], key=repr)


def test_spine_has_no_days_before_opening_or_for_late_stores(make):
    stores = make([(1, D), (2, date(2025, 3, 12)), (3, date(2026, 1, 1))], "store_id int, opened_on date")
    horizon = bounds((make([(date(2025, 3, 9),), (date(2025, 3, 13),)], "d date"), "d"))
    days = [(r.store_id, r.calendar_date.day) for r in dense_spine(stores, horizon).orderBy("store_id", "calendar_date").collect()]
    assert days == [(1, 10), (1, 11), (1, 12), (1, 13), (2, 12), (2, 13)]


def test_spine_of_empty_tables(make):
    empty = bounds((make([], "d date"), "d"))
    assert dense_spine(make([(1, D)], "store_id int, opened_on date"), empty).count() == 0


def build(make, orders, items, returns=(), days=3):
    spine = make([(1, date(2025, 3, 9 + i)) for i in range(days)], "store_id int, calendar_date date")
    heads = layers.stage_orders(make(orders, ORDER))
    lines = layers.order_lines(layers.stage_order_items(make(items, ITEM)), heads)
    back = make([(i, o, D, 1, c, 1, Decimal(a)) for i, (o, c, a) in enumerate(returns)], "return_id long, order_id long, order_date date, line_no int, returned_date date, quantity int, returned_amount decimal(12,2)")
    mart = marts.sales(spine, heads, lines, layers.returns_attributed(layers.stage_returns(back), heads))
    return {r.order_date.day: r for r in mart.collect()}


def test_sales_tells_null_from_zero(make):
    rows = build(make, [order(1), order(2, "cancelled", day=date(2025, 3, 11)), order(3)], [item(), item(order=2, day=date(2025, 3, 11))], [(1, date(2025, 3, 9), "4.00")])
    empty, full, only_cancelled = rows[9], rows[10], rows[11]
    assert not empty.has_orders and empty.orders_count is None and empty.revenue_gross is None and empty.revenue_net is None
    assert empty.returns_arrived_amount == 4
    assert (full.orders_count, full.lines_count, full.revenue_gross, full.returns_amount, full.revenue_net) == (2, 1, 10, 4, 6)
    assert (only_cancelled.has_orders, only_cancelled.orders_count, only_cancelled.orders_cancelled_count, only_cancelled.revenue_gross) == (True, 0, 1, 0)


def test_orphan_line_stays_without_store_and_out_of_sums(make):
    lines = layers.order_lines(layers.stage_order_items(make([item(), item(order=9)], ITEM)), layers.stage_orders(make([order()], ORDER)))
    assert gates.not_null(lines, "store_id").count() == 1
    assert build(make, [order()], [item(), item(order=9)])[10].revenue_gross == 10


def conv(make, visitors, orders):
    spine = make([(1, D)], "store_id int, calendar_date date")
    traffic = make([(1, D, visitors)] if visitors is not None else [], "store_id int, traffic_date date, visitors int")
    return marts.conversion(spine, traffic, layers.stage_orders(make([order(i) for i in range(orders)], ORDER)))


@pytest.mark.parametrize(("visitors", "orders", "ratio", "flags"), [(0, 5, None, 1), (0, 0, None, 0), (100, 95, 0.95, 0), (100, 96, 0.96, 1), (None, 3, None, 0), (50, 0, None, 0)])
def test_conversion_and_its_flag(make, visitors, orders, ratio, flags):
    c = conv(make, visitors, orders)
    assert c.first().conversion == ratio
    assert marts.flag_conversion(c).count() == flags


@pytest.mark.parametrize(("delay", "n"), [(28, 0), (29, 1)])
def test_late_return_flag_is_strict(make, delay, n):
    assert marts.flag_late_returns(make([(1, D, delay)], "store_id int, order_date date, delay_days int")).count() == n


def test_trend_needs_seven_numbers(make):
    rows = [(1, date(2025, 3, i + 1), None if i == 8 else Decimal(i)) for i in range(10)]
    got = [r[-1] for r in rolling_full_mean(make(rows, "s int, d date, v decimal(12,2)"), "s", "d", "v").orderBy("d").collect()]
    assert got[:6] == [None] * 6 and got[6:8] == [3.0, 4.0] and got[8:] == [None, None]


def test_mismatch_is_null_safe(make):
    a, b = make([(1, None), (2, 1), (3, 1)], "k int, v int"), make([(1, None), (2, 2), (4, 1)], "k int, v int")
    assert sorted(r.k for r in mismatches(a, b, ["k"], ["v"]).collect()) == [2, 3, 4]


def state(make, gross, returns, orders=1):
    return make([(1, D, orders, gross, returns, None if gross is None else gross - returns)], "store_id int, order_date date, orders_count long, revenue_gross int, returns_amount int, revenue_net int")


KEYS, CHECKED = ["store_id", "order_date"], ["orders_count", "revenue_gross", "returns_amount", "revenue_net"]


def test_snapshot_versions_reasons_and_reruns(make):
    at = [datetime(2025, 3, i) for i in range(1, 7)]
    s = scd2.first_snapshot(state(make, 10, 0), KEYS, at[0])
    for t, new in zip(at[1:], [state(make, 10, 2), state(make, 12, 5), state(make, 12, 5, 2), state(make, 12, 5, 2)], strict=False):
        s = scd2.snapshot(s, new, KEYS, CHECKED, t)
        s = scd2.snapshot(s, new, KEYS, CHECKED, t)
    assert s.count() == 4 and s.filter("valid_to is null").count() == 1
    log = scd2.revisions(s, KEYS).orderBy("version_no").collect()
    assert [(r.version_no, r.reason, r.revenue_net_delta) for r in log] == [(2, "late return", -2), (3, "raw layer rebuilt", -1), (4, "order mix changed", 0)]


def test_digest_ignores_order_only(make):
    a, b, c = make([(1, "x"), (2, None)], "a int, b string"), make([(2, None), (1, "x")], "a int, b string"), make([(1, "x"), (2, "")], "a int, b string")
    first = [digest.table_digest(x).first() for x in (a, b, c)]
    assert first[0] == first[1] != first[2]
    assert digest.table_digest(a.limit(0)).first().n_rows == 0


def test_gates(make):
    t = make([(1, "a"), (1, "b"), (None, None), (-3, "c")], "k int, v string")
    assert [tuple(r) for r in gates.unique(t, "k").collect()] == [(1, 2)]
    assert gates.not_null(t, "k").count() == 1 and gates.not_negative(t, "k").count() == 1
    assert [r.value for r in gates.accepted_values(t, "v", ["a", "b"]).collect()] == ["c"]
    assert gates.relationship(t, "k", make([(1,)], "id int"), "id").count() == 1
    orders, traffic = make([(D,)], "order_date date"), make([(date(2025, 3, 9),)], "traffic_date date")
    assert [r.table_name for r in gates.freshness(orders, traffic).collect()] == ["store_traffic"]
    assert gates.freshness(orders, traffic, date(2025, 3, 8)).count() == 2
    with pytest.raises(gates.GateFailed):
        gates.enforce([gates.Gate("x", lambda: t)])
    assert gates.enforce([gates.Gate("x", lambda: t, stops=False)]) == {"x": 4}


def test_cancellations_must_agree(make):
    heads = layers.stage_orders(make([order(1, "cancelled"), order(2, "cancelled", day=date(2025, 3, 12)), order(3)], ORDER))
    rows = make([(3, 3, D, D, "x")], "cancellation_id long, order_id long, order_date date, cancelled_date date, reason string")
    got = sorted((r.order_id, r.violation) for r in gates.status_agreement(heads, rows).collect())
    assert got == [(1, "cancelled without a row"), (3, "row of a live order")]


def test_partitions_are_replaced_even_by_nothing(make, tmp_path):
    path = f"{tmp_path}/t"
    store.reload(make([(1, D), (2, date(2025, 3, 11))], "v int, d date"), path, "d")
    store.replace_dates(make([(5, D), (6, D)], "v int, d date"), path, "d", [D, date(2025, 3, 11)])
    read = lambda: sorted(r.v for r in make([], "x int").sparkSession.read.parquet(path).collect())
    assert read() == [5, 6]
    store.replace_keys(make([(6, D), (7, D)], "v int, d date"), path, ["v"], "d")
    assert read() == [5, 6, 7]
    store.delete_where(make([], "x int").sparkSession, path, F.col("v") == 5, "d")
    assert read() == [6, 7]
    with pytest.raises(ValueError, match="outside"):
        store.replace_dates(make([(1, date(2020, 1, 1))], "v int, d date"), path, "d", [D])


def test_date_filter_reaches_the_scan_through_dedup(make, tmp_path, spark):
    store.reload(make([item()], ITEM), f"{tmp_path}/raw/order_items", "order_date")
    staged = layers.stage_order_items(raw.read(spark, f"{tmp_path}/raw", "order_items"))
    plan = DateWindow(D, D).cut(staged, "order_date")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(order_date" in plan


def test_csv_is_typed_by_the_registry(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order_id,store_id,order_ts,order_date,channel,status,customer_id\n7,1,2025-03-10 10:00:00,2025-03-10,web,placed,\n")
    df = raw.read_csv(spark, f"{tmp_path}/o.csv", "orders")
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in raw.SOURCES["orders"].schema] and df.first().customer_id is None


def test_dictionary_fails_on_gaps(make):
    t = {"t": make([(1,)], "a int")}
    assert "| a | int | key |" in raw.dictionary(t, {"t": {"a": "key"}})
    with pytest.raises(ValueError, match="not described"):
        raw.dictionary(t, {})
