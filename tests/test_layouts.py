"""Layout by key, typed CSV, digest trees, windows read from the data, bounds from names, gates in one pass: cases and plans."""

import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import digest
from shelfmark.operators.dates import DateWindow
from shelfmark.plans import catalogue, gates, layers, marts
from shelfmark.plans.pipeline import Warehouse
from shelfmark.sources import csv_files, generator, keyed, raw, store
from shelfmark.sources.versions import Versions

SF = "/root/testdata/sf0.001"
CHAIN = generator.Chain(start=date(2025, 1, 1), end=date(2025, 2, 9), stores=2)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def merged_joins(spark):
    """Joins as between tables too large to send around."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_on_the_key_need_no_exchange(spark, merged_joins):
    k = catalogue.Keyed(catalogue.Star(spark, SF))
    lines = layers.order_lines(layers.stage_order_items(k.items), layers.stage_orders(k.orders))
    returns = layers.returns_attributed(layers.stage_returns(k.returns), layers.stage_orders(k.orders))
    for df in (lines, returns, gates.line_dates(k.items, k.orders), gates.relationship(k.items, "order_id", k.orders, "order_id"), gates.relationship(k.cancellations, "order_id", k.orders, "order_id")):
        plan = plan_of(df)
        assert "SortMergeJoin" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    five = plan_of(catalogue.Keyed.relationships(k))
    traffic = five.count("hashpartitioning")  # the traffic of the event stream is counted by store and day first
    assert traffic == plan_of(k.traffic).count("hashpartitioning") and five.count("LeftAnti") == 5


def test_keyed_tables_open_again_and_keep_their_names_to_themselves(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 5, None if i == 3 else f"v{i}") for i in range(40)], "id long, k int, v string")
    first = keyed.write_keyed(df, f"file://{tmp_path}/t", "k", 4)
    again = keyed.open_keyed(spark, f"file://{tmp_path}/t")
    assert sorted(map(tuple, first.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("keyed_")] == []
    assert [keyed.buckets_for(n, 10) for n in (0, 80, 81, 1000)] == [8, 8, 16, 128]


CELLS = "id long, flag boolean, amount decimal(10,2), day date, at timestamp_ntz, note string"
ROWS = [
    (1, True, Decimal("1.50"), date(2025, 1, 1), datetime(2025, 1, 1, 10, 0, 0, 5), "plain"), (2, False, Decimal("-0.01"), None, None, ""), (3, None, None, date(9999, 12, 31), datetime(1970, 1, 1), None),
    (4, True, Decimal("99999999.99"), date(2025, 2, 28), None, 'quote " comma, and ""two""'), (5, None, None, None, None, " spaces "), (6, None, None, None, None, "t"), (7, None, None, None, None, "é 🙂"), (8, None, None, None, None, "\\back"),
]


def test_csv_comes_back_as_it_was(spark, tmp_path):
    df = spark.createDataFrame(ROWS, CELLS)
    csv_files.write_csv(df, f"{tmp_path}/out")
    rows = csv_files.read_csv(spark, f"{tmp_path}/out", df.schema)
    assert sorted(csv_files.sound(rows).collect()) == sorted(df.collect()) and csv_files.sound(rows).schema.names == df.schema.names
    assert rows.filter(F.size("malformed") > 0).count() == 0


def test_values_with_line_breaks_need_to_be_allowed(spark, tmp_path):
    df = spark.createDataFrame([(1, "two\nlines"), (2, "one")], "id long, v string")
    with pytest.raises(Exception, match="line break"):
        csv_files.write_csv(df, f"{tmp_path}/no")
    csv_files.write_csv(df, f"{tmp_path}/yes", lines=True)
    assert sorted(csv_files.sound(csv_files.read_csv(spark, f"{tmp_path}/yes", df.schema, lines=True)).collect()) == sorted(df.collect())
    with pytest.raises(TypeError, match="no CSV form"):
        csv_files.write_csv(df.select(F.array("id").alias("a")), f"{tmp_path}/never")


def test_bad_cells_and_records_are_set_apart(spark, tmp_path):
    (tmp_path / "in.csv").write_text("order_id,store_id,order_ts,order_date,channel,status,customer_id\n1,1,2025-03-10 10:00:00,2025-03-10,web,placed,\n2,one,2025-13-10 10:00:00,2025-03-10,web,placed,7\n3,1,short\n4,,2025-03-10 10:00:00,2025-03-10,web,placed,\n5,1,2025-03-10 10:00:00,2025-03-10,web,placed,1,too many\n")
    rows = csv_files.read_csv(spark, f"{tmp_path}/in.csv", raw.SOURCES["orders"].schema)
    found = {r.order_id: ([tuple(c) for c in r.malformed], r.record) for r in rows.collect() if r.order_id}
    assert found == {1: ([], None), 2: ([("store_id", "one"), ("order_ts", "2025-13-10 10:00:00")], None), 4: ([("store_id", None)], None)}
    assert sorted(r.record for r in rows.filter("record is not null").collect()) == ["3,1,short", "5,1,2025-03-10 10:00:00,2025-03-10,web,placed,1,too many"]
    assert [r.order_id for r in csv_files.sound(rows).collect()] == [1]


def dated(spark, *rows):
    return spark.createDataFrame(rows, "day date, v string")


def tree(df, **more):
    return digest.digest_tree(digest.day_digests(df, "day", **more))


def test_the_tree_names_the_one_changed_day(spark):
    rows = [(date(2025, m, d), f"v{i}") for m in (1, 2, 3) for d in (1, 2) for i in range(40)]
    whole, turned = dated(spark, *rows), dated(spark, *rows[::-1])
    changed = dated(spark, *rows[:85], (rows[85][0], None), *rows[86:])
    assert digest.differing_days(tree(whole), tree(turned)).count() == 0
    assert [tuple(r) for r in digest.differing_days(tree(whole), tree(changed)).collect()] == [("2025-02-01", 40, 40)]
    levels = {r.level: r["count"] for r in tree(whole).groupBy("level").count().collect()}
    assert levels == {"table": 1, "month": 3, "day": 6}


def test_trees_see_null_days_copies_and_missing_days(spark):
    a = dated(spark, (None, "x"), (date(2025, 1, 1), "y"), (date(2025, 1, 1), "y"), (date(2025, 1, 2), "z"))
    b = dated(spark, (None, ""), (date(2025, 1, 1), "y"), (date(2025, 2, 2), "z"))
    odd = sorted(tuple(r) for r in digest.differing_days(tree(a), tree(b)).select("key", F.coalesce("n_rows_a", F.lit(0)), F.coalesce("n_rows_b", F.lit(0))).collect())
    assert odd == [("2025-01-01", 2, 1), ("2025-01-02", 1, 0), ("2025-02-02", 0, 1), ("none", 1, 1)]
    empty = tree(a.limit(0))
    assert [(r.level, r.n_rows) for r in empty.collect()] == [("table", 0)]
    assert digest.differing_days(tree(a), empty).count() == 3


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("layout")))
    for name in raw.SOURCES:
        house.land(name, generator.generate(spark, CHAIN, name))
    house.build()
    return house


def test_published_partitions_are_pruned_by_the_flags_threshold(spark, house):
    view, last = house.view(), date(2025, 2, 5)
    flags = spark.createDataFrame([(1, last, "return_outside_window", "r", 9.0, 3.0)], "store_id int, flag_date date, check_name string, reason string, measured_value double, threshold_value double")
    got = {r.metric: r.value for r in marts.publish_summary(view.read("sales"), view.read("conversion"), flags, last).collect()}
    assert got["window_days"] == 4 and got["flags return_outside_window"] == 1
    assert got == {r.metric: r.value for r in marts.publish_summary(view.read("sales"), view.read("conversion"), flags, DateWindow.ending(last, 3)).collect()}
    none = {r.metric: r.value for r in marts.publish_summary(view.read("sales"), view.read("conversion"), flags.limit(0), last).collect()}
    assert none["window_days"] == 29
    plan = marts.publish_summary(view.read("sales"), view.read("conversion"), flags, last)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*order_date.*ubquery", plan), plan


def test_the_horizon_comes_from_names(spark, house, tmp_path):
    assert tuple(house.horizon().first()) == (CHAIN.start, CHAIN.end)
    assert "Scan parquet" not in plan_of(house.horizon())
    assert tuple(store.partition_bounds(spark, (f"{tmp_path}/nothing", "d")).first()) == (None, None)
    path = f"{tmp_path}/t"
    spark.createDataFrame([(date(2025, 1, 3), 1)], "d date, v int").write.partitionBy("d").parquet(path)
    (tmp_path / "t" / "d=2024-01-01").mkdir()  # a folder without data is no day
    assert tuple(store.partition_bounds(spark, (path, "d")).first()) == (date(2025, 1, 3), date(2025, 1, 3))
    months = spark.createDataFrame([(date(2025, m, 1), date(2025, m, d)) for m in (1, 2, 3) for d in (7, 20)], "m date, d date")
    months.write.partitionBy("m").parquet(f"{tmp_path}/months")
    edges = store.edge_bounds(spark, f"{tmp_path}/months", "m", "d")
    assert tuple(edges.first()) == (date(2025, 1, 7), date(2025, 3, 20)) and edges.inputFiles() and "PartitionFilters: [m" in plan_of(edges)
    assert tuple(store.edge_bounds(spark, f"{tmp_path}/nothing", "m", "d").first()) == (None, None)


def test_gates_measured_while_writing_equal_those_of_a_scan(spark, tmp_path):
    rows = [(1, date(2025, 1, 1), True, None), (1, date(2025, 1, 1), None, Decimal(-1)), (None, date(2025, 1, 2), False, Decimal(1))]
    df = spark.createDataFrame(rows, "store_id int, order_date date, has_orders boolean, returns_arrived_amount decimal(22,2)")
    tables = Versions(spark, f"{tmp_path}/set")
    with tables.change() as change:
        counts = change.put("sales", df, "order_date", gates.single_row("sales"))
    measured = gates.measure("sales", gates.Measured(tables.at().read("sales"), counts), {})
    assert measured == gates.measure("sales", df, {}) and measured["sales.store_id not_null"] == 1 and measured["sales unique_grain"] == 1
    with pytest.raises(ValueError, match=r"sales lacks \['has_orders'\]"):
        gates.measure("sales", df.drop("has_orders"), {})


def test_a_table_is_scanned_once_for_all_its_gates(spark):
    orders = spark.createDataFrame([(1, 1, date(2025, 1, 1), "fax", "placed", False, False), (1, 9, None, "web", "lost", None, False), (None, None, None, None, None, None, None)], "order_id long, store_id int, order_date date, channel string, status string, is_cancelled boolean, is_offline boolean")
    stores = spark.createDataFrame([(1, date(2025, 1, 1)), (1, date(2025, 1, 1))], "store_id int, opened_on date")
    found = gates.measure("stg_orders", orders, {"stg_stores": stores})
    assert found == {
        "stg_orders.order_id not_null": 1, "stg_orders.store_id not_null": 1, "stg_orders.order_date not_null": 2, "stg_orders.is_cancelled not_null": 2, "stg_orders.is_offline not_null": 1,
        "stg_orders.channel accepted_values": 1, "stg_orders.status accepted_values": 1, "stg_orders.store_id relationship": 1, "stg_orders.order_id unique": 1,
    }
    assert gates.measure("stg_orders", orders.limit(0), {"stg_stores": stores})["stg_orders.order_id unique"] == 0


def test_the_trend_of_a_window_reads_and_writes_few_days(spark, house):
    mart = house.read("sales")
    window = DateWindow(date(2025, 1, 20), date(2025, 1, 22))
    part = marts.trend(mart, window)
    full = {(r.store_id, r.order_date): r for r in marts.trend(mart).collect()}
    got = part.collect()
    assert {r.order_date for r in got} == set(DateWindow(date(2025, 1, 20), date(2025, 1, 28)).days()) and all(full[r.store_id, r.order_date] == r for r in got)
    plan = plan_of(part)
    assert "order_date" in plan and "2025-01-14" in plan and "PartitionFilters" in plan
