"""The dictionary: notes for everything, the catalogue's view of versions, drift, and what stops it."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.plans.pipeline import Warehouse
from shelfmark.sources import dictionary, generator, store
from shelfmark.sources.dictionary import Column, Drift, Table
from shelfmark.sources.raw import SOURCES
from shelfmark.sources.versions import Versions

NOTED = {"t": Table("marts", "a table", (Column("day", "date", "its day"), Column("n", "int", "how many, it's | \\ said")))}


@pytest.fixture()
def database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE described_here LOCATION '{tmp_path}/database'")
    yield "described_here"
    spark.sql("DROP DATABASE described_here CASCADE")


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    found = Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    chain = generator.Chain(start=date(2025, 1, 1), end=date(2025, 1, 9), stores=2)
    for name in SOURCES:
        found.land(name, generator.generate(spark, chain, name))
    found.build()
    found.take_snapshot(datetime(2025, 1, 9))
    return found


def test_every_declared_table_and_column_is_described():
    assert all(t.note for t in dictionary.DECLARED.values()) and all(c.note for t in dictionary.DECLARED.values() for c in t.columns)


def test_a_warehouse_is_as_declared_and_written(spark, house, tmp_path):
    path = f"{tmp_path}/DICTIONARY.md"
    declared = sum(len(t.columns) for t in dictionary.DECLARED.values())
    assert house.write_dictionary(path) == house.write_dictionary(path) == declared
    text = store.read_text(spark, path)
    assert [line for line in text.splitlines() if line.startswith("## ")] == ["## raw", "## staging", "## intermediate", "## marts", "## snapshots"]
    assert text.count("\n### ") == len(dictionary.DECLARED) and "| revenue_net | decimal(22,2) |" in text


def test_an_undescribed_mart_column_stops_the_dictionary_and_leaves_the_old_one(spark, house, tmp_path):
    path = f"{tmp_path}/DICTIONARY.md"
    house.write_dictionary(path)
    before = store.read_text(spark, path)
    with pytest.raises(ValueError, match=r"not described: sales\.margin"), house.together() as change:
        change.put("sales", change.read("sales").withColumn("margin", F.lit(1)), "order_date")
        house.write_dictionary(path)
    with pytest.raises(ValueError, match="not as declared.*visitors"), house.together() as change:
        change.put("conversion", change.read("conversion").withColumn("visitors", F.col("visitors").cast("long")), "traffic_date")
        house.write_dictionary(path)
    assert store.read_text(spark, path) == before and "margin" not in house.read("sales").columns


def test_a_version_is_entered_without_a_copy(spark, database, tmp_path):
    tables = Versions(spark, f"{tmp_path}/tables")
    rows = spark.createDataFrame([(date(2025, 1, 1), 1), (date(2025, 1, 2), 2), (date(2025, 1, 3), None)], "day date, n int")
    with tables.change() as change:
        change.put("t", rows, "day")
        change.put("plain", rows)
        change.put("none", rows.limit(0), "day")
    first = tables.at()
    assert sorted(dictionary.enter_version(first, database, NOTED)) == ["none", "plain", "t"]
    with tables.change() as change:
        change.put_dates("t", rows.filter("n = 2").withColumn("n", F.lit(20)), "day", [date(2025, 1, 2)])
    ask = lambda where="true": [tuple(r) for r in spark.sql(f"SELECT day, n FROM {database}.t WHERE {where} ORDER BY day").collect()]
    assert ask() == [(date(2025, 1, 1), 1), (date(2025, 1, 2), 2), (date(2025, 1, 3), None)]
    dictionary.enter_version(tables.at(), database, NOTED)
    assert ask("day = DATE '2025-01-02'") == [(date(2025, 1, 2), 20)] and first.read("t").agg(F.sum("n")).first()[0] == 3
    assert spark.table(f"{database}.plain").count() == 3 and spark.table(f"{database}.none").isEmpty()
    told = dictionary.entered(spark, database)
    assert told["t"].note == "a table" and {c.name: c for c in told["t"].columns} == {c.name: c for c in NOTED["t"].columns}
    assert [(d.column, d.kind) for d in dictionary.drift({"plain": told["plain"]}, NOTED)] == [("day", "extra"), ("n", "extra")]
    plan = spark.table(f"{database}.t").filter("day = DATE '2025-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_drift_names_each_kind():
    found = {"t": Table("", "", (Column("n", "bigint", "how many"), Column("more", "int", "")))}
    assert dictionary.drift(found, NOTED) == [Drift("t", "day", "missing", "date", None), Drift("t", "more", "extra", None, "int"), Drift("t", "n", "type", "int", "bigint")]
    assert dictionary.drift({"t": Table("", "", (Column("day", "date", ""), NOTED["t"].columns[1]))}, NOTED) == [Drift("t", "day", "not described", "date", "date")]
    assert dictionary.drift({}, NOTED) == []


def test_filled_counts_values_of_any_column_and_of_no_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "`n_rows` int, `a.b` string, `column` string")
    assert sorted(map(tuple, dictionary.filled(rows).collect())) == [("a.b", 2, 0), ("column", 2, 2), ("n_rows", 2, 1)]
    assert sorted(map(tuple, dictionary.filled(rows.limit(0)).collect())) == [("a.b", 0, 0), ("column", 0, 0), ("n_rows", 0, 0)]
