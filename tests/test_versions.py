"""Versions of a set of tables: readers keep theirs, writers appear at once, conflicts and leftovers."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfmark.sources.versions import Conflict, Versions

A, B, C = date(2025, 1, 1), date(2025, 1, 2), date(2025, 1, 3)


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def tables(spark, tmp_path):
    return Versions(spark, f"{tmp_path}/set")


def days(spark, *rows):
    return spark.createDataFrame(rows, "day date, v int")


def test_a_reader_keeps_its_version_while_the_next_is_written(spark, tables):
    with tables.change() as change:
        change.put("a", days(spark, (A, 1), (B, 2)), "day")
        change.put("b", spark.range(3).toDF("id"))
        assert tables.at().version == 0 and not tables.at().has("a")
    held = tables.at().read("a")
    with tables.change() as change:
        change.put_dates("a", days(spark, (B, 20)), "day", [B])
        change.put("b", spark.range(5).toDF("id"))
        assert values(change.read("a")) == [(A, 1), (B, 20)] and change.read("b").count() == 5
        assert values(held) == [(A, 1), (B, 2)] and values(tables.at().read("a")) == [(A, 1), (B, 2)] and tables.at().read("b").count() == 3
    assert values(held) == [(A, 1), (B, 2)]
    assert values(tables.at().read("a")) == [(A, 1), (B, 20)] and tables.at().read("b").count() == 5
    assert values(tables.at(1).read("a")) == [(A, 1), (B, 2)] and tables.numbers() == [1, 2]


def test_a_failed_change_leaves_nothing(spark, tables, tmp_path):
    with tables.change() as change:
        change.put("a", days(spark, (A, 1)), "day")
    with pytest.raises(ZeroDivisionError), tables.change() as change:
        change.put("a", days(spark, (A, 2)), "day")
        change.put("c", days(spark, (A, 2)))
        1 / 0  # noqa: B018
    assert values(tables.at().read("a")) == [(A, 1)] and not tables.at().has("c")
    assert len(list((tmp_path / "set" / "a").glob("write=*"))) == 1 and not list((tmp_path / "set" / "c").glob("write=*"))


def test_of_two_changes_from_one_version_the_second_is_refused(spark, tables):
    first, second = tables.change(), tables.change()
    first.put("a", days(spark, (A, 1)))
    second.put("a", days(spark, (A, 2)))
    assert first.commit() == 1
    with pytest.raises(Conflict), second:
        pass
    assert values(tables.at().read("a")) == [(A, 1)]


def test_dates_are_replaced_cleared_and_refused(spark, tables):
    with tables.change() as change:
        assert change.put_dates("a", days(spark, (A, 1), (B, 2), (B, 3)), "day", [A, B], {"odd": F.col("v") % 2 == 1, "none": F.col("v").isNull()}) == {"odd": 2, "none": 0}
    with tables.change() as change:
        assert change.put_dates("a", days(spark, (C, 4)), "day", [B, C], {"odd": F.col("v") % 2 == 1}) == {"odd": 0}
        assert change.dates("a") == [A, C]
    with pytest.raises(ValueError, match="outside"), tables.change() as change:
        change.put_dates("a", days(spark, (A, 9)), "day", [C])
    with tables.change() as change:
        assert change.put_dates("a", days(spark).filter("v > 0"), "day", [A, C], {"odd": F.col("v") % 2 == 1}) == {"odd": 0}
    assert values(tables.at().read("a")) == [] and tables.at().read("a").columns == ["day", "v"]
    assert values(tables.at(2).read("a")) == [(A, 1), (C, 4)]


def test_filters_on_the_partition_reach_the_scan(spark, tables):
    with tables.change() as change:
        change.put("a", days(spark, (A, 1), (B, 2)), "day")
    plan = tables.at().read("a").filter(F.col("day") == F.lit(A))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_expiry_keeps_what_is_listed(spark, tables):
    for v in range(4):
        with tables.change() as change:
            change.put_dates("a", days(spark, (A, v)), "day", [A])
            if v == 0:
                change.put("b", days(spark, (B, 7)))
    gone = tables.expire(keep=2)
    assert len(gone) == 3 and tables.numbers() == [3, 4]  # two writes of A and the empty first write
    assert values(tables.at(3).read("a")) == [(A, 2)] and values(tables.at().read("b")) == [(B, 7)]
