"""One small case for each finding of the third review."""

from shelfmark.operators import grain
from shelfmark.plans import catalogue, reconcile
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"


def test_f1_a_check_that_compared_nothing_knows_no_differences(spark):
    frames = catalogue._built(catalogue.Star(spark, SF))
    frames["mart_conversion"] = frames["mart_conversion"].filter("not coalesce(orders_offline > visitors, false)")
    found = {r.check_name: (r.compared, r.different) for r in reconcile.reconcile_all(frames).collect()}
    assert found["broken counters are flagged"] == (0, None)
    assert found["net is gross less returns"][0] > 0 and found["net is gross less returns"][1] == 0


def test_f2_f3_f6_f7_parts_of_lines_grow_with_them(spark, monkeypatch):
    star = catalogue.Star(spark, SF)
    assert star.raw_items.rdd.getNumPartitions() <= 8
    monkeypatch.setattr(grain, "ROWS_A_TASK", 100)
    star = catalogue.Star(spark, SF)
    lines = star.n_lines
    for df in (star.raw_items, star.items, star.lines, star.returns, catalogue.QUERIES["gate_unique_grain"](spark, SF)):
        assert df.rdd.getNumPartitions() >= lines / 100
        assert max(df.rdd.glom().map(len).collect()) < 300
    for name in ("gate_line_dates", "gate_not_null", "gate_unique_grain", "flags_with_conversion"):
        same_rows(catalogue.QUERIES[name](spark, SF), SF, catalogue.ORACLE_SQL[name])


def test_f4_f5_written_layers_are_not_shuffled_by_order_again(spark):
    star = catalogue.Star(spark, SF).settled()
    plan = star.lines._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "lineitem" not in plan and "Exchange hashpartitioning" not in plan


def test_f8_a_window_writes_only_lines_that_count_in_it(spark):
    star, window = catalogue.Star(spark, SF), catalogue.WINDOW
    near = star.around(window)
    bought, back = (window.cut(df, c).count() for df, c in ((star.items, "order_date"), (star.returns, "returned_date")))
    assert window.cut(near.items, "order_date").count() == bought and window.cut(near.returns, "returned_date").count() == back
    assert 0 < near.items.count() < star.items.count() / 10
    assert near.sales(window).exceptAll(star.sales(window)).count() == 0 == star.sales(window).exceptAll(near.sales(window)).count()
