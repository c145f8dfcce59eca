"""End to end on a generated chain: full and incremental builds agree, defects are found, late returns leave a trace."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.digest import table_digest
from shelfmark.plans.gates import GateFailed
from shelfmark.plans.pipeline import Warehouse
from shelfmark.plans.reconcile import reconcile
from shelfmark.sources import generator
from shelfmark.sources.raw import SOURCES
from shelfmark.streaming.landing import land_stream

DAY = date(2025, 2, 20)
BAD = generator.Defects(frozenset({date(2025, 2, 5)}), frozenset({date(2025, 2, 6)}), frozenset({date(2025, 2, 7)}), frozenset({date(2025, 2, 7)}), ((1, date(2025, 2, 1), date(2025, 2, 28), 0.0),))
CHAIN = generator.Chain(start=date(2025, 1, 1), end=date(2025, 2, 24), stores=3, defects=BAD)


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("chain"))
    house = Warehouse(spark, root)
    for name in SOURCES:
        house.land(name, generator.generate(spark, CHAIN, name))
    house.build()
    return house


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_a_partition_alone_equals_the_full_run(spark, chain):
    for name in ("orders", "order_items", "returns", "cancellations"):
        alone = generator.generate(spark, CHAIN, name, DAY, DAY)
        full = chain.raw(name).filter(F.col(SOURCES[name].partition) == F.lit(DAY))
        columns = SOURCES[name].schema.names
        assert table_digest(alone.select(*columns)).first() == table_digest(full.select(*columns)).first()


def test_planted_defects_show(chain):
    sales = chain.read("sales")
    assert sales.filter("order_date = '2025-02-05' and has_orders").count() == 0
    assert chain.read("conversion").filter("traffic_date = '2025-02-06' and has_traffic").count() == 0
    assert {r[0] for r in chain.read("order_lines").filter("source_copies > 1").select("order_date").distinct().collect()} <= {date(2025, 2, 7)}
    checks = {r.check_name for r in chain.read("quality").select("check_name").distinct().collect()}
    assert {"orders_partition_missing", "traffic_partition_missing", "conversion_above_threshold"} <= checks


def test_marts_agree_with_pandas(chain):
    lines, heads = chain.raw("order_items").toPandas(), chain.raw("orders").toPandas()
    lines = lines.sort_values(["line_amount", "quantity", "unit_price", "sku"], kind="stable").drop_duplicates(["order_id", "line_no"])
    live = lines.merge(heads[heads.status == "placed"][["order_id", "store_id"]], on="order_id")
    want = {k: v for k, v in live.groupby(["store_id", "order_date"]).line_amount.sum().items()}
    got = {(r.store_id, r.order_date): r.revenue_gross for r in chain.read("sales").filter("has_orders").collect()}
    assert len(got) > 50 and got == {k: want.get(k, 0) for k in got}


def test_reconciliation_passes_and_can_fail(chain):
    found = reconcile(chain)
    assert [c for c in found if not c.passed] == [] and len(found) == 29
    whole = chain.read("sales")
    chain.save("sales", whole.withColumn("revenue_gross", F.col("revenue_gross") + 1), None)
    assert {c.name for c in reconcile(chain) if not c.passed} == {"gross revenue", "net is gross less returns"}
    chain.build()


def test_incremental_equals_full_and_reruns_change_nothing(chain):
    columns = [c for c in chain.read("sales").columns]
    before = {t: table_digest(chain.read(t).select(*sorted(chain.read(t).columns))).first() for t in ("sales", "conversion", "trend", "quality", "order_lines")}
    chain.build(DAY)
    chain.build(DAY)
    assert before == {t: table_digest(chain.read(t).select(*sorted(chain.read(t).columns))).first() for t in before}
    assert columns


def test_daily_runs_log_late_returns(spark, chain, tmp_path):
    days = [DAY + timedelta(days=i) for i in range(3)]
    chain.rewind(days[0])
    for day in days:
        chain.land("returns", generator.generate(spark, CHAIN, "returns", day, day), [day])
        assert chain.run(day, f"{tmp_path}/alerts.log").count() >= 9
    log = chain.revisions()
    assert log.count() > 0 and log.filter("reason <> 'late return'").count() == 0
    assert log.filter("revenue_net_delta < 0").count() > 0


def test_a_missing_source_stops_the_run_and_leaves_an_alert(chain, tmp_path):
    with pytest.raises(GateFailed, match="source_is_fresh"):
        chain.backfill(date(2025, 2, 5), date(2025, 2, 6), f"{tmp_path}/alerts.log")
    assert len((tmp_path / "alerts.log").read_text().splitlines()) == 1


def test_streamed_landing_equals_the_batch(spark, tmp_path):
    source = SOURCES["store_traffic"]
    generator.generate(spark, CHAIN, "store_traffic").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    for run in range(2):  # the second run has lost its checkpoint: nothing may double
        land_stream(stream, f"{tmp_path}/out", "store_traffic", f"{tmp_path}/c{run}").awaitTermination()
    columns = source.schema.names
    landed = spark.read.schema(source.schema).parquet(f"{tmp_path}/out/raw/store_traffic")
    assert rows(landed, *columns) == rows(spark.read.parquet(f"{tmp_path}/in"), *columns)
