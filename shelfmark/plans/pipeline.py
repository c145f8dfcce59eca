"""The daily run over a warehouse folder: land, gate, build, snapshot, publish. Any step can be run again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date, datetime, time, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scd2
from ..operators.dates import COMPARE_DAYS, DateWindow, cut
from ..operators.grain import dense_spine
from ..sources import dictionary, raw, store
from ..sources.versions import Change, Versions, View
from . import gates, layers, marts
from .gates import Gate

CHECKED = ["orders_count", "revenue_gross", "returns_amount", "revenue_net"]
GRAIN = ["store_id", "order_date"]
#: Partition column of the versions that were closed.
CLOSED = "closed_on"
#: Built tables and their partition columns. All are versions of one set, so a run's tables appear together.
TABLES = {
    "order_lines": "order_date", "returns": None, "spine": None, "sales": "order_date", "conversion": "traffic_date", "trend": "order_date", "quality": None,
    "open_versions": "order_date", "closed_versions": CLOSED,
}


def parts_of(days: list[date], part: str) -> list[date]:
    """The partitions that hold days, in a table laid out by order_date or by order_month."""
    return sorted({d if part == "order_date" else d.replace(day=1) for d in days})


def by_part(df: DataFrame, part: str) -> DataFrame:
    return df if part == "order_date" else df.withColumn(part, F.trunc("order_date", "month"))


def replace_days(change: Change, name: str, df: DataFrame, window: DateWindow, part: str = "order_date") -> None:
    """The window's days of a table become df. Where partitions are months, their other days are carried over."""
    touched = parts_of(window.days(), part)
    inside = F.col("order_date").between(F.lit(window.low), F.lit(window.high))
    rest = change.read(name).filter(F.col(part).isin(touched) & ~inside)
    change.put_dates(name, by_part(df, part).unionByName(rest) if part != "order_date" else df, part, touched)


def record_versions(change: Change, mart: DataFrame, as_of: datetime, window: DateWindow | None = None, part: str = "order_date") -> None:
    """Bring open_versions and closed_versions of a change up to the mart's state as of then. Open versions lie by `part`, order_date or order_month."""
    day = as_of.date()
    if not change.has("open_versions"):
        first = scd2.first_snapshot(mart, GRAIN, as_of)
        change.put("open_versions", by_part(first, part), part)
        change.put("closed_versions", first.limit(0).withColumn(CLOSED, F.col("valid_to").cast("date")), CLOSED)
        return
    opened = change.read("open_versions")
    opened = opened if part == "order_date" else opened.drop(part)
    today = change.read("closed_versions").filter(F.col(CLOSED) == F.lit(day)).drop(CLOSED)
    near = change.read("open_versions").filter(F.col(part).isin(parts_of(window.days(), part))).select(*opened.columns) if window else opened
    fresh = scd2.snapshot(cut(near, "order_date", window).unionByName(today), cut(mart, "order_date", window), GRAIN, CHECKED, as_of)
    change.put_dates("closed_versions", fresh.filter("valid_to is not null").withColumn(CLOSED, F.col("valid_to").cast("date")), CLOSED, [day])
    still = fresh.filter("valid_to is null")
    if window:
        replace_days(change, "open_versions", still, window, part)
    else:
        days = sorted({*change.dates("open_versions"), *parts_of([r[0] for r in mart.select("order_date").distinct().collect()], part)})
        change.put_dates("open_versions", by_part(still, part), part, days)


class Warehouse:
    """Raw tables as they land, and the built tables as versions: a run adds one version when all its stops have passed, and none otherwise.

    `gate_days` bounds how far back the staging gates of a daily run look by the raw tables' own dates; by default they look at all history."""

    def __init__(self, spark: SparkSession, root: str, gate_days: int | None = None):
        self.spark, self.root, self.gate_days = spark, root.rstrip("/"), gate_days
        self.tables = Versions(spark, f"{self.root}/tables")
        self._change: Change | None = None

    @contextmanager
    def together(self) -> Iterator[Change]:
        """Everything saved inside becomes one version; an exception leaves the last one. Inside another `together` it is part of that."""
        if self._change is not None:
            yield self._change
            return
        with self.tables.change() as self._change:
            try:
                yield self._change
            finally:
                change, self._change = self._change, None
        del change

    def view(self) -> View:
        """What a read sees: the change under way in this object, else the last version."""
        return self._change or self.tables.at()

    def path(self, name: str) -> str:
        return f"{self.tables.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.view().read(name)

    def raw(self, name: str, window: DateWindow | None = None) -> DataFrame:
        return raw.read(self.spark, f"{self.root}/raw", name, window)

    def land(self, name: str, df: DataFrame, days: list[date] | None = None) -> None:
        """Replace a raw table, or its partitions of these days (cleared where df has nothing)."""
        partition = raw.SOURCES[name].partition
        if days is None or partition is None:
            store.reload(df, f"{self.root}/raw/{name}", partition)
        else:
            store.replace_dates(df, f"{self.root}/raw/{name}", partition, days)

    def save(self, name: str, df: DataFrame, window: DateWindow | None, gated: bool = False) -> gates.Measured:
        """Write a table, or its partitions of the window; if it is gated, what its gates see in single rows is counted on the way."""
        partition, watch = TABLES[name], gates.single_row(name) if gated else None
        with self.together() as change:
            if window is None or partition is None or not change.has(name):
                counts = change.put(name, df, partition, watch)
            else:
                counts = change.put_dates(name, df, partition, window.days(), watch)
            return gates.Measured(change.read(name), counts)

    # staging: lazy views of the raw layer
    def orders(self, window: DateWindow | None = None) -> DataFrame:
        return layers.stage_orders(self.raw("orders", window))

    def items(self, window: DateWindow | None = None) -> DataFrame:
        return layers.stage_order_items(self.raw("order_items", window))

    def build(self, run_date: date | None = None) -> dict[str, int]:
        """Build all layers; for a run date only what it can have changed. At the first stop gate with rows nothing of it appears."""
        with self.together():
            return self._build(run_date)

    def _build(self, run_date: date | None) -> dict[str, int]:
        day = DateWindow(run_date, run_date) if run_date else None
        back = DateWindow.ending(run_date) if run_date else None
        compared = DateWindow.ending(run_date, COMPARE_DAYS) if run_date else None
        gated = DateWindow.ending(run_date, self.gate_days) if run_date and self.gate_days is not None else None
        traffic = layers.stage_traffic(self.raw("store_traffic"))
        found = gates.enforce([Gate("source_is_fresh", lambda: gates.freshness(self.orders(), traffic, run_date))])
        found |= gates.enforce_declared({
            "stg_stores": layers.stage_stores(self.raw("stores")), "stg_orders": self.orders(), "stg_order_items": self.items(gated), "stg_returns": layers.stage_returns(self.raw("returns", gated)),
            "stg_cancellations": layers.stage_cancellations(self.raw("cancellations", gated)), "stg_store_traffic": layers.stage_traffic(self.raw("store_traffic", gated)),
        })
        # a late order can only belong to its own date, so one partition is enough here
        lines = self.save("order_lines", layers.order_lines(self.items(day), self.orders(day)), day, gated=True)
        returns = self.save("returns", layers.returns_attributed(layers.stage_returns(self.raw("returns")), self.orders()), None, gated=True)
        spine = self.save("spine", dense_spine(layers.stage_stores(self.raw("stores")), self.horizon()), None, gated=True)
        found |= gates.enforce_declared({"order_lines": lines, "returns": returns, "spine": spine})
        lines, returns, spine = lines.df, returns.df, spine.df
        found |= gates.enforce([
            Gate("lines_match_raw", lambda: gates.lines_match_raw(self.raw("order_items", compared), self.raw("orders"), lines, compared)),
            Gate("line_dates_match", lambda: gates.line_dates(lines, self.orders())),
            Gate("returns_of_live_orders", lambda: gates.live_returns(returns)),
            Gate("cancellations_agree", lambda: gates.status_agreement(self.orders(), layers.stage_cancellations(self.raw("cancellations")))),
        ])
        sales = self.save("sales", marts.sales(spine, self.orders(back), lines, returns, back), back, gated=True)
        conversion = self.save("conversion", marts.conversion(spine, traffic, self.orders(day), day), day, gated=True)
        moved = back if self.view().has("trend") else None
        trend = self.save("trend", marts.trend(sales.df, moved), marts.trend_windows(moved)[1] if moved else None, gated=True)
        quality = self.save("quality", marts.quality(conversion.df, returns), None, gated=True)
        found |= gates.enforce_declared({"sales": sales, "conversion": conversion, "trend": trend, "quality": quality})
        return found | gates.enforce([Gate("no_quality_flags", lambda: marts.flag_summary(quality.df), stops=False)])

    def horizon(self) -> DataFrame:
        """first_day and last_day over the orders and the traffic that landed, read off the names of their partitions."""
        return store.partition_bounds(self.spark, *[(f"{self.root}/raw/{name}", raw.SOURCES[name].partition) for name in ("orders", "store_traffic")])

    def take_snapshot(self, as_of: datetime, window: DateWindow | None = None) -> None:
        """Close and open versions as of then; with a window only those of its days, which must be all that changed since the last one.

        Open versions lie by their order date and closed ones by the day they were closed, so the open ones of the window and those closed on this
        day are read and written, and nothing else. A repeated call finds its own versions and changes nothing."""
        with self.together() as change:
            record_versions(change, change.read("sales").select(*GRAIN, *CHECKED), as_of, window)

    def versions(self) -> DataFrame:
        return self.read("open_versions").unionByName(self.read("closed_versions").drop(CLOSED))

    def revisions(self) -> DataFrame:
        return scd2.revisions(self.versions(), GRAIN)

    def described(self) -> dict[str, dictionary.Table]:
        """All tables as they are now, raw, staged and built, with the notes declared for them."""
        staged = {"stores": layers.stage_stores, "orders": layers.stage_orders, "order_items": layers.stage_order_items, "returns": layers.stage_returns, "cancellations": layers.stage_cancellations, "store_traffic": layers.stage_traffic}
        view = self.view()
        tables = {f"raw_{name}": self.raw(name) for name in raw.SOURCES} | {f"stg_{name}": stage(self.raw(name)) for name, stage in staged.items()} | {name: view.read(name) for name in view.tables}
        if view.has("open_versions"):
            tables["revisions"] = self.revisions()
        return {name: dictionary.shape(df, name) for name, df in tables.items()}

    def write_dictionary(self, path: str) -> int:
        """Write the dictionary as Markdown and return how many columns it has; fails if one is not described, or differs from what is declared."""
        found = self.described()
        text = dictionary.markdown(found)
        if differing := dictionary.drift(found):
            raise ValueError(f"not as declared: {differing}")
        store.remove(self.spark, path)
        store.write_text(self.spark, path, text)
        return sum(len(table.columns) for table in found.values())

    def publish(self, run_date: date) -> DataFrame:
        view = self.view()
        return marts.publish_summary(view.read("sales"), view.read("conversion"), view.read("quality"), run_date)

    def run(self, run_date: date, alerts: str | None = None) -> DataFrame:
        """One daily run; a failure leaves a line in the alerts file and stops before publishing."""
        try:
            with self.together():
                self.build(run_date)
                self.take_snapshot(datetime.combine(run_date, time()), DateWindow.ending(run_date))
                gates.enforce_declared({"revisions": self.revisions()})
            return self.publish(run_date)
        except Exception as failure:
            if alerts:
                with Path(alerts).open("a") as log:
                    log.write(f"{run_date}\t{type(failure).__name__}\t{str(failure).splitlines()[0]}\n")
            raise

    def backfill(self, first: date, last: date, alerts: str | None = None) -> list[date]:
        """Run every date in order; the first failure ends it."""
        done = []
        for i in range((last - first).days + 1):
            self.run(first + timedelta(days=i), alerts)
            done.append(first + timedelta(days=i))
        return done

    def rewind(self, last: date) -> None:
        """Forget what came in after a date: later returns go, and the snapshot's history."""
        store.delete_where(self.spark, f"{self.root}/raw/returns", F.col("returned_date") > F.lit(last), "returned_date")
        with self.together() as change:
            change.drop("open_versions")
            change.drop("closed_versions")

    def is_healthy(self, day: date) -> bool:
        """Whether both tables that a run must find have rows of that day."""
        only = DateWindow(day, day)
        return not any(self.raw(name, only).isEmpty() for name in ("orders", "store_traffic"))

    def replay(self, last: date, land: Callable[[date], None], days: int = 5, until: date | None = None, alerts: str | None = None) -> list[date]:
        """Rewind to a date, then live through the days after it: land what came in on each, and run it if it is healthy.

        Ends after `days` healthy days, or with `until`, the latest landed order day if not given. Returns the days run."""
        until = until or self.orders().agg(F.max("order_date")).first()[0] or last
        self.rewind(last)
        done, day = [], last
        while len(done) < days and day < until:
            day += timedelta(days=1)
            land(day)
            if self.is_healthy(day):
                self.run(day, alerts)
                done.append(day)
        return done
