"""The marts. Null is "nothing to count", zero is "counted, came to zero"; the grain comes from the calendar, not from the data."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dates import REPROCESS_DAYS, DateWindow, cut
from ..operators.grain import rolling_full_mean

MONEY = "decimal(22,2)"
#: Rows of the moving mean.
TREND_ROWS = 7
FLAG = ["store_id", "flag_date", "check_name", "reason", "measured_value", "threshold_value"]


def _if_any(flag: str, value: Column) -> Column:
    """value or zero where there is something to count, else null."""
    return F.when(F.col(flag), F.coalesce(value, F.lit(0)))


def sales(spine: DataFrame, orders: DataFrame, lines: DataFrame, returns: DataFrame, window: DateWindow | None = None) -> DataFrame:
    """Store and day: orders, revenue and returns. Every input is cut on its own date before it is aggregated."""
    key = [F.col("store_id"), F.col("order_date")]
    heads = cut(orders, "order_date", window).groupBy(*key).agg(F.count_if(~F.col("is_cancelled")).alias("orders_count"), F.count_if(F.col("is_cancelled")).alias("orders_cancelled_count"))
    live = cut(lines, "order_date", window).filter(~F.col("is_cancelled"))  # null (an orphan line) is left out, a gate reports it
    sold = live.groupBy(*key).agg(F.count("*").alias("lines_count"), F.sum("quantity").alias("units_sold"), F.sum("line_amount").alias("revenue_gross"))
    back = _on_both_dates(returns, window)
    grid = cut(spine, "calendar_date", window).withColumnRenamed("calendar_date", "order_date")
    on = ["store_id", "order_date"]
    joined = grid.join(heads.withColumn("has_orders", F.lit(True)), on, "left").withColumn("has_orders", F.col("has_orders").isNotNull())
    joined = joined.join(sold, on, "left").join(back, on, "left")
    gross, returned = _if_any("has_orders", F.col("revenue_gross")).cast(MONEY), _if_any("has_orders", F.col("returns_amount")).cast(MONEY)
    return joined.select(
        *on, "has_orders", "orders_count", "orders_cancelled_count", _if_any("has_orders", F.col("lines_count")).alias("lines_count"), _if_any("has_orders", F.col("units_sold")).alias("units_sold"),
        gross.alias("revenue_gross"), returned.alias("returns_amount"), F.coalesce("arrived", F.lit(0)).cast(MONEY).alias("returns_arrived_amount"), (gross - returned).cast(MONEY).alias("revenue_net"),
    )


def _on_both_dates(returns: DataFrame, window: DateWindow | None) -> DataFrame:
    """Amounts by store and day, read once: by the day of purchase (returns_amount) and by the day they came in (arrived)."""
    if window is not None:
        inside = [F.col(c).between(F.lit(window.low), F.lit(window.high)) for c in ("order_date", "returned_date")]
        returns = returns.filter(inside[0] | inside[1])
    none = F.lit(None).cast("decimal(12,2)")
    sides = F.array(
        F.struct(F.col("order_date").alias("order_date"), F.col("returned_amount").alias("bought"), none.alias("came")),
        F.struct(F.col("returned_date").alias("order_date"), none.alias("bought"), F.col("returned_amount").alias("came")),
    )
    dated = returns.select("store_id", F.explode(sides).alias("x")).select("store_id", "x.*")
    return cut(dated, "order_date", window).groupBy("store_id", "order_date").agg(F.sum("bought").alias("returns_amount"), F.sum("came").alias("arrived"))


def conversion(spine: DataFrame, traffic: DataFrame, orders: DataFrame, window: DateWindow | None = None) -> DataFrame:
    """Store and day: visitors and live offline orders, their ratio where both sides are there and somebody came."""
    on = ["store_id", "traffic_date"]
    grid = cut(spine, "calendar_date", window).withColumnRenamed("calendar_date", "traffic_date")
    dated = cut(orders, "order_date", window).withColumnRenamed("order_date", "traffic_date")
    # one pass: a store-day is here if it has any order, and counts the live offline ones
    sold = dated.groupBy(*on).agg(F.count_if(F.col("is_offline") & ~F.col("is_cancelled")).alias("sold"), F.lit(True).alias("some"))
    seen = cut(traffic, "traffic_date", window).select(*on, "visitors", F.lit(True).alias("counted"))
    joined = grid.join(seen, on, "left").join(sold, on, "left").select(*on, F.col("counted").isNotNull().alias("has_traffic"), F.col("some").isNotNull().alias("has_orders"), "visitors", "sold")
    count = _if_any("has_orders", F.col("sold"))
    ratio = F.when(F.col("has_traffic") & F.col("has_orders"), count.cast("double") / F.nullif(F.col("visitors"), F.lit(0)))
    return joined.select(*on, "has_traffic", "has_orders", "visitors", count.alias("orders_offline"), ratio.alias("conversion"))


def trend(mart: DataFrame, window: DateWindow | None = None) -> DataFrame:
    """Means of the last TREND_ROWS days. With a window, those that a change of its days can have moved, from no more days than they need."""
    if window is None:
        return rolling_full_mean(mart, "store_id", "order_date", "revenue_net", TREND_ROWS)
    read, written = trend_windows(window)
    return written.cut(rolling_full_mean(read.cut(mart, "order_date"), "store_id", "order_date", "revenue_net", TREND_ROWS), "order_date")


def trend_windows(window: DateWindow) -> tuple[DateWindow, DateWindow]:
    """The days to read and the days to write after the window's days changed: a mean reaches TREND_ROWS - 1 days back, so a changed day
    moves as many days after it, and the first of those needs as many before. Days are rows only because the axis is dense."""
    reach = timedelta(days=TREND_ROWS - 1)
    return DateWindow(window.low - reach, window.high + reach), DateWindow(window.low, window.high + reach)


def _flag(df: DataFrame, day: str, check: str, reason: Column, measured: Column, threshold: Column) -> DataFrame:
    return df.select("store_id", F.col(day).alias("flag_date"), F.lit(check).alias("check_name"), reason.alias("reason"), measured.cast("double").alias("measured_value"), threshold.cast("double").alias("threshold_value"))


def flag_conversion(conv: DataFrame) -> DataFrame:
    """More orders than 95 % of visitors; a product, so that a counter that saw nobody is flagged too."""
    bad = conv.filter("has_orders and has_traffic and 100 * orders_offline > 95 * visitors")
    reason = F.format_string("%s orders for %s visitors", "orders_offline", "visitors")
    return _flag(bad, "traffic_date", "conversion_above_threshold", reason, F.col("orders_offline"), F.col("visitors") * 95 / 100)


def flag_late_returns(returns: DataFrame, days: int = REPROCESS_DAYS) -> DataFrame:
    late = returns.filter(F.col("delay_days") > days).groupBy("store_id", "order_date").agg(F.max("delay_days").alias("most"), F.count("*").alias("n"))
    return _flag(late, "order_date", "return_outside_window", F.format_string("%s returns, the latest after %s days", "n", "most"), F.col("most"), F.lit(days))


def flag_missing(conv: DataFrame, column: str, check: str) -> DataFrame:
    return _flag(conv.filter(~F.col(column)), "traffic_date", check, F.lit(check.replace("_", " ")), F.lit(0), F.lit(None))


def quality(conv: DataFrame, returns: DataFrame) -> DataFrame:
    parts = [flag_conversion(conv), flag_late_returns(returns), flag_missing(conv, "has_orders", "orders_partition_missing"), flag_missing(conv, "has_traffic", "traffic_partition_missing")]
    return reduce(DataFrame.unionByName, parts)


def flag_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("check_name").agg(F.count("*").alias("n_flags"), F.min("flag_date").alias("first_day"), F.max("flag_date").alias("last_day"))


def delays(returns: DataFrame) -> DataFrame:
    """How late returns come: exact percentiles (few distinct delays, so the aggregation stays small), maximum and tails."""
    at = {f"p{p}": F.expr(f"percentile(delay_days, {p / 100})") for p in (50, 90, 95, 99)}
    over = {f"share_over_{d}": F.avg((F.col("delay_days") > d).cast("int")) for d in (7, 14)}
    return returns.agg(F.count("*").alias("n_returns"), *[c.alias(k) for k, c in at.items()], F.max("delay_days").alias("longest"), *[c.alias(k) for k, c in over.items()])


def publish_summary(mart: DataFrame, conv: DataFrame, flags: DataFrame, window: DateWindow | date) -> DataFrame:
    """(metric, value): totals of the last day and of the window, and the flags by check.

    Given a run date, the days back are read from the flags: the threshold that late returns were held against, or the library's own where
    nothing is flagged. It is a scalar in the filters on dates, so partitions outside the window are not read, though its size is known only at run time."""
    if isinstance(window, DateWindow):
        last, first = F.lit(window.high), F.lit(window.low)
    else:
        found = flags.filter("check_name = 'return_outside_window'").agg(F.coalesce(F.max("threshold_value"), F.lit(REPROCESS_DAYS)).cast("int").alias("days"))
        last = F.lit(window)
        first = F.date_sub(last, found.scalar())

    def wide(df: DataFrame, column: str) -> DataFrame:
        return df.filter(F.col(column).between(first, last))

    day = mart.filter(F.col("order_date") == last)
    zero = lambda c: F.coalesce(c, F.lit(0))
    columns = {
        "stores_with_orders": F.count_if(F.col("has_orders")), "orders": F.sum("orders_count"), "gross_cents": F.sum(F.col("revenue_gross") * 100), "returns_cents": F.sum(F.col("returns_amount") * 100),
        "net_cents": F.sum(F.col("revenue_net") * 100), "arrived_cents": F.sum(F.col("returns_arrived_amount") * 100),
    }
    one = day.agg(*[zero(c).cast("long").alias(k) for k, c in columns.items()])
    all_days = wide(mart, "order_date").agg(F.countDistinct("order_date").alias("window_days"), zero(F.sum(F.col("revenue_net") * 100)).cast("long").alias("window_net_cents"))
    visitors = conv.filter(F.col("traffic_date") == last).agg(zero(F.sum("visitors")).cast("long").alias("visitors"))
    long = [df.unpivot([], list(df.columns), "metric", "value") for df in (one, all_days, visitors)]
    by_check = wide(flags, "flag_date").groupBy(F.concat(F.lit("flags "), "check_name").alias("metric")).agg(F.count("*").alias("value"))
    return reduce(DataFrame.unionByName, [*long, by_check])


def largest_revisions(log: DataFrame, k: int = 20) -> DataFrame:
    """The k latest revisions, those that lost most first."""
    return log.orderBy(F.desc("revised_at"), F.asc_nulls_last("revenue_net_delta"), "store_id", "order_date").limit(k)
