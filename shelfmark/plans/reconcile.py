"""Full reconciliation: every mart again from the raw layer, by SQL that shares no code with the build, compared value by value.

A check reports how many rows it compared, and one that compared none fails: how many of them differ is then not known (null), not 0. The 29 checks of every warehouse and the two
that need a chain with planted defects (`planted=True`: a day without orders, outliers of both kinds) make the full 31. Money is compared as whole cents, ratios at
nine decimals, the moving average within 1e-6. All checks are one plan with one row each: those that look at the same rows share one aggregate, whose
columns are then turned into rows.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame

from .pipeline import Warehouse


class Check(NamedTuple):
    group: str
    name: str
    compared: int
    different: int | None

    @property
    def passed(self) -> bool:
        return self.compared > 0 and self.different == 0


_VIEWS = {
    "lines_again": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_no ORDER BY line_amount, quantity, unit_price, sku) AS copy FROM raw_order_items) WHERE copy = 1""",
    "sales_again": """
        SELECT o.store_id, o.order_date, count(DISTINCT CASE WHEN o.status <> 'cancelled' THEN o.order_id END) AS orders_count,
               count(DISTINCT CASE WHEN o.status = 'cancelled' THEN o.order_id END) AS orders_cancelled_count,
               coalesce(count(CASE WHEN o.status <> 'cancelled' THEN l.order_id END), 0) AS lines_count,
               coalesce(sum(CASE WHEN o.status <> 'cancelled' THEN l.quantity END), 0) AS units_sold,
               coalesce(sum(CASE WHEN o.status <> 'cancelled' THEN cast(l.line_amount * 100 AS bigint) END), 0) AS gross
        FROM raw_orders o LEFT JOIN lines_again l ON o.order_id = l.order_id GROUP BY o.store_id, o.order_date""",
    "bought_back": "SELECT o.store_id, r.order_date, sum(cast(r.returned_amount * 100 AS bigint)) AS cents FROM raw_returns r JOIN raw_orders o ON r.order_id = o.order_id GROUP BY 1, 2",
    "came_back": "SELECT o.store_id, r.returned_date, sum(cast(r.returned_amount * 100 AS bigint)) AS cents FROM raw_returns r JOIN raw_orders o ON r.order_id = o.order_id GROUP BY 1, 2",
    "offline_again": "SELECT store_id, order_date, count_if(channel = 'offline' AND status <> 'cancelled') AS n FROM raw_orders GROUP BY 1, 2",
    "horizon": "SELECT min(d) AS first_day, max(d) AS last_day FROM (SELECT order_date AS d FROM raw_orders UNION ALL SELECT traffic_date FROM raw_store_traffic)",
}

_SALES = "FROM mart_sales m LEFT JOIN sales_again a ON m.store_id = a.store_id AND m.order_date = a.order_date"
_CONV = "FROM mart_conversion m LEFT JOIN raw_store_traffic t ON m.store_id = t.store_id AND m.traffic_date = t.traffic_date LEFT JOIN offline_again o ON m.store_id = o.store_id AND m.traffic_date = o.order_date"
_TREND = """FROM (SELECT *, count(cents) OVER w AS n, sum(cents) OVER w / 700.0D AS again, row_number() OVER (PARTITION BY store_id ORDER BY order_date) AS place
 FROM (SELECT *, cast(revenue_net * 100 AS bigint) AS cents FROM mart_trend) WINDOW w AS (PARTITION BY store_id ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


def _same(a: str, b: str) -> str:
    return f"{a} IS NOT DISTINCT FROM {b}"


#: (group, name, condition that every row must meet, rows)
_CHECKS = [
    ("grain", "spine days are unique", "n = 1", "FROM (SELECT count(*) AS n FROM spine GROUP BY store_id, calendar_date)"),
    ("grain", "no day before a store opens", "calendar_date >= opened_on", "FROM spine JOIN raw_stores USING (store_id)"),
    ("grain", "spine lies in the horizon", "calendar_date BETWEEN first_day AND last_day", "FROM spine CROSS JOIN horizon"),
    ("grain", "every store has all its days", "n = datediff(last_day, greatest(opened_on, first_day)) + 1", "FROM (SELECT store_id, count(*) AS n FROM spine GROUP BY store_id) JOIN raw_stores USING (store_id) CROSS JOIN horizon"),
    ("grain", "no open store is left out", "s.store_id IS NOT NULL", "FROM (SELECT store_id FROM raw_stores CROSS JOIN horizon WHERE opened_on <= last_day) r LEFT JOIN (SELECT DISTINCT store_id FROM spine) s USING (store_id)"),
    ("grain", "sales has the spine's rows", _same("m.store_id", "s.store_id"), "FROM mart_sales m FULL JOIN spine s ON m.store_id = s.store_id AND m.order_date = s.calendar_date"),
    ("grain", "conversion has the spine's rows", _same("m.store_id", "s.store_id"), "FROM mart_conversion m FULL JOIN spine s ON m.store_id = s.store_id AND m.traffic_date = s.calendar_date"),
    ("sales", "days with orders", "m.has_orders = (a.store_id IS NOT NULL)", _SALES),
    ("sales", "order counts", _same("m.orders_count", "a.orders_count") + " AND " + _same("m.orders_cancelled_count", "a.orders_cancelled_count"), _SALES),
    ("sales", "line counts", _same("m.lines_count", "a.lines_count"), _SALES),
    ("sales", "units", _same("m.units_sold", "a.units_sold"), _SALES),
    ("sales", "gross revenue", _same("cast(m.revenue_gross * 100 AS bigint)", "a.gross"), _SALES),
    ("sales", "net is gross less returns", _same("revenue_net", "revenue_gross - returns_amount"), "FROM mart_sales"),
    ("dedup", "one row a line", "n = 1", "FROM (SELECT count(*) AS n FROM int_order_lines GROUP BY order_id, line_no)"),
    ("dedup", "the same copy stays", _same("cast(i.line_amount AS string)", "cast(l.line_amount AS string)"), "FROM int_order_lines i FULL JOIN lines_again l ON i.order_id = l.order_id AND i.line_no = l.line_no"),
    ("returns", "by day of purchase", "cast(coalesce(m.returns_amount, 0) * 100 AS bigint) = CASE WHEN m.has_orders THEN coalesce(b.cents, 0) ELSE 0 END", "FROM mart_sales m LEFT JOIN bought_back b ON m.store_id = b.store_id AND m.order_date = b.order_date"),
    ("returns", "by day of arrival", "cast(m.returns_arrived_amount * 100 AS bigint) = coalesce(c.cents, 0)", "FROM mart_sales m LEFT JOIN came_back c ON m.store_id = c.store_id AND m.order_date = c.returned_date"),
    ("returns", "none before its order", "returned_date >= order_date", "FROM raw_returns"),
    ("returns", "all of known orders on their date", _same("r.order_date", "o.order_date"), "FROM raw_returns r LEFT JOIN raw_orders o ON r.order_id = o.order_id"),
    ("returns", "none of cancelled orders", "o.status <> 'cancelled'", "FROM raw_returns r JOIN raw_orders o ON r.order_id = o.order_id"),
    ("conversion", "visitors", _same("m.visitors", "t.visitors") + " AND m.has_traffic = (t.store_id IS NOT NULL)", _CONV),
    ("conversion", "live offline orders", _same("m.orders_offline", "o.n"), _CONV),
    ("conversion", "ratio", _same("round(m.conversion, 9)", "round(CASE WHEN t.visitors > 0 THEN o.n / t.visitors END, 9)"), _CONV),
    ("conversion", "nulls have a cause", "m.conversion IS NOT NULL OR NOT m.has_orders OR NOT m.has_traffic OR m.visitors = 0", "FROM mart_conversion m"),
    ("defects", "broken counters are flagged", "f.store_id IS NOT NULL", "FROM (SELECT * FROM mart_conversion WHERE has_orders AND has_traffic AND orders_offline > visitors) m LEFT JOIN flags f ON f.store_id = m.store_id AND f.flag_date = m.traffic_date AND f.check_name = 'conversion_above_threshold'"),
    ("defects", "missing days are flagged", "f.store_id IS NOT NULL", "FROM (SELECT * FROM mart_conversion WHERE NOT has_orders) m LEFT JOIN flags f ON f.store_id = m.store_id AND f.flag_date = m.traffic_date AND f.check_name = 'orders_partition_missing'"),
    ("defects", "missing counters are flagged", "f.store_id IS NOT NULL", "FROM (SELECT * FROM mart_conversion WHERE NOT has_traffic) m LEFT JOIN flags f ON f.store_id = m.store_id AND f.flag_date = m.traffic_date AND f.check_name = 'traffic_partition_missing'"),
    ("trend", "mean of seven days", "abs(coalesce(revenue_net_avg_7d, 0) - CASE WHEN n = 7 THEN again ELSE 0 END) < 1e-6", _TREND),
    ("trend", "no mean without seven numbers", "(revenue_net_avg_7d IS NULL) = (n < 7) AND (place > 6 OR revenue_net_avg_7d IS NULL)", _TREND),
]

_OUTLIERS = "(SELECT 'amount' AS kind, count_if(line_amount < 0) AS n FROM {0} UNION ALL SELECT 'quantity', count_if(quantity = 0) FROM {0})"

#: checks of what only a chain with planted defects must hold
_PLANTED = [
    ("defects", "returns still arrive on days without orders", "arrived > 0", "FROM (SELECT sum(returns_arrived_amount) AS arrived FROM mart_sales GROUP BY order_date HAVING NOT bool_or(has_orders))"),
    ("defects", "outliers are not filtered out", "i.n > 0 AND i.n = l.n", f"FROM {_OUTLIERS.format('int_order_lines')} i LEFT JOIN {_OUTLIERS.format('lines_again')} l ON i.kind = l.kind"),
]


#: What a frame given to reconcile_all may be called in the texts above.
FRAMES = ["raw_stores", "raw_orders", "raw_order_items", "raw_returns", "raw_store_traffic", "int_order_lines", "spine", "mart_sales", "mart_conversion", "mart_trend", "flags"]
_NAMES = re.compile(rf"\b({'|'.join([*FRAMES, *_VIEWS])})\b")


def checks(planted: bool = False) -> list[tuple[str, str, str, str]]:
    return _CHECKS + (_PLANTED if planted else [])


def shared(planted: bool = False) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """(rows, checks over them): checks that look at the same rows stand together."""
    ordered = sorted(checks(planted), key=lambda c: c[3])
    return [(rows, [c[:3] for c in same]) for rows, same in groupby(ordered, key=lambda c: c[3])]


def reconcile_all(frames: dict[str, DataFrame], planted: bool = False) -> DataFrame:
    """(check_group, check_name, compared, different), one row a check, over frames with the names in FRAMES. Nothing is registered in the session."""
    spark, known = frames["spine"].sparkSession, dict(frames)

    def sql(text: str) -> DataFrame:
        used = {name: known[name] for name in set(_NAMES.findall(text))}
        return spark.sql(_NAMES.sub(r"{\1}", text), **used)

    for name, text in _VIEWS.items():
        known[name] = sql(text)
    parts = []
    for rows, same in shared(planted):
        counts = ", ".join(f"CASE WHEN count(*) > 0 THEN count_if(NOT coalesce({condition}, false)) END AS d{i}" for i, (_, _, condition) in enumerate(same))
        found = sql(f"SELECT count(*) AS compared, {counts} {rows}")
        listed = ", ".join(f"'{group}', \"{name}\", compared, d{i}" for i, (group, name, _) in enumerate(same))
        parts.append(found.selectExpr(f"stack({len(same)}, {listed}) AS (check_group, check_name, compared, different)"))
    return reduce(DataFrame.unionByName, parts)


def reconcile(house: Warehouse, planted: bool = False) -> list[Check]:
    """All checks of a warehouse, in the order in which they are declared: one job."""
    view = house.view()
    frames = {f"raw_{n}": house.raw(n) for n in ("stores", "orders", "order_items", "returns", "store_traffic")}
    frames |= {"int_order_lines": view.read("order_lines"), "spine": view.read("spine"), "mart_sales": view.read("sales"), "mart_conversion": view.read("conversion"), "mart_trend": view.read("trend"), "flags": view.read("quality")}
    found = {(r.check_group, r.check_name): Check(*r) for r in reconcile_all(frames, planted).collect()}
    return [found[group, name] for group, name, _, _ in checks(planted)]
