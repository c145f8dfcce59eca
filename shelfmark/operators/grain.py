"""Grain: one row a key, dense calendars, full windows, key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that a task sorts or groups at most, where keys are spread evenly.
ROWS_A_TASK = 500_000


def dedup_by_grain(df: DataFrame, keys: list[str], order: list[str], copies: str = "source_copies") -> DataFrame:
    """One row a key: the smallest under `order`, then under the other columns; `copies` counts the rows of the key.

    The smallest struct of a group is found with map-side combining, with no sort of the input; the copy that stays
    does not depend on the input's order. It is not claimed to be the right one.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"), F.count("*").alias(copies))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns], copies)


def parts_for(rows: int, rows_a_part: int, least: int = 8) -> int:
    """A power of two, so that tables of different sizes stay multiples of one another."""
    n = least
    while n * rows_a_part < rows:
        n *= 2
    return n


def spread_parts(spark: SparkSession, rows: int) -> int:
    """Parts of a table of so many rows; of a large one no fewer than the session's, to which Spark would deal it again."""
    n = parts_for(rows, ROWS_A_TASK)
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if rows > 8 * ROWS_A_TASK else n


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by keys in parts that grow with `rows`, so that what a task holds does not; a small table is left to Spark.

    Tables spread by the same number of rows meet in a join on these keys, and are grouped by them, without another shuffle."""
    return df.repartition(spread_parts(df.sparkSession, rows), *keys) if rows > 8 * ROWS_A_TASK else df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows have, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows_per_key")).filter("rows_per_key > 1")


def bounds(*dated: tuple[DataFrame, str]) -> DataFrame:
    """One row: first_day and last_day over several (table, date column)."""
    spans = [df.agg(F.min(c).alias("a"), F.max(c).alias("b")) for df, c in dated]
    both = spans[0]
    for more in spans[1:]:
        both = both.unionByName(more)
    return both.agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"))


def dense_spine(stores: DataFrame, horizon: DataFrame) -> DataFrame:
    """(store_id, calendar_date): every day of the horizon from a store's opening on; none for a store that opens after it.

    Days come from a sequence in each store's row, so no range join is needed.
    """
    dated = stores.select("store_id", "opened_on").crossJoin(F.broadcast(horizon)).filter("opened_on <= last_day")  # horizon is one row
    days = F.sequence(F.greatest("opened_on", "first_day"), F.col("last_day"), F.expr("interval 1 day"))
    return dated.select("store_id", F.explode(days).alias("calendar_date"))


def rolling_full_mean(df: DataFrame, key: str, day: str, value: str, rows: int = 7, cents: int = 100) -> DataFrame:
    """value's mean over the last `rows` rows of the key, null unless all of them are there and not null.

    Rows stand for days only because the axis is dense. The mean is of whole cents, so it is equal on every engine.
    """
    w = W.partitionBy(key).orderBy(day).rowsBetween(1 - rows, 0)
    total = F.sum((F.col(value) * cents).cast("long")).over(w)
    return df.select(key, day, value, F.when(F.count(value).over(w) == rows, total.cast("double") / rows / cents).alias(f"{value}_avg_{rows}d"))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: the keys for which any value differs, null being equal to null only."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(v).alias(f"{v}_b") for v in values])
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b"))
    joined = left.join(right, on, "full_outer").filter(differs)
    return joined.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], *[f"{v}_{s}" for v in values for s in "ab"])
