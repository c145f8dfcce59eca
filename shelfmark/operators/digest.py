"""Content digests that don't depend on row order: one for a whole table, and a tree by day and month that tells where two tables differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(columns: list[str]) -> Column:
    """MD5 of the values as text, separated; null and the empty string differ."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]))


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: row count and digest. The four 32-bit parts of the row digests are summed, so that rows combine in any order, map-side
    first, in constant space; equal rows count each."""
    rows = df.select(row_digest(columns or df.columns).alias("h"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string") for at in (1, 9, 17, 25)]
    return rows.agg(F.count("*").alias("n_rows"), F.md5(F.concat_ws("|", *sums)).alias("digest"))


#: Leading hexadecimal digits of a row's digest that part the rows of a day; the digests follow from it, so it is fixed for a comparison.
SLOT_DIGITS = 2


def _listed(values: str, order: str) -> Column:
    return F.md5(F.expr(f"listagg({values}, '') WITHIN GROUP (ORDER BY {order})"))


def day_digests(df: DataFrame, day: str, columns: list[str] | None = None, slot_digits: int = SLOT_DIGITS) -> DataFrame:
    """(day, n_rows, digest), the leaves of the tree: rows' digests are listed in order and digested again.

    A day's rows are listed in slots by the first digits of their digests, and the slots' digests in order of the slots, so that no
    list grows with a day beyond the rows of one slot; sixteen times as many slots come with each digit more. Rows without a day have a null one."""
    rows = df.select(F.col(day).cast("date").alias("day"), row_digest(columns or df.columns).alias("h"))
    slots = rows.groupBy("day", F.substring("h", 1, slot_digits).alias("slot")).agg(F.count("*").alias("n"), _listed("h", "h").alias("d"))
    return slots.groupBy("day").agg(F.sum("n").alias("n_rows"), _listed("d", "slot").alias("digest"))


def digest_tree(days: DataFrame) -> DataFrame:
    """(level, key, n_rows, digest) of the table, its months and its days, from day_digests. Days and months are few; keys are texts, `none` without a day."""
    shown = days.select(F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("none")).alias("key"), "n_rows", "digest")
    months = shown.groupBy(F.substring("key", 1, 7).alias("month")).agg(F.sum("n_rows").alias("n_rows"), _listed("digest", "key").alias("digest")).withColumnRenamed("month", "key")
    whole = months.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(_listed("digest", "key"), F.md5(F.lit(""))).alias("digest")).select(F.lit("all").alias("key"), "n_rows", "digest")
    levels = [df.select(F.lit(level).alias("level"), "key", "n_rows", "digest") for level, df in (("table", whole), ("month", months), ("day", shown))]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def differing_days(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, n_rows_a, n_rows_b) of the days on which two trees differ, looked for only in months that differ; null where a side has no such day."""
    left, right = (t.select("level", "key", F.col("n_rows").alias(f"n_rows_{s}"), F.col("digest").alias(f"digest_{s}")) for t, s in ((a, "a"), (b, "b")))
    odd = left.join(right, ["level", "key"], "full_outer").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    months = odd.filter("level = 'month'").select(F.col("key").alias("month"))
    return odd.filter("level = 'day'").join(months, F.substring("key", 1, 7) == F.col("month"), "left_semi").select("key", "n_rows_a", "n_rows_b")
