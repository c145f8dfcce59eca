"""Versioned rows: a new version whenever a checked column changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_snapshot(current: DataFrame, keys: list[str], as_of: datetime) -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz")
    return current.select(*current.columns, _version_id(keys, at), at.alias("updated_at"), at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))


def _version_id(keys: list[str], at):
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], at.cast("string"))).alias("scd_id")


def snapshot(old: DataFrame, current: DataFrame, keys: list[str], checked: list[str], as_of: datetime) -> DataFrame:
    """old with the open versions closed at as_of whose checked columns changed, and the new versions.

    as_of is an argument, never the clock: the same call twice gives the same rows. Keys that are gone stay open.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    values = lambda prefix="": F.struct(*[F.col(prefix + c).alias(c) for c in checked])
    here = current.select(*[F.col(c).alias(f"new_{c}") for c in current.columns])
    on = [F.col(k) == F.col(f"new_{k}") for k in keys] + [F.col("valid_to").isNull()]
    both = old.withColumn("_old", F.lit(True)).join(here.withColumn("_new", F.lit(True)), on, "full_outer")
    changed = F.col("_old").isNull() | (F.col("_new").isNotNull() & ~values().eqNullSafe(values("new_")))
    # each pair gives the old version, closed if it changed, and the new one if it did: one join, no union
    kept = F.struct(*[(F.when(changed & F.col("_new").isNotNull(), at).otherwise(F.col(c)) if c == "valid_to" else F.col(c)).alias(c) for c in old.columns])
    made = {"scd_id": _version_id([f"new_{k}" for k in keys], at), "updated_at": at, "valid_from": at, "valid_to": F.lit(None).cast("timestamp_ntz")}
    fresh = F.struct(*[(made[c] if c in made else F.col(f"new_{c}")).cast(old.schema[c].dataType).alias(c) for c in old.columns])
    rows = F.array_compact(F.array(F.when(F.col("_old"), kept), F.when(changed, fresh)))
    return both.select(F.explode(rows).alias("_row")).select("_row.*")


def revisions(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Every version but the first of a key: what was published before, what since, and why it moved."""
    w = W.partitionBy(*keys).orderBy("valid_from")
    moved = ["orders_count", "revenue_gross", "returns_amount", "revenue_net"]
    seen = versions.select(*keys, "valid_from", *moved, F.row_number().over(w).alias("version_no"), *[F.lag(c).over(w).alias(f"{c}_was") for c in moved])
    same = {c: F.col(c).eqNullSafe(F.col(f"{c}_was")) for c in moved}
    reason = (
        F.when(~same["returns_amount"] & same["revenue_gross"], "late return")
        .when(~same["revenue_gross"], "raw layer rebuilt")
        .when(~same["orders_count"], "order mix changed")
        .otherwise("other")
    )
    return seen.filter("version_no > 1").select(
        *keys, F.col("valid_from").alias("revised_at"), F.col("version_no").cast("long").alias("version_no"), "revenue_net_was", F.col("revenue_net").alias("revenue_net_became"), (F.col("revenue_net") - F.col("revenue_net_was")).alias("revenue_net_delta"),
        "returns_amount_was", F.col("returns_amount").alias("returns_amount_became"), reason.alias("reason"),
    )
