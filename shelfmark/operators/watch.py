"""Counting bad rows of a table while something else is done with it."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Watch:
    """Conditions by name; `on` lets a table's rows pass and counts those that meet each, `counts` tells them once an action is done."""

    def __init__(self, conditions: dict[str, Column] | None):
        self.conditions, self.seen = conditions or {}, Observation()

    def on(self, df: DataFrame) -> DataFrame:
        if not self.conditions:
            return df
        return df.observe(self.seen, *[F.count_if(c).alias(f"m{i}") for i, c in enumerate(self.conditions.values())])

    def counts(self) -> dict[str, int]:
        if not self.conditions:
            return {}
        try:
            found = self.seen.get
        except Py4JJavaError:  # a table that planning finds empty is never run, so it leaves no numbers
            found = {}
        return {name: found.get(f"m{i}", 0) for i, name in enumerate(self.conditions)}
