"""Date windows: what one run rebuilds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days that a run rebuilds before its own, and days that the comparison with the raw layer looks back.
REPROCESS_DAYS, COMPARE_DAYS = 28, 30


@dataclass(frozen=True)
class DateWindow:
    """Both ends included."""

    low: date
    high: date

    @classmethod
    def ending(cls, run_date: date, days_back: int = REPROCESS_DAYS) -> DateWindow:
        return cls(run_date - timedelta(days=days_back), run_date)

    def cut(self, df: DataFrame, column: str) -> DataFrame:
        return df.filter(F.col(column).between(F.lit(self.low), F.lit(self.high)))

    def days(self) -> list[date]:
        return [self.low + timedelta(days=i) for i in range((self.high - self.low).days + 1)]


def cut(df: DataFrame, column: str, window: DateWindow | None) -> DataFrame:
    """df within the window; all of it for a full build."""
    return df if window is None else window.cut(df, column)
