"""Walk-forward folds."""

from __future__ import annotations

from dataclasses import astuple, dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "fold_id string, train_start date, train_end date, test_start date, test_end date"


@dataclass(frozen=True)
class Fold:
    fold_id: str
    train_start: date
    train_end: date
    test_start: date
    test_end: date


def walk_forward(start: date, end: date, train_years: int = 3, test_days: int = 63, gap_days: int = 10, least_days: int = 14) -> list[Fold]:
    """Test windows of ``test_days`` after ``train_years`` of 365 days, training ending ``gap_days`` before each.

    A window is inclusive at both ends, so neighbours share a day. If ``least_days`` or more remain after the last whole
    window, they make a partial one.
    """
    found, first = [], start + timedelta(365 * train_years)
    while (left := (end - first).days) >= min(least_days, test_days):
        whole = left >= test_days
        cut = first - timedelta(gap_days)
        last = first + timedelta(test_days) if whole else end
        found.append(Fold(first.isoformat() + ("" if whole else "_partial"), cut - timedelta(365 * train_years), cut, first, last))
        if not whole:
            break
        first = last
    return found


def folds_frame(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame([astuple(f) for f in folds], SCHEMA)


def assign(df: DataFrame, folds: DataFrame, day: str = "trade_date") -> DataFrame:
    """``df`` with the fold in whose test window each row lies; on a shared day the later fold. Rows outside all go.

    Folds are a few dozen dates, so they are broadcast and looked up per row, with no row multiplied.
    """
    rows = folds.select(F.collect_list(F.struct("test_start", "test_end", "fold_id")).alias("folds"))
    fits = F.filter("folds", lambda f: (F.col(day) >= f["test_start"]) & (F.col(day) <= f["test_end"]))
    picked = df.crossJoin(F.broadcast(rows)).withColumn("fold_id", F.array_max(fits)["fold_id"])
    return picked.drop("folds").filter("fold_id IS NOT NULL")
