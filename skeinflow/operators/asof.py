"""As-of join: for each left row the latest right row of its key that is not later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, carry: list[str]) -> DataFrame:
    mine = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    theirs = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(right_on), *carry).alias("_right"))
    return mine.unionByName(theirs.filter(F.col("_at").isNotNull()), allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, carry: list[str], bucket: Column | None = None) -> DataFrame:
    """``left`` with the columns ``carry`` and ``right_on`` of its match, null where there is none.

    Both sides are put in one order of (key, time), right rows before left rows of the same time, and the last right row
    is carried along: one exchange and one sort, never a product of the sides. Of right rows with the same key and time
    the greatest in ``right_on``, ``carry`` order is taken; a null key or time matches nothing. With ``bucket``, an
    expression of ``_at`` that grows with it, a key's rows are split by it: each bucket starts from the latest right row
    of the buckets before, so one long series spreads over many tasks.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = _both(left, right, by, left_on, right_on, carry)
    present = F.lit(True)
    for k in keys:
        present &= F.col(k).isNotNull()
    # several null keys would otherwise meet each other
    right_row = F.when(present & F.col("_at").isNotNull(), F.col("_right"))
    order = [F.col("_at"), F.col("_side"), F.col("_right").asc_nulls_first()]
    if bucket is None:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = rows.withColumn("_match", F.last(right_row, ignorenulls=True).over(window))
    else:
        rows = rows.withColumn("_b", bucket)
        latest = rows.filter("_right IS NOT NULL").groupBy(*keys, "_b").agg(F.max("_right").alias("_last"))
        cells = rows.select(*keys, "_b").distinct().join(latest, [*keys, "_b"], "left")
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        start = cells.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_start"))
        same = None
        for c in [*keys, "_b"]:
            term = F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
            same = term if same is None else same & term
        joined = rows.alias("x").join(start.alias("y"), same, "left").select("x.*", "y._start")
        window = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = joined.withColumn("_match", F.coalesce(F.last(right_row, ignorenulls=True).over(window), F.when(present, F.col("_start"))))
    matched = F.when(present & F.col("_at").isNotNull(), F.col("_match"))
    return found.filter("_side = 1").select("_left.*", *[matched[c].alias(c) for c in [right_on, *carry]])
