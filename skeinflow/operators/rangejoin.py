"""Range join over time bins, and an as-of join on it.

Rows that hold over a range are put into every bin that the range touches, between the other side's first and last bin;
points are in one bin. Both sides then meet by equality of (keys, bin), and the range is compared inside a bin. So a key
with a long series spreads over its bins, and what is compared is the points and the ranges of a bin, never a key's whole
product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days, or seconds for timestamps, that a bin spans where the caller doesn't say.
BIN = {"date": 64, "timestamp": 86_400, "timestamp_ntz": 86_400}


def _ordinal(df: DataFrame, name: str) -> tuple[Column, str]:
    """A column on a scale of whole steps, and its type: days of dates, seconds of timestamps, numbers as they are."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if kind == "date":
        return F.unix_date(c).cast("long"), kind
    if kind.startswith("timestamp"):
        return F.floor(c.cast("timestamp").cast("double")).cast("long"), kind
    return F.floor(c).cast("long"), kind


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, low: str, high: str, carry: list[str], how: str = "inner", bin_size: int | None = None) -> DataFrame:
    """``points`` with the columns ``carry`` of every range of its keys with low <= at <= high.

    A null ``high`` is open; a null key, ``at`` or ``low`` meets nothing. ``how`` is inner or left, which keeps points
    without a range. A bin spans ``bin_size`` days, seconds or units; a size that makes most ranges fall into one or two
    bins copies least. A range is copied once for each bin that it touches between the first and last point.
    """
    place, kind = _ordinal(points, at)
    size = bin_size or BIN.get(kind, 64)
    cell = lambda c: F.floor(c / F.lit(size)).cast("long")
    left = points.withColumn("_bin", cell(place))
    span = left.agg(F.min("_bin").alias("_first"), F.max("_bin").alias("_last"))  # one row
    start, end = cell(_ordinal(ranges, low)[0]), cell(_ordinal(ranges, high)[0])
    own = ranges.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(low).alias("_low"), F.col(high).alias("_high"), start.alias("_start"), end.alias("_end"), F.struct(*carry).alias("_carry"))
    own = own.filter("_low IS NOT NULL").crossJoin(F.broadcast(span))
    begin, until = F.greatest("_start", "_first"), F.least(F.coalesce("_end", "_last"), "_last")
    spread = own.filter(begin <= until).withColumn("_cell", F.explode(F.sequence(begin, until)))
    on = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(by)]
    on += [F.col("_bin") == F.col("_cell"), F.col(at) >= F.col("_low"), F.col("_high").isNull() | (F.col(at) <= F.col("_high"))]
    joined = left.join(spread, reduce(lambda a, b: a & b, on), how)
    return joined.select(*points.columns, *[F.col("_carry")[c].alias(c) for c in carry])


def asof_rownumber(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, carry: list[str], bin_size: int | None = None) -> DataFrame:
    """``left`` with the columns ``carry`` and ``right_on`` of the latest right row of its keys that isn't later, null where
    there is none: what ``asof.asof_join`` gives, by a range join and a row number.

    A right row holds until the next one of its keys, whose time still is in its range; of the two that a point on the
    border meets, and of rows with equal times, the first by (right_on, carry) from the greatest on is taken. Left rows
    that are equal in all columns are one until the row number is taken, and then as many as before.
    """
    known = right.filter(F.col(right_on).isNotNull())
    times = known.select(*by, right_on).distinct()
    ahead = times.withColumn("_until", F.lead(right_on).over(Window.partitionBy(*by).orderBy(right_on)))
    ranges = known.join(ahead, [*by, right_on]).select(*by, right_on, "_until", *[c for c in carry if c not in by])
    single = left.groupBy(*left.columns).agg(F.count("*").alias("_copies"))
    found = range_join(single, ranges.withColumnRenamed(right_on, "_at"), by, left_on, "_at", "_until", [*carry, "_at"], "left", bin_size)
    order = [F.col(c).desc_nulls_last() for c in ("_at", *carry)]
    first = F.row_number().over(Window.partitionBy(*left.columns).orderBy(*order))
    rows = found.withColumn("_n", first).filter("_n = 1").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return rows.select(*left.columns, F.col("_at").alias(right_on), *carry)
