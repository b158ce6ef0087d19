"""Windowed tables that follow their input by recomputing what a change can reach.

A fingerprint of every input row is kept. A refresh compares them with the input as it is now: rows that came, changed or
went can only reach the rows of their key whose windows hold them, so many behind (and, for targets, so many before).
Those rows are recomputed from themselves and the rows that their windows see; everything else stays as it is. Results
and fingerprints are keyed tables, so what is written follows the change as well. Results are written first: a refresh
that dies in between is done again, with the same outcome.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.sources.shared import stage
from skeinflow.streaming.keyed import KeyedTable


class WindowedTable:
    """``make`` (input) kept up to date, where ``make`` gives a row for each input row with the same ``keys`` and ``at``.

    Its windows are partitioned by ``keys`` and ordered by ``at``, and see ``depth`` rows up to a row's own, and ``ahead``
    rows behind it. Rows of the input are told apart by (keys, at), neither of which is null.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], at: str, depth: int, make: Callable[[DataFrame], DataFrame], sample: DataFrame, ahead: int = 0, buckets: int = 64) -> None:
        self.spark, self.keys, self.at, self.depth, self.ahead, self.make = spark, keys, at, depth, ahead, make
        self.place = [*keys, at]
        made, plain = make(sample).schema, sample.schema
        more = [T.StructField("_turn", T.LongType()), T.StructField("_drop", T.BooleanType())]
        self.columns = made.names
        path = path.rstrip("/")
        self.results = KeyedTable(spark, f"{path}/results", T.StructType([*made.fields, *more]), self.place, ["_turn"], deleted="_drop", buckets=buckets)
        self.prints = KeyedTable(spark, f"{path}/prints", T.StructType([*[plain[c] for c in self.place], T.StructField("h", T.LongType()), *more]), self.place, ["_turn"], deleted="_drop", buckets=buckets)

    def _same(self, left: str, right: str, names: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}") == F.col(f"{right}.{c}") for c in names])

    def current(self) -> DataFrame:
        return self.results.current().select(*self.columns)

    def refresh(self, rows: DataFrame) -> dict[str, int]:
        """Brings the table up to ``rows``; tells how many input rows changed, and how many were read to make how many."""
        turn = 1 + max(t.table.state().batches.get("refresh", -1) for t in (self.results, self.prints))
        now = rows.select(*self.place, F.xxhash64(*rows.columns).alias("h")).alias("n")
        old = self.prints.current().select(*self.place, F.col("h").alias("was")).alias("o")
        both = now.join(old, self._same("n", "o", self.place), "full_outer")
        differ = both.filter(~F.col("h").eqNullSafe(F.col("was")))
        changes = stage(differ.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in self.place], "h", F.col("h").isNull().alias("gone")), "refresh-changes")
        n = changes.count()
        if not n:
            return {"changed": 0, "read": 0, "made": 0}
        # the rows of changed keys with what changed among them, those that went included
        touched = changes.select(*self.keys).distinct().alias("t")
        own = rows.alias("r").join(touched, self._same("r", "t", self.keys), "left_semi")
        marked = own.alias("r").join(changes.filter("NOT gone").select(*self.place, F.lit(True).alias("_new")).alias("c"), self._same("r", "c", self.place), "left").select("r.*", F.coalesce("_new", F.lit(False)).alias("_new"), F.lit(False).alias("_gone"))
        lost = changes.filter("gone").select(*self.place, F.lit(True).alias("_new"), F.lit(True).alias("_gone"))
        order = Window.partitionBy(*self.keys).orderBy(self.at)
        near = F.coalesce(F.lag("_gone").over(order), F.lit(False))
        if self.ahead:
            near = near | F.coalesce(F.lead("_gone").over(order), F.lit(False))
        there = marked.unionByName(lost, allowMissingColumns=True).withColumn("_new", F.col("_new") | near).filter("NOT _gone")
        reach = order.rowsBetween(1 - self.depth, self.ahead)
        sight = order.rowsBetween(-self.ahead, self.depth - 1)
        there = there.withColumn("_make", F.max("_new").over(reach)).withColumn("_read", F.max("_make").over(sight)).filter("_read")
        seen = stage(there.select(*rows.columns, "_make"), "refresh-rows")
        wanted = seen.filter("_make").select(*self.place).alias("w")
        made = self.make(seen.select(*rows.columns)).alias("m").join(wanted, self._same("m", "w", self.place), "left_semi")
        mark = {"_turn": F.lit(turn).cast("long"), "_drop": F.lit(False)}
        dropped = changes.filter("gone").select(*self.place).withColumns(mark | {"_drop": F.lit(True)})
        self.results.apply(made.withColumns(mark).unionByName(dropped, allowMissingColumns=True), turn, "refresh")
        self.prints.apply(changes.select(*self.place, "h", mark["_turn"].alias("_turn"), F.col("gone").alias("_drop")), turn, "refresh")
        counts = seen.agg(F.count("*").alias("n"), F.count_if("_make").alias("m")).first()
        return {"changed": n, "read": counts.n, "made": counts.m}
