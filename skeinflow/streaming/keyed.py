"""The current row of each key (SCD type 1) under streams of changes.

Rows lie in buckets by their key. A batch of changes is cut down to the last change of each key and written as a delta of
the buckets that it touches, so what is written follows the batch and not the table. Deletes are rows too, and stay, so
that a change which comes later but is older can't bring a key back. A change with a greater sequence wins, of equal ones
that of the later batch: merging is a maximum, so any order and any repetition of batches ends in the same table. A
bucket whose deltas have grown to a share of its base is merged into a new base, so each row is rewritten a bounded
number of times while its bucket doubles. All of it is committed through ``VersionedTable``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.operators.upsert import last_wins
from skeinflow.sources.versions import Conflict, Part, State, VersionedTable

#: A bucket is merged when its deltas have this share of its base's rows, and this many rows at least, or this many parts.
SHARE, LEAST, MOST_PARTS = 0.5, 10_000, 32
#: Changed keys that are broadcast to the base; beyond it both meet by shuffle.
BROADCAST_KEYS = 200_000


class KeyedTable:
    """``schema``'s columns with one row for each value of ``keys``; ``sequence`` orders a key's changes.

    ``deleted`` is a condition on a change that takes its key out. Null keys are a key like any other; of changes in one
    batch with equal sequences the greatest in order of the columns wins.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], sequence: list[str], deleted: Column | str | None = None, buckets: int = 64) -> None:
        own = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.spark, self.keys, self.sequence, self.buckets, self.columns = spark, keys, sequence, buckets, own.names
        self.deleted = F.lit(False) if deleted is None else F.coalesce(F.expr(deleted) if isinstance(deleted, str) else deleted, F.lit(False))
        stored = T.StructType([*own.fields, T.StructField("_batch", T.LongType()), T.StructField("_gone", T.BooleanType()), T.StructField("_bucket", T.IntegerType())])
        self.table = VersionedTable(spark, path, stored, by="_bucket")

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in self.keys and c not in self.sequence]
        return last_wins(rows, [*self.keys, "_bucket"], [*self.sequence, "_batch", "_gone", *rest])

    def apply(self, changes: DataFrame, batch: int, writer: str = "stream") -> State:
        """Merges a batch; one that ``writer`` has committed before changes nothing."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = changes.withColumns({"_batch": F.lit(batch).cast("long"), "_gone": self.deleted, "_bucket": bucket})
        rows = self._last(rows.select(*self.columns, "_batch", "_gone", "_bucket"))
        state = self.table.append(rows.repartition("_bucket"), batch=(writer, batch), kind="delta")
        return self.merge(state)

    def follow(self, stream: DataFrame, checkpoint: str, writer: str = "stream") -> None:
        """Applies what a stream has, batch by batch, and stops."""
        stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n, writer) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def due(self, state: State) -> set[str]:
        """Slices whose deltas have grown enough to be merged."""
        sizes: dict[str, list[int]] = {}
        for p in state.parts:
            size = sizes.setdefault(p.slice, [0, 0, 0])
            size[p.tags["kind"] == "base"] += p.rows
            size[2] += p.tags["kind"] == "delta"
        return {s for s, (delta, base, parts) in sizes.items() if delta > max(LEAST, SHARE * base) or parts > MOST_PARTS}

    def merge(self, state: State | None = None, slices: set[str] | None = None) -> State:
        """Writes new bases for the buckets that are due, or for ``slices``; batches may come in meanwhile."""
        state = state or self.table.state()
        wanted = self.due(state) if slices is None else slices
        old = {p.path for p in state.parts if p.slice in wanted}
        if not old:
            return state
        rows = self._last(self.table.scan(p for p in state.parts if p.path in old))
        add = self.table.write(rows.repartition("_bucket"), kind="base")
        try:
            # another merge of these buckets would have taken the old parts out; appended deltas stay as they are
            return self.table.commit(state, add, lambda p: p.path in old, lambda s: not old <= {p.path for p in s.parts}, "merge")
        except Conflict:
            return self.table.state()

    def current(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """One row for each key that isn't deleted. With ``keys`` (distinct rows of the key columns, few) only theirs, from
        their buckets alone."""
        state = self.table.state(version)
        parts: list[Part] = list(state.parts)
        if keys is not None:
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            wanted = {f"_bucket={r[0]}" for r in keys.select(bucket).distinct().collect()}
            parts = [p for p in parts if p.slice in wanted]
        base, deltas = (self.table.scan(p for p in parts if p.tags["kind"] == kind) for kind in ("base", "delta"))
        few = sum(p.rows for p in parts if p.tags["kind"] == "delta") <= BROADCAST_KEYS
        on = lambda left, right: _same(left, right, [*self.keys, "_bucket"])
        if any(p.tags["kind"] == "base" for p in parts):
            changed = deltas.select(*[F.col(c).alias(f"x{c}") for c in (*self.keys, "_bucket")])
            changed = F.broadcast(changed) if few else changed.distinct()
            untouched = base.join(changed, on(base, changed), "left_anti")
            touched = base.join(changed, on(base, changed), "left_semi")
            rows = untouched.unionByName(self._last(touched.unionByName(deltas)))
        else:
            rows = self._last(deltas)
        if keys is not None:
            asked = keys.select(*[F.col(c).alias(f"x{c}") for c in self.keys])
            rows = rows.join(F.broadcast(asked), _same(rows, asked, self.keys), "left_semi")
        return rows.filter(~F.col("_gone")).select(*self.columns)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out &= left[c].eqNullSafe(right[f"x{c}"])
    return out
