"""An inverted file of vectors for exact nearest neighbours by cosine.

Vectors are put into the list of their nearest centroid, with their distance to it; rows lie in order of (list,
distance), packed. Distances are those of unit vectors, whose square is 2 - 2 cos, so the triangle inequality holds: a
row at d from a centroid is at least |d - e| away from a query at e from it. A search reads the lists nearest to a query
first; the k-th similarity found there is a radius, and of all other lists only rows between e - radius and e + radius
can be among the k nearest. That is a range of each list, which is told to the scan as a filter, and compared exactly.
Nothing is left out that could count, so results equal a scan's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.operators.vectors import CELLS, DIGITS, QUERIES, _fits, known_rows, pack_vector
from skeinflow.session import small_batches
from skeinflow.sources.shared import remove, stage, stage_path

#: Vectors that centroids are fitted to, at most, and bytes of them, since they pass the driver; all vectors are put into
#: lists.
SAMPLE, FIT_BYTES = 50_000, 64 << 20
#: Distances between queries and centroids that the driver holds at once; more queries are asked in more blocks.
HELD_CELLS = 1 << 22
#: Lists at most, and rounds of their fitting.
LISTS, ROUNDS = 4096, 8
#: Lists that are read for a query before its radius is known.
FIRST = 2
#: The list of vectors without a direction, which are always compared.
NOWHERE = -1
#: Vectors that the driver of a kept index holds, and up to how many times as many rows in the index it does.
HELD, HELD_SHARE = 2048, 50
#: What rounding may add to a distance.
SLACK = 1e-7


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _nearest_centroid(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, distance) of unit vectors."""
    where, far = np.full(len(rows), NOWHERE, np.int32), np.zeros(len(rows))
    step = max(1, CELLS // max(1, len(centroids)))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        own = (part @ centroids.T).argmax(axis=1)
        where[at : at + step] = own
        far[at : at + step] = np.linalg.norm(part - centroids[own], axis=1)
    nowhere = ~rows.any(axis=1)
    where[nowhere], far[nowhere] = NOWHERE, 0.0
    return where, far


def fit_centroids(rows: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors: evenly spaced rows in order of a fixed direction, moved to their lists' means."""
    rows = rows[rows.any(axis=1)]
    if not len(rows):
        return np.zeros((0, rows.shape[1]))
    order = np.argsort(rows @ np.cos(np.arange(1, rows.shape[1] + 1)), kind="stable")
    centroids = rows[order[np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int)]]
    for _ in range(rounds):
        where, _ = _nearest_centroid(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, where, rows)
        moved = _unit(sums)
        centroids = np.where(moved.any(axis=1, keepdims=True), moved, centroids)
    return centroids


def _matrix(packed: pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long packed vectors."""
    n = len(packed)
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + n + 1]
    return np.frombuffer(packed.buffers()[2], kind)[offsets[0] // int(kind[-1]) : offsets[-1] // int(kind[-1])].reshape(n, -1).astype(np.float64)


def _listed(shared, kind: str, rest: list[str]):
    """(item_id, vector, others) to (list, dist, item_id, packed, others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for whole in batches:
            batch = known_rows(whole, 1)
            if not batch.num_rows:
                continue
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
            where, far = _nearest_centroid(_unit(raw.astype(np.float64)), centroids)
            size = raw.shape[1] * raw.itemsize
            body = raw.tobytes()
            packed = pa.array([body[i * size : (i + 1) * size] for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(far), batch.column(0), packed, *[batch.column(c) for c in rest]], names=["list", "dist", "item_id", "packed", *rest])

    return run


class _Here:
    """A value that travels with a task, where a broadcast would."""

    def __init__(self, value) -> None:
        self.value = value


@dataclass
class _Asked:
    """Queries of one search: identifiers, unit vectors, their filters, distances to centroids, and what they look at."""

    ids: list
    units: np.ndarray
    rules: dict
    far: np.ndarray  # (queries, lists)
    first: np.ndarray  # (queries, lists): read before the radius is known
    radius: np.ndarray | None = None  # None: the first lists; else all others within it

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """(queries, lists) of the least and greatest distance to be compared; empty ranges are reversed."""
        if self.radius is None:
            return np.where(self.first, -np.inf, np.inf), np.where(self.first, np.inf, -np.inf)
        # lists that were read before are left out
        low, high = self.far - self.radius[:, None] - SLACK, self.far + self.radius[:, None] + SLACK
        return np.where(self.first, np.inf, low), np.where(self.first, -np.inf, high)


    def reach(self, least: np.ndarray) -> np.ndarray:
        """How far away a row as similar as ``least`` can be; a query without a direction sees all."""
        return np.where(self.units.any(axis=1), np.sqrt(np.maximum(0.0, 2 - 2 * least + 4 * 10.0**-DIGITS)), np.inf)


def _compared(shared, k: int, kind: str):
    """Rows (list, dist, item_id, packed, filters) to each query's k nearest of a task; a row without a query tells how many
    similarities were taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        low, high = asked.ranges()
        best: list[list[tuple]] = [[] for _ in asked.ids]
        count, item = 0, None
        for batch in batches:
            item = batch.schema.field(2).type
            lists, dist = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(lists):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part, own, place = batch.slice(a, b - a), dist[a:b], lists[a]
                if place == NOWHERE:
                    wanted = np.arange(len(asked.ids)) if asked.radius is not None else np.zeros(0, int)
                else:
                    wanted = np.flatnonzero((low[:, place] <= own.max()) & (high[:, place] >= own.min()))
                if not len(wanted):
                    continue
                rows = _matrix(part.column(3), kind)
                lengths = np.linalg.norm(rows, axis=1)
                fits = _fits(asked.rules, part)
                step = max(1, CELLS // len(rows))
                names = part.column(2).to_pylist()
                for at in range(0, len(wanted), step):
                    some = wanted[at : at + step]
                    sims = np.round(asked.units[some] @ rows.T / np.where(lengths > 0, lengths, 1), DIGITS) + 0.0
                    usable = np.ones(sims.shape, bool) if place == NOWHERE else (own >= low[some, place][:, None]) & (own <= high[some, place][:, None])
                    count += int(usable.sum())
                    if fits is not None:
                        usable &= fits[some]
                    sims[~usable] = -np.inf
                    for q, row in zip(some.tolist(), sims, strict=True):
                        least = best[q][-1][0] if len(best[q]) == k else np.inf
                        found = np.flatnonzero((row > -np.inf) & (-row <= least))
                        if len(found) > k:
                            floor = np.partition(row[found], len(found) - k)[len(found) - k]
                            found = found[row[found] >= floor]
                        if len(found):
                            best[q] = sorted(best[q] + [(-row[i], names[i]) for i in found])[:k]
        rows = [(asked.ids[q], name, -minus) for q, near in enumerate(best) for minus, name in near] + [(None, None, float(count))]
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], item or pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "item_id", "similarity"])

    return run


def _fitted(rows: DataFrame, n: int, sample: int, lists: int) -> np.ndarray:
    """Centroids of a sample of ``n`` rows (item_id, v); rows of the least hash, packed, pass the driver."""
    first = rows.filter("v IS NOT NULL").select(F.size("v").alias("dims")).first()
    if first is None:
        return np.eye(1, 1)
    most = max(1, min(sample, FIT_BYTES // (8 * max(1, first.dims))))
    # the share leaves a margin, since a hash deals about evenly; the limit holds for identifiers that repeat
    place, slots = F.pmod(F.xxhash64("item_id"), F.lit(1_000_000)), math.ceil(0.9 * most / max(1, n) * 1_000_000)
    some = (rows if n <= most else rows.filter(place < slots)).select(pack_vector(F.transform("v", lambda x: x.cast("float"))).alias("v"))
    found = [r.v for r in some.limit(most).collect() if r.v is not None]
    if not found:
        return np.eye(1, first.dims)
    centroids = fit_centroids(_unit(np.frombuffer(b"".join(found), "<f4").reshape(len(found), -1).astype(np.float64)), lists)
    return centroids if len(centroids) else np.eye(1, first.dims)


class VectorIndex:
    """An index folder: ``rows`` in order of (list, dist) and ``lists`` (centroid, least and greatest distance, rows)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        found = spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()  # LISTS rows at most
        self.centroids = np.array([r.centroid for r in found if r.list != NOWHERE], np.float64)
        self.edges = {r.list: (r.least, r.most, r.n) for r in found}
        self.n = sum(r.n for r in found)
        self.rows = spark.read.parquet(f"{self.path}/rows")
        self.kind = spark.read.parquet(f"{self.path}/kind").first().kind
        self.item = self.rows.schema["item_id"].dataType
        self.kept, self.held = False, None

    @staticmethod
    def build(corpus: DataFrame, path: str, id_col: str, vector: str, filters: list[str] | None = None, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Writes an index of ``corpus`` (vectors of one length; null ones match nothing and are left out) and opens it.

        ``filters`` are columns that searches can filter by. There are about as many lists as the root of the rows, LISTS
        at most. Centroids are fitted to about ``sample`` rows and FIT_BYTES of them at most, those of the least hash; every
        row is in the index. Vectors are computed once, but for the sample's.
        """
        spark, filters = corpus.sparkSession, filters or []
        small_batches(spark)
        rows = corpus.select(F.col(id_col).alias("item_id"), F.col(vector).alias("v"), *filters)
        kind = "<f4" if rows.schema["v"].dataType.elementType == T.FloatType() else "<f8"
        n = rows.select("item_id").count()  # with null vectors
        centroids = _fitted(rows, n, sample, lists or max(1, min(LISTS, round(math.sqrt(n)))))
        shared = spark.sparkContext.broadcast(centroids)
        item = rows.schema["item_id"]
        schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("item_id", item.dataType), T.StructField("packed", T.BinaryType()), *[rows.schema[c] for c in filters]])
        # the ranges are found in a pass of their own, which reads what is placed and doesn't place it again
        placed = stage_path(spark, "index-placed")
        rows.mapInArrow(_listed(shared, kind, filters), schema).write.parquet(placed)
        spark.read.schema(schema).parquet(placed).repartitionByRange("list", "dist").sortWithinPartitions("list", "dist").write.parquet(f"{path}/rows")
        remove(spark, placed)
        edges = spark.read.parquet(f"{path}/rows").groupBy("list").agg(F.min("dist").alias("least"), F.max("dist").alias("most"), F.count("*").alias("n"))
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)] + [(NOWHERE, [])], "list int, centroid array<double>")
        known.join(edges, "list", "left").na.fill({"n": 0}).coalesce(1).write.parquet(f"{path}/lists")
        spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.parquet(f"{path}/kind")
        return VectorIndex(spark, path)

    def keep(self) -> VectorIndex:
        """Keeps the rows in the executors' memory and disks until ``release``, and HELD of them with the driver where they are
        a fair share of all: they give a question its radius without a pass of its own."""
        self.rows = self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.rows.count()
        self.kept = True
        if self.n <= HELD * HELD_SHARE:
            some = self.rows.select("packed", F.xxhash64("item_id").alias("h")).orderBy("h").limit(HELD).collect()
            self.held = _unit(np.stack([np.frombuffer(r.packed, self.kind).astype(np.float64) for r in some])) if some else None
        return self

    def release(self) -> None:
        self.rows.unpersist()
        self.kept, self.held = False, None

    def _asked(self, ids: list, vectors: np.ndarray, rules: dict) -> _Asked:
        units = _unit(vectors.reshape(len(ids), -1))
        far = np.sqrt(np.maximum(0.0, 2 - 2 * units @ self.centroids.T))
        order = np.argsort(far, axis=1, kind="stable")
        held = np.array([self.edges[i][2] > 0 for i in range(len(self.centroids))])
        first = np.zeros(far.shape, bool)
        for q in range(len(ids)):
            first[q, [c for c in order[q] if held[c]][:FIRST]] = True
        return _Asked(ids, units, rules, far, first)

    def _within(self, asked: _Asked, where: Column | None) -> DataFrame | None:
        """The rows that some query has to be compared with; None if there are none."""
        low, high = asked.ranges()
        low, high = low.min(axis=0), high.max(axis=0)
        used = [i for i in range(len(low)) if self.edges[i][2] and low[i] <= self.edges[i][1] and high[i] >= self.edges[i][0]]
        nowhere = asked.radius is not None and self.edges[NOWHERE][2] > 0
        if not used and not nowhere:
            return None
        rows = self.rows.filter(where) if where is not None else self.rows
        every = [*used, NOWHERE] if nowhere else used
        if sum(self.edges[i][2] for i in every) < self.n and not self.kept:
            rows = rows.filter(F.expr(f"list IN ({', '.join(map(str, every))})"))
        # texts of expressions, since each number would be a call of its own otherwise
        bound = lambda x: "array(" + ", ".join(f"{v!r}D" for v in np.clip(x, -9.0, 9.0).tolist()) + ")"
        near = F.expr(f"dist BETWEEN get({bound(low)}, list) AND get({bound(high)}, list)")
        return rows.filter((F.col("list") == NOWHERE) | near if nowhere else near)

    def _run(self, asked: _Asked, k: int, where: Column | None) -> DataFrame | None:
        rows = self._within(asked, where)
        if rows is None:
            return None
        shared = self.spark.sparkContext.broadcast(asked) if len(asked.ids) > 1 else _Here(asked)
        kind = self.item.simpleString()
        columns = ["list", "dist", "item_id", "packed", *asked.rules]
        return rows.select(*columns).mapInArrow(_compared(shared, k, self.kind), f"query_id long, item_id {kind}, similarity double")

    def ask(self, vector, k: int, where: Column | None = None) -> list[tuple]:
        """(item_id, similarity) of the k nearest to one vector, best first; ``where`` filters the rows."""
        if not self.n:
            return []
        asked = self._asked([0], np.array(vector, np.float64), {})
        near: list[tuple] = []
        if where is None and self.held is not None and len(self.held) >= k:
            # the k-th best of some rows is no better than that of all: one pass within its radius is enough
            least = np.partition(self.held @ asked.units[0], len(self.held) - k)[len(self.held) - k]
            asked.first[:] = False
            asked.radius = asked.reach(np.array([least - 10.0**-DIGITS]))
        for _ in range(2):
            rows = self._run(asked, k, where)
            if rows is not None:  # k rows a task at most
                near = sorted(near + [(-r.similarity, r.item_id) for r in rows.collect() if r.query_id is not None])[:k]
            if asked.radius is not None:
                break
            asked.radius = asked.reach(np.array([-near[-1][0] if len(near) == k else -2.0]))
        return [(name, -minus) for minus, name in near]

    def search(self, queries: DataFrame, id_col: str, vector: str, k: int, where: Column | None = None, rules: dict[str, tuple[str, str]] | None = None) -> tuple[DataFrame, float]:
        """What ``cosine_topk`` gives for the same corpus, and the share of similarities that weren't taken.

        Queries are compared in blocks of QUERIES, or HELD_CELLS distances to centroids; a block's vectors and its k-th similarities pass the driver.
        """
        rules = rules or {}
        rows = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).alias("v"), *[F.col(c).alias(f"_{i}") for i, (_, c) in enumerate(rules.values())]).filter("v IS NOT NULL")
        kind = self.item.simpleString()
        n = rows.count() if self.n else 0
        blocks, parts = -(-n // max(1, min(QUERIES, HELD_CELLS // max(1, len(self.centroids))))), []
        best = lambda df: df.filter("query_id IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")).cast("long"))
        for b in range(blocks):
            part = rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
            if not part:
                continue
            own = {c: (how, [r[f"_{i}"] for r in part]) for i, (c, (how, _)) in enumerate(rules.items())}
            asked = self._asked([r.query_id for r in part], np.array([r.v for r in part], np.float64), own)
            least: dict[int, float] = {}
            one = self._run(asked, k, where)
            if one is not None:
                parts.append(stage(one, "index-first"))
                least = {r.query_id: r.similarity for r in best(parts[-1]).filter(F.col("rank") == k).collect()}
            asked.radius = asked.reach(np.array([least.get(i, -2.0) for i in asked.ids]))
            two = self._run(asked, k, where)
            if two is not None:
                parts.append(stage(two, "index-others"))
        found = self.spark.createDataFrame([], f"query_id long, item_id {kind}, similarity double")
        for part in parts:
            found = found.unionByName(part)
        taken = found.filter("query_id IS NULL").agg(F.sum("similarity").alias("n")).first().n or 0
        return best(found).filter(F.col("rank") <= k), 1 - taken / max(1, n * self.n)


__all__ = ["VectorIndex", "fit_centroids"]
