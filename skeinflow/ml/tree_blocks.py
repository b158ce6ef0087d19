"""Boosted trees of folds whose rows are too many for one task: the trees of ``trees.fit``, grown by passes over blocks of rows.

A row's place in its fold's order, (trade_date, company_key), picks its random numbers, as in one task. A pass adds up each
block's histograms of the nodes that a level still has, and a shuffle by (fold, node) finds their splits; the driver holds
trees and edges only. All folds go through a pass together.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.ml import trees
from skeinflow.session import small_batches
from skeinflow.sources.shared import remove, stage, stage_path

ROWS = "fold int, at long, y binary, codes binary, score binary"
SPLITS = "fold int, node int, total_g long, total_h long, best int, at int, low_g long, low_h long"


def _numbered(train: DataFrame, features: list[str], numbers: DataFrame) -> DataFrame:
    """(fold, place, label, x): a row's place in its fold, counted by day first."""
    rows = train.join(F.broadcast(numbers), "fold_id")
    days = rows.groupBy("fold", "trade_date").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("fold").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("fold", "trade_date").orderBy("company_key"))
    placed = rows.withColumn("inside", inside).join(F.broadcast(days.select("fold", "trade_date", before.alias("before"))), ["fold", "trade_date"])
    return placed.select("fold", (F.col("before") + F.col("inside") - 1).alias("place"), "label", F.array(*features).alias("x"))


def _edges(rows: DataFrame, sizes: list[int], width: int, use: trees.Settings) -> list[list[np.ndarray]]:
    """Edges of each fold's features: numpy's quantiles, from the values at the places that they lie between."""
    spark = rows.sparkSession
    at = [(n - 1) * trees._quantiles(use) for n in sizes]
    places = [np.unique(np.concatenate([np.floor(a), np.minimum(np.floor(a) + 1, n - 1), [n - 1]]).astype(np.int64)) for a, n in zip(at, sizes, strict=True)]
    wanted = spark.createDataFrame([(fold, int(p)) for fold, own in enumerate(places) for p in own], "fold int, rank long")
    values = rows.select("fold", F.posexplode("x").alias("feature", "value"))
    ranked = values.withColumn("rank", (F.row_number().over(Window.partitionBy("fold", "feature").orderBy("value")) - 1).cast("long"))
    found = ranked.join(F.broadcast(wanted), ["fold", "rank"]).select("fold", "feature", "rank", "value").toArrow()  # some hundred for a feature
    fold, feature, rank, value = (found[c].to_numpy() for c in found.column_names)
    order = np.lexsort((rank, feature, fold))
    out, first = [], 0
    for a, own in zip(at, places, strict=True):
        mine = []
        for _ in range(width):
            v = value[order[first : first + len(own)]]
            first += len(own)
            low = np.searchsorted(own, np.floor(a).astype(np.int64))
            high = np.minimum(low + 1, len(own) - 1)
            mine.append(np.array([np.nan]) if np.isnan(v[-1]) else np.unique([np.quantile(v[[i, j]], part) for i, j, part in zip(low, high, a - np.floor(a), strict=True)]))
        out.append(mine)
    return out


def _packed(shared):
    def run(rows: pa.Table) -> pa.Table:
        edges, starts = shared.value
        rows = rows.sort_by("place")
        fold = rows["fold"][0].as_py()
        x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        y = np.ascontiguousarray(rows["label"].to_numpy(), np.float64)
        codes = trees._codes(x, edges[fold]).astype(np.uint8)
        return pa.table({"fold": pa.array([fold], pa.int32()), "at": rows["place"].slice(0, 1), "y": pa.array([y.tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary()), "score": pa.array([np.full(len(y), starts[fold]).tobytes()], pa.binary())})

    return run


class _Tree:
    """A tree in arrays: the children of node i are 2 i + 1 and 2 i + 2."""

    def __init__(self, depth: int) -> None:
        size = (2 << depth) - 1
        self.feature, self.at = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.value, self.cover = np.zeros(size), np.zeros(size)

    def set(self, i: int, total_g: int, total_h: int, use: trees.Settings) -> None:
        made = trees._node(total_g, total_h, use)
        self.value[i], self.cover[i] = made.value, made.cover

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        flat, first = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        at = np.zeros(len(codes), np.int64)
        while True:
            feature = self.feature[at]
            inside = feature >= 0
            if not inside.any():
                return at
            child = 2 * at + 2 - (flat[first + np.maximum(feature, 0)] <= self.at[at])
            at = np.where(inside, child, at)

    def node(self, edges: list[np.ndarray], i: int = 0) -> trees.Node:
        out = trees.Node(float(self.value[i]), float(self.cover[i]))
        if self.feature[i] >= 0:
            out.feature, out.bound = int(self.feature[i]), float(edges[self.feature[i]][self.at[i]])
            out.low, out.high = self.node(edges, 2 * i + 1), self.node(edges, 2 * i + 2)
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            fold, at, y, codes, score = (batch.column(c)[i].as_py() for c in range(5))
            y = np.frombuffer(y, np.float64)
            yield fold, at, y, np.frombuffer(codes, np.uint8).reshape(len(y), -1), np.frombuffer(score, np.float64)


def _scored(score: np.ndarray, codes: np.ndarray, made: list[_Tree]) -> np.ndarray:
    score = score.copy()
    for tree in made:
        score += tree.value[tree.places(codes)]
    return score


def _rescored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, at, y, codes, score in _blocks(batches):
            parts = [x.tobytes() for x in (y, codes, _scored(score, codes, shared.value[fold]))]
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([at], pa.int64()), *[pa.array([x], pa.binary()) for x in parts]], names=["fold", "at", "y", "codes", "score"])

    return run


def _summed(shared, use: trees.Settings):
    """Blocks to (fold, node, g, h): the task's histograms of each open node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for fold, at, y, codes, score in _blocks(batches):
            if fold not in shared.value:
                continue  # its tree is complete
            state, features, made, tree, nodes, _ = shared.value[fold]
            g, h = trees._derivatives(_scored(score, codes, made), y)
            if use.rows < 1:
                bits = np.random.PCG64()
                bits.state = state
                bits.advance(at)
                rows = np.flatnonzero(np.random.Generator(bits).random(len(y)) < use.rows)
                codes, g, h = codes[rows], g[rows], h[rows]
            of = np.full(len(tree.feature), -1)
            of[nodes] = np.arange(len(nodes))
            of = of[tree.places(codes)]
            rows = np.flatnonzero(of >= 0)
            own = trees._histogram(codes[np.ix_(rows, features)], of[rows], len(nodes), g[rows], h[rows], use.bins)
            sums[fold] = [a + b for a, b in zip(sums[fold], own, strict=True)] if fold in sums else list(own)
        for fold, (g, h) in sums.items():
            nodes = shared.value[fold][4]
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), *[pa.array([x.tobytes() for x in own], pa.binary()) for own in (g, h)]], names=["fold", "node", "g", "h"])

    return run


def _best(shared, use: trees.Settings):
    def run(parts: pa.Table) -> pa.Table:
        fold, node = parts["fold"][0].as_py(), parts["node"][0].as_py()
        lengths = shared.value[fold][5]
        g, h = (sum(np.frombuffer(x, np.int64) for x in parts[c].to_pylist()).reshape(len(lengths), -1) for c in ("g", "h"))
        best, at, low_g, low_h = trees._split(g, h, lengths, use) or (-1, 0, 0, 0)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        values = [fold, node, int(g[0].sum()), int(h[0].sum()), best, at, low_g, low_h]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in SPLITS.split(", ")])

    return run


def _skip(rng: np.random.Generator, n: int) -> dict:
    """The generator's state; it goes on as if it had drawn n numbers."""
    bits = rng.bit_generator
    before = bits.state
    bits.advance(n)
    bits.state = bits.state | {k: before[k] for k in ("has_uint32", "uinteger")}
    return before


def _next_trees(spark: SparkSession, blocks: DataFrame, drawn: list[tuple], recent: list[list[_Tree]], lengths: list[np.ndarray], use: trees.Settings) -> list[_Tree]:
    """One more tree of each fold, a level in a pass."""
    grown = [_Tree(use.depth) for _ in drawn]
    live = {fold: [0] for fold in range(len(drawn))}
    for level in range(max(1, use.depth)):
        if not live:
            break
        shared = spark.sparkContext.broadcast({fold: (*drawn[fold], recent[fold], grown[fold], nodes, lengths[fold][drawn[fold][1]]) for fold, nodes in live.items()})
        found = blocks.mapInArrow(_summed(shared, use), "fold int, node int, g binary, h binary").groupBy("fold", "node").applyInArrow(_best(shared, use), SPLITS).collect()
        live = {}
        for r in sorted(found):
            tree = grown[r.fold]
            if level == 0:
                tree.set(0, r.total_g, r.total_h, use)
            if r.best < 0 or use.depth == 0 or tree.cover[r.node] < 2 * use.least:
                continue
            tree.feature[r.node], tree.at[r.node] = drawn[r.fold][1][r.best], r.at
            for child, g, h in ((2 * r.node + 1, r.low_g, r.low_h), (2 * r.node + 2, r.total_g - r.low_g, r.total_h - r.low_h)):
                tree.set(child, g, h, use)
                if level + 1 < use.depth and tree.cover[child] >= 2 * use.least:
                    live.setdefault(r.fold, []).append(child)
        shared.unpersist()
    return grown


def fit_large(train: DataFrame, sizes: dict[str, int], features: list[str], use: trees.Settings) -> DataFrame:
    """trees.MODELS of the folds in ``sizes`` (their numbers of rows), all of whose rows are in ``train``."""
    spark = train.sparkSession
    small_batches(spark)
    names, counts = sorted(sizes), [sizes[f] for f in sorted(sizes)]
    numbers = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "fold_id string, fold int")
    rows = stage(_numbered(train, features, numbers), "fold-rows")
    edges = _edges(rows, counts, len(features), use)
    ups = {r.fold: r.up for r in rows.groupBy("fold").agg(F.sum("label").alias("up")).collect()}
    starts = [trees._start(ups[i] / n) for i, n in enumerate(counts)]
    shared = spark.sparkContext.broadcast((edges, starts))
    packed = rows.withColumn("block", F.floor(F.col("place") / trees.BLOCK)).groupBy("fold", "block").applyInArrow(_packed(shared), ROWS)
    path = stage_path(spark, "tree-blocks")
    packed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)).write.parquet(path)
    rngs, made, recent = [np.random.default_rng(use.seed) for _ in names], [[] for _ in names], [[] for _ in names]
    lengths = [np.array([len(e) for e in own]) for own in edges]
    for n in range(use.trees):
        blocks = spark.read.schema(ROWS).parquet(path)
        drawn = []
        for rng, size in zip(rngs, counts, strict=True):
            state = _skip(rng, size) if use.rows < 1 else None
            drawn.append((state, trees._columns(rng, len(features), use)))
        for fold, tree in enumerate(_next_trees(spark, blocks, drawn, recent, lengths, use)):
            recent[fold].append(tree)
            made[fold].append(tree.node(edges[fold]))
        if len(recent[0]) == trees.KEEP and n + 1 < use.trees:
            before, path = path, stage_path(spark, "tree-blocks")
            blocks.mapInArrow(_rescored(spark.sparkContext.broadcast(recent)), ROWS).write.parquet(path)
            remove(spark, before)
            recent = [[] for _ in names]
    models = [(name, n, bytearray(pickle.dumps((start, own))), trees.importances(own, features)) for name, n, start, own in zip(names, counts, starts, made, strict=True)]
    return spark.createDataFrame(models, trees.MODELS)
