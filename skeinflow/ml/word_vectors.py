"""A text encoder learnt from a corpus: factorised co-occurrence of words, pooled by frequency.

Words are counted on Spark and the VOCABULARY most frequent kept; pairs of them within WINDOW words are counted by every
task and summed. Their positive pointwise mutual information is factorised by a randomised subspace iteration (Halko and
others, 2011), whose products with the matrix are passes over its rows, packed in blocks; what the driver holds is
vocabulary times dimensions, whatever the corpus. A text's vector is the sum of its words', rare ones weighing more (Arora and
others, 2017), without the direction that all texts share, at unit length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.sources.shared import stage

#: Words that have a vector, least occurrences of one, words around a word that count, dimensions.
VOCABULARY, LEAST, WINDOW, DIMS = 20_000, 5, 4, 64
#: Further directions that the iteration carries, its rounds, and the exponent by which contexts' counts are evened.
MORE, ROUNDS, EVEN = 8, 2, 0.75
#: The share of all words at which a word weighs half.
HALF = 1e-3
#: Pairs that a task holds before it counts them, and about how many words' rows travel together.
HELD, BLOCK = 1 << 21, 100
BATCH_BYTES = 4 << 20
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class WordVectors:
    """Words, their vectors and weights, and the shared direction. Called with texts it gives their vectors."""

    def __init__(self, words: list[str], vectors: np.ndarray, counts: np.ndarray) -> None:
        self.places = {w: i for i, w in enumerate(words)}
        share = counts / max(1, counts.sum())
        self.weighted = (vectors * (HALF / (HALF + share))[:, None]).astype(np.float32)
        common = (self.weighted * share[:, None]).sum(axis=0)
        length = np.linalg.norm(common)
        self.common = common / length if length > 0 else common

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.weighted.shape[1]))
        for row, text in zip(out, texts, strict=True):
            known = [p for w in words_of(text) if (p := self.places.get(w)) is not None]
            if known:
                row += self.weighted[known].sum(axis=0, dtype=np.float64)
        out -= np.outer(out @ self.common, self.common)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-9)

    def encoder(self, spark: SparkSession) -> Callable[[list[str]], np.ndarray]:
        """The model as an ``encoder.Encoder``; it travels once to each executor."""
        shared = spark.sparkContext.broadcast(self)
        return lambda texts: shared.value(texts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.update(words_of(text))
        if len(found) > 1 << 18:
            yield flush()
    yield flush()


def _pairs(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        size, held, n = len(places), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys // size, pa.int32()), pa.array(keys % size, pa.int32()), pa.array(counts, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.array([p for w in words_of(text) if (p := places.get(w)) is not None], np.int64)
                for step in range(1, window + 1):
                    one, two = ids[:-step], ids[step:]
                    if len(one):
                        held.append(np.minimum(one, two) * size + np.maximum(one, two))
                        n += len(one)
                if n >= HELD:
                    yield flush()
                    n = 0
        yield flush()

    return run


def _rows(shared):
    """Counted pairs (block, w, c, n) of a block to its rows of the information matrix: rows and columns of the values."""

    def run(pairs: pa.Table) -> pa.Table:
        counts, evened, total, blocks = shared.value
        w, c, n = (pairs[name].to_numpy().astype(np.int64) for name in ("w", "c", "n"))
        # of one word with a context, whose counts are evened
        value = np.maximum(np.log(n * total / (counts[w] * evened[c])), 0) / 2
        value += np.maximum(np.log(n * total / (counts[c] * evened[w])), 0) / 2
        packed = ((w // blocks).astype(np.int32), c.astype(np.int32), value)
        return pa.table({"block": pairs["block"].slice(0, 1), **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("w", "c", "value"), packed, strict=True)}})

    return run


def _product(shared):
    """Packed rows of the information matrix to those of it times a dense matrix, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, blocks = shared.value
        for batch in batches:
            for block, *packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                w, c, value = (np.frombuffer(x, t) for x, t in zip(packed, (np.int32, np.int32, np.float64), strict=True))
                own = np.zeros((-(-(len(dense) - block) // blocks), len(dense)))
                own[w, c] = value
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(own @ dense).tobytes()], pa.binary())], names=["block", "part"])

    return run


def fit(df: DataFrame, text_col: str = "text", dims: int = DIMS, vocabulary: int = VOCABULARY, least: int = LEAST, window: int = WINDOW) -> WordVectors:
    """Learns from all texts of ``df``; null ones count as empty. Of words that are equally frequent the lower one is kept.
    A corpus without a word that occurs ``least`` times gives a model that maps every text to zeros."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    kept = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = kept.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    names, counts = [r.word for r in rows], np.array([r.n for r in rows], float)
    if not names:
        return WordVectors([], np.zeros((0, dims)), counts)
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})
    pairs = stage(texts.mapInArrow(_pairs(shared, window), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "word-pairs")
    sides = pairs.select(F.explode(F.when(F.col("a") != F.col("b"), F.array("a", "b")).otherwise(F.array("a"))).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    seen = np.full(len(names), 1e-9)
    for r in sides.collect():
        seen[r.w] = r.n
    evened = seen**EVEN
    evened *= seen.sum() / evened.sum()
    width = min(dims + MORE, len(names))
    blocks = -(-len(names) // BLOCK)  # words that are as frequent go to different ones
    known = spark.sparkContext.broadcast((seen, evened, seen.sum(), blocks))
    ways = F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("c")), F.struct(F.col("b").alias("w"), F.col("a").alias("c")))
    both = pairs.select(F.explode(F.when(F.col("a") != F.col("b"), ways).otherwise(F.slice(ways, 1, 1))).alias("way"), "n").select((F.col("way.w") % blocks).alias("block"), "way.w", "way.c", "n")
    matrix = stage(both.groupBy("block").applyInArrow(_rows(known), "block int, w binary, c binary, value binary"), "word-rows")

    def product(dense: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast((dense, blocks))
        out = np.zeros_like(dense)
        for r in matrix.mapInArrow(_product(sent), "block int, part binary").collect():
            out[r.block :: blocks] = np.frombuffer(r.part, np.float64).reshape(-1, dense.shape[1])
        return out

    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(len(names), width)))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))[:dims]
    return WordVectors(names, basis @ turn[:, order] * np.sqrt(np.abs(values[order])), counts)
