"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed character trigrams, once as they stand and once with letters and digits mapped to their
kind, so both wording and form show, and a term for the share of its words that repeat the word before. Counts are damped, weighted by inverse document frequencies over all documents,
and projected on the leading singular vectors of a bounded sample of labelled rows. The sample's vectors, a fixed number
of numbers, are broadcast; each block of documents gets its exact cosines with all of them, and the nearest neighbours'
labels are averaged by similarity.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.hashing import words
from skeinflow.llm.staging import bound_batches

#: Hash buckets of the trigrams as they stand and of their kinds.
PLAIN, KINDS = 4096, 2048
#: Least shares of repeated words of the repetition terms, after a first term for none.
REPEATS = np.array([0.0, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64])
TERMS = PLAIN + KINDS + len(REPEATS) + 1
#: Most labelled rows that are fitted and voted on, by the hash of the identifier.
SAMPLE = 4000
#: Dimensions of the vectors; neighbours that vote; the power of the similarity that weighs a vote.
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 15, 4.0
#: Length of the repetition terms beside the trigrams' length of 1.
FORM_WEIGHT = np.float32(0.4)
#: Rows projected and compared at once.
BLOCK = 128


def _kinds() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint32)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 97, 65, 48, 97
    return kind


_KIND = _kinds()


def term_counts(text: bytes) -> np.ndarray:
    """Counts of the TERMS features of a text; with fewer than three bytes there are no trigrams."""
    raw = np.frombuffer(text, np.uint8)
    counts = np.zeros(TERMS, np.float32)
    word, _ = words(raw)
    if len(word):
        share = float((word[1:] == word[:-1]).mean()) if len(word) > 1 else 0.0
        counts[PLAIN + KINDS + int(np.searchsorted(REPEATS, share, "left"))] = 1
    if len(raw) < 3:
        return counts
    for at, size, codes in ((0, PLAIN, raw.astype(np.uint32)), (PLAIN, KINDS, _KIND[raw])):
        h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts[at : at + size] = np.bincount(h >> np.uint32(32 - (size.bit_length() - 1)), minlength=size)
    return counts


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, unit length
    labels: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return _weigh(counts, self.idf)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Scores of rows of counts; a row without terms, or without a similar neighbour, gets the labels' mean."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(counts), prior)
        if not len(self.vectors):
            return out
        near = _unit(self.weigh(counts) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        voted = total > 0
        out[voted] = (weight * self.labels[best]).sum(axis=1)[voted] / total[voted]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    damped = np.log1p(counts) * idf
    form = PLAIN + KINDS
    return np.concatenate([_unit(damped[:, :form]), FORM_WEIGHT * _unit(damped[:, form:])], axis=1)


@dataclass
class Counts:
    """Counts of many rows without their zeros: of row i the terms and counts from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def weighed(self, idf: np.ndarray) -> Iterator[np.ndarray]:
        """The weighed rows in dense blocks, so a sample never stands in memory with its zeros."""
        for at in range(0, len(self.starts) - 1, BLOCK):
            bounds = self.starts[at : at + BLOCK + 1]
            block = np.zeros((len(bounds) - 1, TERMS), np.float32)
            inside = slice(bounds[0], bounds[-1])
            block[np.repeat(np.arange(len(block)), np.diff(bounds)), self.terms[inside]] = self.counts[inside]
            yield _weigh(block, idf)


def fit(counts: Counts, labels: np.ndarray, idf: np.ndarray) -> Model:
    """Singular vectors by subspace iteration from a fixed start."""
    n = len(counts.starts) - 1
    rng = np.random.default_rng(0)
    axes = np.linalg.qr(rng.standard_normal((TERMS, min(DIMENSIONS + 16, n, TERMS))))[0].astype(np.float32)
    for _ in range(4):
        turned = np.zeros(axes.shape, np.float32)
        for block in counts.weighed(idf):
            turned += block.T @ (block @ axes)
        axes = np.linalg.qr(turned)[0].astype(np.float32)
    latent = np.concatenate([block @ axes for block in counts.weighed(idf)])
    _, _, turn = np.linalg.svd(latent, full_matrices=False)
    turn = turn[:DIMENSIONS].T
    return Model(idf, np.ascontiguousarray(axes @ turn), _unit(latent @ turn), labels.astype(np.float64))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held += term_counts(text or b"") > 0
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate(([n], held)))], names=["term", "n"])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, counts = [], []
        for text in batch.column(0).to_pylist():
            every = term_counts(text or b"")
            held = np.flatnonzero(every)
            terms.append(held.astype(np.uint16).tobytes())
            counts.append(every[held].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["at", "label", "terms", "counts"])


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` rows of ``labelled`` (id_col, label_col), those of the least hash; idf covers all of ``docs``.

    Null labels and identifiers are left out. Of labels that share an identifier the greatest counts, of documents that
    do the one with the least text hash, so an identifier gives one row. Without labelled rows every score is 0.5.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = docs[text_col].cast("string").cast("binary").alias("text")
    frequencies = docs.select(text).mapInArrow(_document_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in frequencies}  # a number for each of the TERMS
    n = found.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([found.get(t, 0) for t in range(TERMS)]))).astype(np.float32) + np.float32(1)

    chosen = labelled.select(labelled[id_col].alias("id"), labelled[label_col].cast("double").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(text, F.lit(b"")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text").alias("h"), "text")).alias("text"), F.max("label").alias("label"))
    rows = rows.select("text", F.xxhash64("id", "text").alias("at"), "label")
    fitted = sorted(rows.mapInArrow(_sample_counts, "at long, label double, terms binary, counts binary").collect(), key=lambda r: (r.at, r.label))
    if not fitted:
        empty = np.zeros((0, DIMENSIONS), np.float32)
        return Model(idf, np.zeros((TERMS, DIMENSIONS), np.float32), empty, np.zeros(0))
    terms = [np.frombuffer(r.terms, np.uint16) for r in fitted]
    counts = Counts(np.cumsum([0, *map(len, terms)]), np.concatenate(terms), np.concatenate([np.frombuffer(r.counts, np.float32) for r in fitted]))
    return fit(counts, np.array([r.label for r in fitted]), idf)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col`` (0 to 1) from the text alone, in place of one of this name, if any; null and
    empty texts have the score of no terms at all."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for part in texts:
            bodies = part.tolist()
            blocks = [own.score(np.stack([term_counts((x or "").encode()) for x in bodies[i : i + BLOCK]])) for i in range(0, len(bodies), BLOCK)]
            yield pd.Series(np.concatenate(blocks) if blocks else np.zeros(0))

    return docs.withColumn(score_col, F.pandas_udf(scored, "double")(docs[text_col].cast("string")))


def learnable(id_column):
    """True for the rows whose labels may be learnt: crc32 of the identifier as text, modulo 3, is not 1. A row without an
    identifier can't be found among the labels, so it is none of them: it is held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.filter(learnable(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
