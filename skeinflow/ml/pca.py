"""Principal components of pooled vectors, of all of them or of those that each fold may know."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(df: DataFrame, vector: str, k: int = 5, fit_on: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
    """``df`` with filing_pc1..k, and the shares of variance. The basis is fitted on ``fit_on`` (default: all of ``df``).

    The mean is subtracted first, as the transformer doesn't; a component's largest loading is made positive, so signs
    are settled.
    """
    rows = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    base = rows if fit_on is None else fit_on.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    mean = base.select(Summarizer.mean(F.col("_v")).alias("m")).first().m.toArray()
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(base)
    axes = model.pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    centred = F.zip_with(vector_to_array("_v"), F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    out = rows.withColumn("_c", centred)
    dot = lambda axis: F.aggregate(F.zip_with("_c", F.array(*[F.lit(float(x)) for x in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return out.withColumns({f"filing_pc{i + 1}": F.round(dot(axes[:, i]), 8) for i in range(k)}).drop("_v", "_c"), np.asarray(model.explainedVariance)


def _sketched(cuts: list, dims: int):
    """Rows (day, vector) to sums by the first cut that isn't before the day; rows behind all cuts go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts, "datetime64[D]")
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dims)
            place = np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False).astype("datetime64[D]"))
            for cut in np.unique(place[place < len(edges)]).tolist():
                own = np.concatenate([rows[place == cut], np.ones(((place == cut).sum(), 1))], axis=1)
                found[cut] = found.get(cut, 0) + own.T @ own  # products, sums and the number in one matrix
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([m.tobytes() for m in found.values()], pa.binary())], names=["cut", "sums"])

    return run


def _merged(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in parts["sums"])
    return pa.table({"cut": parts["cut"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def fold_bases(rows: DataFrame, day: str, vector: str, ends: dict[str, date], k: int = 5) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each fold (mean, axes: dimensions by ``k``) of the rows up to the day on which its training ends.

    One pass over the rows sums products by the ends that they lie between; sums up to an end are sums of these, so every
    fold gets its own basis and none has seen a later row. What the driver holds is a matrix for each end. A fold with
    fewer than two rows, or none, has axes of zeros; missing axes are zeros, too.
    """
    known = rows.select(F.col(day).cast("date").alias("day"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("day IS NOT NULL AND v IS NOT NULL")
    first = known.first()
    dims = len(first.v) if first else k
    cuts = sorted(set(ends.values()))
    sums = known.mapInArrow(_sketched(cuts, dims), "cut int, sums binary").groupBy("cut").applyInArrow(_merged, "cut int, sums binary")
    found = {r.cut: np.frombuffer(r.sums, np.float64).reshape(dims + 1, dims + 1) for r in sums.collect()}
    upto, total = {}, np.zeros((dims + 1, dims + 1))
    for i, cut in enumerate(cuts):
        total = total + found.get(i, 0)
        upto[cut] = total
    out = {}
    for fold, end in ends.items():
        n, mean = upto[end][-1, -1], upto[end][-1, :-1] / max(1.0, upto[end][-1, -1])
        axes = np.zeros((dims, k))
        if n >= 2:
            values, vectors = np.linalg.eigh((upto[end][:-1, :-1] - n * np.outer(mean, mean)) / (n - 1))
            best = np.argsort(-values, kind="stable")[: min(k, dims)]
            own = vectors[:, best]
            axes[:, : len(best)] = own * np.sign(own[np.abs(own).argmax(axis=0), np.arange(len(best))])
        out[fold] = (mean, axes)
    return out


def fold_components(rows: DataFrame, day: str, vector: str, folds: DataFrame, k: int = 5) -> DataFrame:
    """``rows`` without their vector, with fold_id and filing_pc1..k, for each fold that tests on or after their day; the
    basis is that of the fold's own training time."""
    listed = folds.select("fold_id", "train_end", "test_end").collect()  # a few dozen rows of dates
    bases = fold_bases(rows, day, vector, {r.fold_id: r.train_end for r in listed}, k)
    shared = rows.sparkSession.sparkContext.broadcast(bases)
    named = [f"filing_pc{i + 1}" for i in range(k)]

    def projected(folds_of: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(vectors), k))
        for fold in folds_of.unique():
            mean, axes = shared.value[fold]
            own = (folds_of == fold).to_numpy()
            out[own] = (np.stack(vectors[own].to_numpy()).astype(np.float64) - mean) @ axes
        return pd.DataFrame(np.round(out, 8) + 0.0, columns=named)

    use = F.explode(F.array(*[F.struct(F.lit(r.fold_id).alias("fold_id"), F.lit(r.test_end).alias("test_end")) for r in listed])).alias("f") if listed else None
    if use is None:
        return rows.drop(vector).withColumns({"fold_id": F.lit(None).cast("string")} | {c: F.lit(0.0) for c in named}).filter("false")
    each = rows.filter(F.col(vector).isNotNull()).select("*", use).filter(F.col(day) <= F.col("f.test_end"))
    pcs = F.pandas_udf(projected, ", ".join(f"{c} double" for c in named))(F.col("f.fold_id"), F.transform(vector, lambda x: x.cast("double")))
    return each.withColumn("_p", pcs).select(*[c for c in rows.columns if c != vector], "f.fold_id", "_p.*")
