"""Exact dedup by content sort.

Rows are range-partitioned by (the first 64 bytes, a 64-bit hash, the identifier) of the normalised text with Spark's
sampled splitters, whose keys are thus short whatever the texts are, and sorted externally by (those bytes, the hash,
the whole text, the identifier). Equal texts then stand next to each other, and a streaming pass compares whole
neighbours. The identifier is part of the partitioning, so a text with a third of all rows spreads over many tasks.
A run of equal texts that crosses a partition's border, or is longer than a piece, leaves one summary row per piece;
these are merged by SHA-256 and joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.staging import bound_batches, stage

#: Rows in an output batch of the neighbour pass, and most rows of a run held as one piece.
OUT_ROWS, PIECE_ROWS = 20_000, 100_000
#: Texts with several pieces that are broadcast back (about 150 bytes each); beyond it their rows are shuffled.
BROADCAST_RUNS = 500_000


def _neighbours(keep_largest: bool, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["row_id", "text_sha256", "run_keep", "run_size", "run_kept", "piece", "at_border"]
    types = [id_type, pa.string(), id_type, pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []  # (digest, rows, the kept row, piece, whether at a border) of the closed runs, and their rows
        rows: list[pa.Array] = []
        first = key = text = None  # (head, hash) of the partition's first row, of the open run, and its text
        ids: list[pa.Array] = []
        held = pieces = closed = 0
        torn = False  # the open run shares its hash with another text or has left a piece

        def close(border: bool) -> None:
            nonlocal pieces, held, ids, closed
            at = 0
            if held > 1:
                known = pa.concat_arrays(ids).is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
                at = held - 1 if not len(known) else int(known[-1] if keep_largest else known[0])
            # a partition has fewer than 2**32 pieces, and their numbers follow the order of rows
            out.append((hashlib.sha256(text).hexdigest(), held, closed + at, (part << 32) + pieces, border or key == first))
            rows.extend(ids)
            closed += held
            pieces, held, ids = pieces + 1, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal closed
            digests, sizes, keeps, numbers, borders = zip(*out, strict=True)
            own, run = pa.concat_arrays(rows), np.repeat(np.arange(len(out)), sizes)
            at = np.array(keeps, np.int64)
            kept = np.zeros(len(own), bool)
            kept[at] = True
            columns = [own, pa.array(digests).take(pa.array(run)), own.take(pa.array(at[run])), np.array(sizes, np.int64)[run], kept, np.array(numbers, np.int64)[run], np.array(borders)[run]]
            out.clear()
            rows.clear()
            closed = 0
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            bodies, hashes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            begin = 0
            for i, body in enumerate(bodies):
                same = body == text
                if same and held + i - begin < PIECE_ROWS:
                    continue
                if i > begin:
                    ids.append(batch.column(0).slice(begin, i - begin))
                    held += i - begin
                    begin = i
                now = (body[:64], hashes[i])
                if text is not None:
                    collides = not same and now == key
                    close(border=torn or same or collides)
                    torn = same or collides
                    if closed >= OUT_ROWS:
                        yield flush()
                text, key, first = body, now, first or now
            if len(bodies) > begin:
                ids.append(batch.column(0).slice(begin, len(bodies) - begin))
                held += len(bodies) - begin
        if text is not None:
            close(border=True)
            yield flush()

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: row_id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the row of each group of equal texts that stays: the one with the "smallest" or "largest" identifier.
    A null text counts as empty, and empty texts form a group like any other. A null identifier loses to any other; of
    rows with the same text and identifier exactly one stays. Other columns are ignored, so names can't clash. An empty
    table gives an empty result. ``normalise`` maps the text column before the comparison and defaults to no change.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    largest = keep == "largest"
    bound_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    body = (normalise(text) if normalise else text).cast("binary")
    keyed = df.select(df[id_col].alias("row_id"), body.alias("body"))
    keyed = keyed.select("row_id", "body", F.substring("body", 1, 64).alias("head"), F.xxhash64("body").alias("h"))
    ordered = keyed.repartitionByRange("head", "h", "row_id").sortWithinPartitions("head", "h", "body", "row_id").select("row_id", "body", "h")

    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([
        T.StructField("row_id", id_type), T.StructField("text_sha256", T.StringType()), T.StructField("run_keep", id_type),
        T.StructField("run_size", T.LongType()), T.StructField("run_kept", T.BooleanType()),
        T.StructField("piece", T.LongType()), T.StructField("at_border", T.BooleanType()),
    ])
    runs = stage(ordered.mapInArrow(_neighbours(largest, to_arrow_type(id_type)), schema), "exact-dedup")

    rank = F.struct(F.col("run_keep").isNull().alias("unknown"), F.col("run_keep").alias("id"), F.col("piece").alias("piece"))
    best = F.max(F.struct(F.col("run_keep").isNotNull().alias("known"), F.col("run_keep").alias("id"), F.col("piece").alias("piece"))) if largest else F.min(rank)
    pieces = runs.filter("at_border AND run_kept")
    merged = pieces.groupBy("text_sha256").agg(F.count("*").alias("n"), F.sum("run_size").alias("all_size"), best.alias("best")).filter("n > 1")
    merged = stage(merged.select(F.col("text_sha256").alias("sha"), "all_size", F.col("best.id").alias("all_keep"), F.col("best.piece").alias("best_piece")), "exact-runs")
    if merged.count() <= BROADCAST_RUNS:
        merged = F.broadcast(merged)
    joined = runs.filter("at_border").join(merged, F.col("text_sha256") == F.col("sha"), "left")
    crosses = F.col("sha").isNotNull()
    whole = ["row_id", "keep_id", "group_size", "kept", "text_sha256"]
    border = joined.select(
        "row_id",
        F.when(crosses, F.col("all_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.when(crosses, F.col("all_size")).otherwise(F.col("run_size")).alias("group_size"),
        (F.col("run_kept") & (~crosses | (F.col("piece") == F.col("best_piece")))).alias("kept"),
        "text_sha256",
    )
    inner = runs.filter("NOT at_border").select("row_id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("run_kept").alias("kept"), "text_sha256")
    return inner.select(*whole).unionByName(border)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, keep="largest").withColumnRenamed("row_id", "doc_id")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
