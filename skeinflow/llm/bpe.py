"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.bytepairs import encode, encoder
from skeinflow.llm.staging import bound_batches

__all__ = ["encode", "encode_documents", "encoder", "op4_byte_bpe", "read_ranks"]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(df: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_decoded: bool | None = None) -> DataFrame:
    """row_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` ids (array<int>) and decoded (binary), which
    ``keep_decoded`` decides by itself.

    A null text counts as empty and has no tokens. Decoding joins the tokens' raw bytes, so it restores every text's
    UTF-8. Rows are independent: repeated rows give repeated results, other columns are ignored, and an empty table
    gives an empty result. The rank file travels as a broadcast of its own fixed size, so executors need no copy.
    """
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(ranks_file)
    kind = df.schema[id_col].dataType
    keep_decoded = keep_ids if keep_decoded is None else keep_decoded
    out = f"row_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded binary" * keep_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        digits = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            counts, hashes, decoded_hashes, all_ids, all_bytes = [], [], [], [], []
            for text in batch.column(1):
                ids = encode(enc, text.as_py())
                raw = enc.decode_bytes(ids)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded_hashes.append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
                if keep_decoded:
                    all_bytes.append(raw)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded_hashes, pa.string())]
            names = ["row_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if keep_decoded:
                columns.append(pa.array(all_bytes, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(df[id_col].alias("row_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, out)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, keep_ids=False).withColumnRenamed("row_id", "doc_id")
