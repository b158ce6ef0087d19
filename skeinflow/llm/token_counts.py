"""Token counts as delta-maintained rollups.

Every change of the corpus is a signed row: an insert adds a document and its tokens, a delete takes them away, a revised
count does both. A batch of changes is summed by (source, language, tokenizer version) and written to a folder named by
the batch's identifier; the writer's success file commits it, so a batch that is sent again changes nothing, and one that
died half-way is written anew. Totals are sums over the committed batches. Folding merges batches into a base that
remembers their identifiers in a table, which is asked for single names only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.bpe import encode, encoder, read_ranks
from skeinflow.llm.staging import bound_batches, committed, exists, remove, stage, stage_path

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens"]
#: Bytes of a token in the rough rule.
BYTES_PER_TOKEN = 4
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def estimate_tokens(docs: DataFrame, versions: Iterable[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """What ``count_tokens`` gives, by a rough rule (BYTES_PER_TOKEN) until the real counts are known."""
    rough = F.floor(F.octet_length(F.coalesce(docs[text_col].cast("string"), F.lit(""))) / BYTES_PER_TOKEN).cast("long")
    names = F.explode(F.array(*[F.lit(v) for v in versions]).cast("array<string>")).alias("tokenizer_version")
    return docs.select(docs[id_col].alias("row_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), names, rough.alias("n_tokens"))


def count_tokens(docs: DataFrame, ranks: dict[str, bytes], pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row_id, source, lang, tokenizer_version, n_tokens) of every row of ``docs`` under every rank file, named by its version.

    All versions are counted in one pass over the texts. A null text counts as empty and has no tokens, a text of any
    length is counted whole; null identifiers, sources and languages are values like any other. Other columns are
    ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [(version, encoder(file, pattern)) for version, file in shared.value.items()]
        for batch in batches:
            texts = [x or "" for x in batch.column(3).to_pylist()]
            for version, enc in encoders:
                counts = pa.array([len(encode(enc, t)) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * len(texts), pa.string()), counts], names=["row_id", *KEYS, "n_tokens"])

    rows = docs.select(docs[id_col].alias("row_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"row_id {docs.schema[id_col].dataType.simpleString()}, source string, lang string, tokenizer_version string, n_tokens long")


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.coalesce("n_tokens", F.lit(0)) * sign).cast("long").alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose count, source or language changed: their old rows go, their new ones come."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        return f"{self.path}/batches/{batch_id.encode().hex() or '-'}"

    def _names(self, kind: str) -> list[str]:
        """The committed folders of a kind."""
        return committed(self.spark, f"{self.path}/{kind}")

    def _base(self) -> int:
        """The number of the present base, -1 for none; its identifiers are written last, so they make it whole."""
        return max((int(n) for n in self._names("folded")), default=-1)

    def _folded(self, n: int, ids: list[str]) -> set[str]:
        """Those of ``ids`` that base ``n`` holds; the table of all is filtered on the executors."""
        if n < 0 or not ids:
            return set()
        known = self.spark.read.schema("id string").parquet(f"{self.path}/folded/{n}")
        return {r.id for r in known.filter(F.col("id").isin(ids)).distinct().collect()}

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds the signed rows of a batch once; False if the identifier was committed before."""
        target = self._batch(batch_id)
        if exists(self.spark, f"{target}/_SUCCESS") or self._folded(self._base(), [batch_id]):
            return False
        sums = deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.write.mode("overwrite").parquet(target)
        return True

    def _open(self, n: int) -> list[str]:
        """Folders of committed batches that base ``n`` doesn't hold; as many as were sent since the last fold."""
        ids = {name: bytes.fromhex(name.replace("-", "")).decode() for name in self._names("batches")}
        folded = self._folded(n, list(ids.values()))
        return [name for name, i in ids.items() if i not in folded]

    def _sum(self, n: int, names: list[str]) -> DataFrame:
        paths = [*([f"{self.path}/base/{n}"] if n >= 0 else []), *[f"{self.path}/batches/{name}" for name in names]]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens); groups whose documents are all gone are left out."""
        n = self._base()
        return self._sum(n, self._open(n))

    def fold(self) -> None:
        """Merges all committed batches into a new base; a fold that dies leaves the totals as they were.

        The base before stays for readers that have planned on it; older ones are removed.
        """
        n = self._base()
        names = self._open(n)
        self._sum(n, names).write.mode("overwrite").parquet(f"{self.path}/base/{n + 1}")
        ids = self.spark.createDataFrame([(bytes.fromhex(x.replace("-", "")).decode(),) for x in names], "id string")
        if n >= 0:
            ids = self.spark.read.schema("id string").parquet(f"{self.path}/folded/{n}").unionByName(ids)
        ids.write.mode("overwrite").parquet(f"{self.path}/folded/{n + 1}")
        for name in names:
            remove(self.spark, f"{self.path}/batches/{name}")
        for old in range(max(0, n - 1), n):
            for kind in ("folded", "base"):
                remove(self.spark, f"{self.path}/{kind}/{old}")


#: Rank files of the query, by the version that names them.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of all documents, after the changes that a corpus sees: rows arrive with a rough count, the tokenizers'
    counts revise it, one row in ten is withdrawn and comes back. Every batch is sent twice, as by a feed that delivers
    at least once, and the first two are folded before the others come."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    rollup = TokenRollup(spark, stage_path(spark, "token-rollup"))
    ranks = {version: read_ranks(public_tokenizers.path(f"{version}.tiktoken")) for version in VERSIONS}
    rough = estimate_tokens(docs, VERSIONS)
    counts = stage(count_tokens(docs, ranks, public_tokenizers.PATTERN), "token-counts")
    some = counts.filter(F.pmod(F.xxhash64("row_id"), F.lit(10)) == 0)
    for batch_id, deltas in (("arrival", inserts(rough)), ("counted", revisions(rough, counts))):
        for _ in range(2):
            rollup.commit(batch_id, deltas)
    rollup.fold()
    for batch_id, deltas in (("withdrawn", deletes(some)), ("returned", inserts(some)), ("arrival", inserts(rough))):
        for _ in range(2):
            rollup.commit(batch_id, deltas)
    return rollup.totals()
