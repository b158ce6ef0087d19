"""A corpus pipeline over the operators of skeinflow.llm.

Each stage takes the table that its predecessor wrote and returns what it keeps, in the columns of documents; the last
returns the tokens of what remains. A null text counts as empty, empty tables stay empty, and further columns of any
name are carried along. A row is known by its identifier and the digest of its text: of rows that agree in both, one
stays after the second stage, that of the least JSON of its other columns. So no row goes, or stays, for what another
row of its identifier, or another row without one, holds.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.bpe import encode_documents, read_ranks
from skeinflow.llm.decontaminate import contaminated
from skeinflow.llm.exact_dedup import exact_dedup
from skeinflow.llm.ngram_join import jaccard_join, text_hash
from skeinflow.llm.quality import learnable, score, train
from skeinflow.llm.staging import stage, stage_path

#: A document goes if its score is below this.
LEAST_QUALITY = 0.5
#: Near copies: Jaccard similarity of five-word shingles of at least SIMILAR / 100.
WORDS, SIMILAR = 5, 80
#: Keys of rows that go, or repeat, which are broadcast (about 100 bytes each); beyond it rows meet them by shuffle.
BROADCAST_KEYS = 200_000


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _own(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _key(row_id: Column, digest: Column) -> Column:
    return F.concat_ws(":", row_id.cast("string"), digest.cast("string"))


def _digest(docs: DataFrame) -> Column:
    return F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that may be learnt, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.filter(learnable(F.col("doc_id"))))
    name = _fresh(docs, "score")
    return score(docs, model, score_col=name).filter(F.col(name) >= LEAST_QUALITY).select(*_own(docs))


def _without(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose ``key`` isn't in ``gone`` (distinct): a few go by broadcast, more by shuffle."""
    gone = stage(gone, "pipeline-gone")
    return keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier."""
    key, copies = _fresh(docs, "key"), "copies"
    groups = exact_dedup(docs, keep="smallest").groupBy(_key(F.col("row_id"), F.col("text_sha256")).alias(key))
    groups = stage(groups.agg(F.max("kept").alias("kept"), F.count("*").alias(copies)).filter(f"NOT kept OR {copies} > 1"), "pipeline-exact")
    found = _without(docs.withColumn(key, _key(docs["doc_id"], _digest(docs))), key, groups.filter("NOT kept").select(key))
    # rows that agree in identifier and text meet, the others stay where they are
    again = groups.filter("kept").select(key)
    single = _without(found, key, again).select(*_own(docs))
    others = [c for c, name in zip(_own(docs), docs.columns, strict=True) if name not in ("doc_id", "text")]
    order = F.to_json(F.struct(F.lit(0).alias("_"), *others))
    repeated = found.join(F.broadcast(again) if again.count() <= BROADCAST_KEYS else again, key, "left_semi")
    one = repeated.select(F.col(key), F.struct(*_own(docs)).alias("row"), order.alias("order")).groupBy(key).agg(F.min_by("row", "order").alias("row"))
    return single.unionByName(one.select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest identifier."""
    key = _fresh(docs, "key")
    groups = jaccard_join(docs, k=WORDS, num=SIMILAR, den=100, with_hash=True)
    gone = groups.filter("NOT (doc_id <=> component_id AND text_hash = component_hash)").select(_key(F.col("doc_id"), F.col("text_hash")).alias(key)).distinct()
    return _without(docs.withColumn(key, _key(docs["doc_id"], text_hash(docs["text"]))), key, gone).select(*_own(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = _fresh(docs, "key")
    keyed = docs.withColumn(key, _key(docs["doc_id"], _digest(docs)))
    found = contaminated(keyed, items, id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return _without(keyed, key, found).select(*_own(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and the decoded bytes."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = encode_documents(docs, ranks, public_tokenizers.PATTERN, keep_decoded=False)
    return coded.select(F.col("row_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("tokens", tokens)]

#: The stages can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = stage_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
