"""Each stage of the pipeline against a plain version of it, and the whole against these in a row."""

import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline as cp
from skeinflow.llm.bpe import encoder, read_ranks

from .test_decontaminate import grams
from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage; the quality stage's own decision is taken as it is."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        found.append([r.asDict() for r in out.collect()])
        docs = spark.createDataFrame(out.collect(), out.schema) if name != "tokens" else None
    return found


def test_stages(spark, stages):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    quality, exact, near, clean, tokens = stages
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {d["doc_id"] for d in quality}
    held = [(d, q) for d, q in labels.items() if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum((d in ids) == bool(q) for d, q in held) >= 0.95 * len(held)
    assert all(d in docs for d in quality)

    first = {}
    for d in sorted(quality, key=lambda d: d["doc_id"]):
        first.setdefault(d["text"], d)
    assert sorted(first.values(), key=lambda d: d["doc_id"]) == sorted(exact, key=lambda d: d["doc_id"])

    groups = brute([(d["doc_id"], d["text"]) for d in exact], 5, 80, 100)
    assert {d["doc_id"] for d in near} == {d for d, (_, c, _) in groups.items() if d == c}

    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [d for d in near if not any(i and 100 * len(i & grams(d["text"])) >= 80 * len(i) for i in items)]
    assert sorted(want, key=lambda d: d["doc_id"]) == sorted(clean, key=lambda d: d["doc_id"])
    assert len(clean) < len(near)

    import public_tokenizers

    enc = encoder(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert {t["doc_id"]: t["ids"] for t in tokens} == {d["doc_id"]: enc.encode_ordinary(d["text"]) for d in clean}


def test_run_chains_the_stages(spark, stages):
    got = {r.doc_id: r.ids_sha256 for r in cp.run(spark, SF).collect()}
    assert got == {t["doc_id"]: t["ids_sha256"] for t in stages[-1]}


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "alone here", None, None, None, "n"), (None, None, None, None, None, None), (1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "x"), (2, text + " w", None, "b", 2, None), (None, text, None, None, 3, None)]
    docs = spark.createDataFrame(rows, schema)
    exact = cp.exact(spark, docs, SF)
    assert exact.columns == docs.columns and exact.count() == 4
    near = cp.near(spark, exact, SF)
    assert sorted((r.doc_id, r.text) for r in near.filter("doc_id IS NOT NULL").collect()) == [(1, text)]
    assert near.filter("doc_id IS NULL").count() == 2
    assert cp.decontaminate(spark, near, SF).count() == 3
    assert cp.tokens(spark, near, SF).filter(F.col("n_tokens") == 0).count() == 1
    assert cp.quality(spark, docs, SF).columns == docs.columns
    for _, stage in cp.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_rows_without_or_with_a_shared_identifier_are_told_apart(spark):
    say = lambda name: " ".join(f"{name}{i}" for i in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, f"{say('a')} {item}"), (None, say("b")), (5, f"{say('c')} {item}"), (5, say("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in cp.decontaminate(spark, docs, SF).collect()} == {rows[1], rows[3]}
    rows = [(None, say("a")), (1, say("b")), (None, say("b") + " x"), (2, say("c")), (7, say("c") + " x"), (7, say("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in cp.near(spark, docs, SF).collect()} == {rows[0], rows[1], rows[3], rows[5]}


def test_columns_of_any_name_and_ties(spark):
    names = ["score", "key", "_key", "key_", "kept_id", "found_id", "node", "row", "order", "a.b", "row_id", "text_sha256", "text_hash", "component_id", "id", "label", "h"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in names]])
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(d, t, *[f"{n}{x}" for n in names]) for d, t, x in ((1, text, "b"), (1, text, "a"), (2, text + " x", "c"), (None, text + " y", "d"), (3, "something else", "e"), (4, None, "f"))]
    docs = spark.createDataFrame(rows, schema)
    exact = cp.exact(spark, docs, SF)
    assert exact.columns == docs.columns and sorted(map(tuple, exact.collect()), key=str) == sorted(rows[1:], key=str)
    near = cp.near(spark, exact, SF)
    assert near.columns == docs.columns and sorted(map(tuple, near.collect()), key=str) == sorted([rows[1], rows[4], rows[5]], key=str)
    assert sorted(map(tuple, cp.decontaminate(spark, near, SF).collect()), key=str) == sorted(map(tuple, near.collect()), key=str)
    assert cp.quality(spark, docs, SF).columns == docs.columns and cp.quality(spark, docs, SF).count() in range(7)
    assert cp.tokens(spark, near, SF).count() == 3


def test_one_of_near_copies_without_identifiers_stays(spark):
    say = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, say("a")), (None, say("a") + " x"), (None, say("b")), (7, say("c")), (7, say("c") + " x"), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in cp.near(spark, docs, SF).collect()]
    assert sorted((t or "")[:2] for t in got) == ["", "", "a0", "b0", "c0"]
