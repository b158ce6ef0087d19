from collections import Counter

import public_tokenizers

from skeinflow.llm import token_counts as tc
from skeinflow.llm.bpe import encoder, read_ranks
from skeinflow.llm.staging import stage_path

COUNTS = "source string, lang string, tokenizer_version string, n_tokens long"


def rows(df):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_signed_batches_and_folding(spark):
    rollup = tc.TokenRollup(spark, stage_path(spark, "test"))
    assert rows(rollup.totals()) == {}
    make = lambda *r: spark.createDataFrame(list(r), COUNTS)
    first = make(("a", "en", "v1", 10), ("a", "en", "v1", 5), (None, "de", "v1", 7), ("b", None, "v2", None))
    assert rollup.commit("1", tc.inserts(first))
    assert not rollup.commit("1", tc.inserts(first))
    want = {("a", "en", "v1"): (2, 15), (None, "de", "v1"): (1, 7), ("b", None, "v2"): (1, 0)}
    assert rows(rollup.totals()) == want
    assert rollup.commit("2", tc.revisions(make(("a", "en", "v1", 10)), make(("a", "en", "v1", 12))))
    assert rollup.commit("3", tc.deletes(make((None, "de", "v1", 7))))
    want = {("a", "en", "v1"): (2, 17), ("b", None, "v2"): (1, 0)}
    assert rows(rollup.totals()) == want
    rollup.fold()
    assert rows(rollup.totals()) == want
    assert not rollup.commit("2", tc.inserts(first))
    assert rollup.commit("", tc.inserts(make(("c", "c", "v1", 1))))
    rollup.fold()
    assert rows(rollup.totals()) == want | {("c", "c", "v1"): (1, 1)}


def test_batch_that_died_is_written_anew(spark):
    rollup = tc.TokenRollup(spark, stage_path(spark, "test"))
    one = spark.createDataFrame([("a", "en", "v", 3)], COUNTS)
    rollup.commit("x", tc.inserts(one))
    from skeinflow.llm.staging import remove

    remove(spark, f"{rollup._batch('x')}/_SUCCESS")
    assert rows(rollup.totals()) == {}
    assert rollup.commit("x", tc.inserts(one))
    assert rows(rollup.totals()) == {("a", "en", "v"): (1, 3)}


def test_query_matches_brute_force(spark):
    got = rows(tc.op1_token_counts(spark, "/root/testdata/sf0.001"))
    want = {}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for version in tc.VERSIONS:
        enc = encoder(read_ranks(public_tokenizers.path(f"{version}.tiktoken")), public_tokenizers.PATTERN)
        n, t = Counter(), Counter()
        for d in docs:
            n[d.source, d.lang] += 1
            t[d.source, d.lang] += len(enc.encode_ordinary(d.text or ""))
        want |= {(*k, version): (n[k], t[k]) for k in n}
    assert got == want


def test_sources_and_languages_can_be_revised(spark):
    rollup = tc.TokenRollup(spark, stage_path(spark, "test"))
    make = lambda *r: spark.createDataFrame(list(r), COUNTS)
    rollup.commit("1", tc.inserts(make(("a", "en", "v", 4), ("a", "en", "v", 6))))
    rollup.commit("2", tc.revisions(make(("a", "en", "v", 6)), make(("b", "de", "v", 6))))
    assert rows(rollup.totals()) == {("a", "en", "v"): (1, 4), ("b", "de", "v"): (1, 6)}
    for n in range(3):
        rollup.fold()
        assert not rollup.commit("1", tc.inserts(make(("a", "en", "v", 4))))
    assert rows(rollup.totals()) == {("a", "en", "v"): (1, 4), ("b", "de", "v"): (1, 6)}


def test_nulls_long_texts_and_clashing_columns(spark):
    long = "word " * 100_000 + " " * 1_000_000
    schema = "doc_id long, source string, lang string, text string, n_tokens int, row_id int, tokenizer_version int, n_docs int"
    docs = spark.createDataFrame([(None, None, None, None, 1, 1, 1, 1), (1, "s", "en", long, 1, 1, 1, 1), (1, "s", "en", long, 1, 1, 1, 1), (2, "s", "en", "", 1, 1, 1, 1)], schema)
    ranks = {"v": read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))}
    got = [tuple(r) for r in tc.count_tokens(docs, ranks, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=str) == sorted([(None, None, None, "v", 0), *[(1, "s", "en", "v", got[1][4])] * 2, (2, "s", "en", "v", 0)], key=str) and got[1][4] > 1_000_000
    assert {r.n_tokens for r in tc.estimate_tokens(docs, ["v"]).collect()} == {0, len(long) // 4}
    none = docs.filter("false")
    assert tc.count_tokens(none, ranks, public_tokenizers.PATTERN).collect() == tc.estimate_tokens(none, ["v"]).collect() == []
