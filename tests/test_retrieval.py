"""Encoder, retrieval with filters, answers and their audit."""

import base64
from datetime import date

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from skeinflow.functions import encoder
from skeinflow.functions.text import token_chunks
from skeinflow.operators.vectors import cosine_topk, or_zero, pack_vector, unpack_vector
from skeinflow.plans import retrieval

QUESTION = "query_id long, question string, symbol string, as_of_date date, source_types array<string>, rung long"


def corpus(spark):
    rows = [("10K-A-1", "A", date(2000, 1, 1), "10K", "supply chain risk"), ("10K-A-2", "A", date(2001, 1, 1), "10K", "supply chain growth"), ("8K-A-1", "A", date(2000, 6, 1), "8K", "new chief officer"), ("10K-B-1", "B", date(2000, 1, 1), "10K", "supply chain risk"), ("10K-B-2", "B", None, "10K", None)]
    df = spark.createDataFrame(rows, "chunk_key string, symbol string, as_of_date date, source_type string, body_chunk string")
    return df.withColumn("embedding", encoder.encode(F.col("body_chunk")))


def test_encoder(spark):
    texts = ["Supply  chain\trisk", "supply chain risk", None, "", "é"]
    got = [np.array(r.v) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(encoder.encode(F.col("t")).alias("v")).collect()]
    assert all(len(v) == encoder.DIMS for v in got)
    assert (got[0] == got[1]).all() and abs(np.linalg.norm(got[0]) - 1) < 1e-12 and not got[2].any() and not got[3].any() and got[4].any()
    other = spark.createDataFrame([("x",)], "t string").select(encoder.encode(F.col("t"), lambda texts: np.ones((len(texts), 2))).alias("v"))
    assert other.first().v == [1.0, 1.0]
    assert spark.createDataFrame([], "t string").select(encoder.encode(F.col("t"))).collect() == []


def test_packing(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0]), (2, None), (3, []), (4, [float("nan")])], "i int, v array<float>")
    packed = df.select("i", pack_vector("v").alias("b"))
    assert [r.b for r in packed.orderBy("i").collect()][:3] == [np.array([0.5, -1.0], "<f4").tobytes(), None, b""]
    back = {r.i: r.v for r in packed.select("i", unpack_vector("b").alias("v")).collect()}
    assert back[1] == [0.5, -1.0] and back[2] is None and back[3] == [] and np.isnan(back[4][0])
    assert df.filter("i = 2").select(or_zero(F.col("v"), 3).alias("z")).first().z == [0, 0, 0]


def test_each_question_has_its_own_filters(spark):
    asked = [(1, "supply chain risk", "A", date(2000, 12, 31), None, 2), (2, "supply chain risk", None, None, None, 2), (3, "supply chain risk", "A", None, ["8K"], 2), (4, "x", "Z", None, None, 2), (5, "risk", "B", date(1999, 1, 1), None, 2), (6, "risk", None, date(2000, 1, 1), ["10K", "8K"], 2)]
    got = {}
    for r in retrieval.retrieve(spark.createDataFrame(asked, QUESTION), corpus(spark), 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == {1: ["10K-A-1", "8K-A-1"], 2: ["10K-A-1", "10K-B-1"], 3: ["8K-A-1"], 6: ["10K-A-1", "10K-B-1"]}


def test_top_k_against_brute_force(spark, monkeypatch):
    from skeinflow.operators import vectors

    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-2, 3, 3)).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, v array<double>").repartition(5)
    asked = df.filter("i % 30 = 0")
    for cells, queries in ((1 << 22, 20_000), (20, 3)):
        monkeypatch.setattr(vectors, "CELLS", cells)
        monkeypatch.setattr(vectors, "QUERIES", queries)
        got = {(r.query_id, r["rank"]): r.item_id for r in cosine_topk(asked, df, "i", "v", 7).collect()}
        unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
        for i, v in rows:
            if i % 30 == 0:
                best = sorted(rows, key=lambda r: (-round(float(unit(v) @ unit(r[1])), 9), r[0]))[:7]
                assert [got[i, n + 1] for n in range(7)] == [r[0] for r in best]


def test_answers_and_audit(spark, tmp_path):
    asked = spark.createDataFrame([(1, "supply chain risk", "A", date(2000, 12, 31), None, 2), (2, "x", "Z", date(2000, 1, 1), None, 1), (3, "officer", "A", date(2000, 12, 31), None, 1)], QUESTION)
    preds = spark.createDataFrame([("A", date(2000, 12, 31), 2, 0.714, 1, '{"roe": 0.125, "bb_z": -0.3}')], "symbol string, trade_date date, model_rung long, prob_up double, predicted_class int, attributions string")
    got = {r.query_id: r for r in retrieval.answers(asked, corpus(spark), preds, 2).collect()}
    assert got[1].source == "template-fallback" and got[1].top_k_chunk_ids == ["10K-A-1", "8K-A-1"]
    assert "A UP on 2000-12-31 with probability 0.71" in got[1].response and "[10K-A-1] sim=1.000: supply chain risk..." in got[1].response
    assert "  - bb_z: -0.3000\n  - roe: +0.1250" in got[1].prompt and "goes UP" in got[1].prompt
    assert got[3].prompt.count("no attribution") == 1 and "probability 0.50" in got[3].prompt
    assert got[2].source == "no-retrieval" and got[2].prompt is None and got[2].top_k_chunk_ids == [] and (got[2].tokens_in, got[2].latency_ms) == (0, 0) and "Z up to 2000-01-01" in got[2].response

    def model(prompt):
        if "officer" in prompt.split("Question: ")[1]:
            raise RuntimeError("no credit" * 100)
        return "because", 10, 3

    given = retrieval.answers(asked, corpus(spark), preds, 2, generator=model, model="m")
    rows = {r.query_id: r for r in given.collect()}
    assert (rows[1].source, rows[1].response, rows[1].tokens_in, rows[1].tokens_out, rows[1].llm_model) == ("model", "because", 10, 3, "m")
    assert rows[3].source == "template-fallback" and len(rows[3].error) == 200 and rows[2].source == "no-retrieval"
    path = str(tmp_path / "audit")
    retrieval.log_queries(given, path)
    retrieval.log_queries(given, path)
    log = spark.read.parquet(path)
    assert log.count() == 4 and log.select("query_key").distinct().count() == 4 and {r.question for r in log.collect()} == {"supply chain risk", "officer"}


def test_corpora_are_kept(spark, tmp_path):
    path = str(tmp_path / "c")
    corpus(spark).write.parquet(path)
    one = retrieval.load_corpus(spark, path)
    assert retrieval.load_corpus(spark, path) is one and one.is_cached and one.count() == 5
    retrieval.forget_corpora()
    assert retrieval.load_corpus(spark, path) is not one
    retrieval.forget_corpora()


def test_sentiment_by_a_model(spark):
    from skeinflow.functions.text import model_sentiment

    def make():
        return lambda texts: [(0.1, 0.2, 0.7) if "up" in t else (0.0, float(len(t.split()) == 512), 0.0) for t in texts]

    rows = [(1, "up"), (2, " "), (3, None), (4, "w " * 600)]
    got = {r.i: tuple(r.s) for r in spark.createDataFrame(rows, "i int, t string").select("i", model_sentiment(F.col("t"), make).alias("s")).collect()}
    assert got == {1: (0.7, 0.2, 0.1, 0.6), 2: (0, 1, 0, 0), 3: (0, 1, 0, 0), 4: (0, 1, 0, 0)}


def test_evaluation(spark, tmp_path):
    path = tmp_path / "set.jsonl"
    path.write_text('{"question": "supply chain risk", "symbol": "A", "as_of_date": "2000-12-31", "expected_substring": "8K-A"}\n\n{"question": "supply", "symbol": "B", "expected_substring": "10K-B-"}\n{"question": "none", "symbol": "Z", "expected_substring": "x"}\n')
    asked = retrieval.evaluation_set(spark, str(path))
    found = retrieval.retrieve(asked, corpus(spark), 5)
    scored = {r.query_id: (r.rr, r.precision, r.n_hits) for r in retrieval.scored_questions(found, asked.select("query_id", "expected_substring"), 5).collect()}
    names = {r.question: r.query_id for r in asked.collect()}
    assert scored == {names["supply chain risk"]: (0.5, 0.2, 1), names["supply"]: (1.0, 0.2, 1) if found.filter(F.col("query_id") == names["supply"]).count() == 1 else (1.0, 0.4, 2), names["none"]: (0.0, 0.0, 0)}
    total = retrieval.summary(retrieval.scored_questions(found, asked.select("query_id", "expected_substring"), 5)).first()
    assert total.n_queries == 3 and abs(total.mrr - 0.5) < 1e-9


def test_token_chunks(spark):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines())}, special_tokens={})
    texts = {1: "word " * 1200, 2: "é" * 700, 3: " ", 4: None, 5: "a" * 3, 6: "one two " * 30}
    df = spark.createDataFrame(list(texts.items()), "i int, t string")
    got = {}
    for r in token_chunks(df, "t", ranks, public_tokenizers.PATTERN).orderBy("i", "chunk_index").collect():
        got.setdefault(r.i, []).append((r.chunk_index, r.n_tokens, r.body_chunk))
    want = {}
    for i, text in texts.items():
        ids = enc.encode_ordinary(text) if text and text.strip() else []
        for at in range(0, len(ids), 450):
            part = ids[at : at + 500]
            if len(part) < 50:
                break
            want.setdefault(i, []).append((at // 450, len(part), enc.decode(part)))
    assert got == want and set(got) >= {1, 6}


def test_token_chunks_of_very_long_white_space(spark):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    text = "x" + " " * 1_000_000 + "y"
    rows = token_chunks(spark.createDataFrame([(1, text)], "i int, t string"), "t", ranks, public_tokenizers.PATTERN, size=500, overlap=0, least=1).orderBy("chunk_index").collect()
    assert "".join(r.body_chunk for r in rows) == text


def test_other_patterns_go_to_the_library_whole():
    from skeinflow.functions import bytepairs

    tokens = [bytes([i]) for i in range(256)] + [b"!\n", b"  "]
    ranks = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    pattern = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    enc = bytepairs.encoder(ranks, pattern)
    assert bytepairs.encode(enc, "!\n" * 40_000) == enc.encode_ordinary("!\n" * 40_000) == [256] * 40_000
    ids = bytepairs.encode(enc, "x" + " " * 1_000_000 + "y")  # more than the library's engine matches
    assert enc.decode_bytes(ids) == b"x" + b" " * 1_000_000 + b"y"


def test_workers_hold_bounded_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    def wide(texts):
        assert len(texts) <= encoder.ROWS
        sizes.add(1)
        return np.ones((len(texts), 2))

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    df = spark.range(6000, numPartitions=1).select("id", encoder.encode(F.repeat(F.lit("x"), 2000), wide).alias("v"))
    assert df.agg(F.count("v").alias("n"), F.sum(F.element_at("v", 1)).alias("s")).first() == (6000, 6000.0) and sizes.value >= 6000 / encoder.ROWS
    asked = df.filter("id < 3")
    before = sizes.value
    found = cosine_topk(asked, df, "id", "v", 2)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # vectors are computed once, not for a filter too
    assert found.count() == 6 and sizes.value > before


def test_chunk_vectors_are_computed_once(spark):
    from skeinflow.plans.catalog import QUERIES

    plan = QUERIES["chunk_embeddings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # one for each kind of document


def test_texts_of_found_chunks_need_no_shuffle_of_the_corpus(spark, monkeypatch):
    known = spark.createDataFrame([], "symbol string, trade_date date, model_rung long, prob_up double, predicted_class long, attributions string")
    asked = spark.createDataFrame([(1, "supply chain risk", "A", date(2000, 12, 31), None, 2), (2, "x", "Z", None, None, 2)], QUESTION)
    given, threshold = {}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (100_000, 0):
            monkeypatch.setattr(retrieval, "BROADCAST_FOUND", most)
            df = retrieval.answers(asked, corpus(spark), known, 2)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin [item_id" in plan) == (most > 0)
            given[most] = sorted(map(str, df.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert given[0] == given[100_000] and len(given[0]) == 2
