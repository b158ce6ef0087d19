"""The learnt encoder: against a dense factorisation, and on paraphrases that share no word."""

import random

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinflow.functions import text as txt
from skeinflow.functions.encoder import encode, encode_halves, hashed
from skeinflow.ml import word_vectors as wv
from skeinflow.operators import vectors as vec
from skeinflow.operators.metrics import reciprocal_rank
from skeinflow.operators.vectors import cosine_topk, own_ranks

#: Pairs of words that are said in each other's place.
ALIKE = [("profit", "earnings"), ("rose", "climbed"), ("fell", "dropped"), ("bank", "lender"), ("staff", "employees"), ("plant", "factory"), ("ship", "vessel"), ("price", "cost"), ("big", "large"), ("quick", "fast"), ("begin", "start"), ("car", "vehicle"), ("buy", "purchase"), ("firm", "company"), ("city", "town"), ("rain", "drizzle")]


def sentences(rng, n):
    """Texts on a few themes, in which either word of a pair is used."""
    themes = [rng.sample(range(len(ALIKE)), 4) for _ in range(24)]
    out = []
    for i in range(n):
        theme = themes[i % len(themes)]
        out.append((i, i % len(themes), " ".join(rng.choice(ALIKE[rng.choice(theme)] if rng.random() < 0.8 else ("the", "of", "and", "a")) for _ in range(14))))
    return themes, out


def mrr(spark, queries, texts, encoder):
    asked = spark.createDataFrame(queries, "id long, theme long, text string").withColumn("v", encode(F.col("text"), encoder))
    corpus = spark.createDataFrame(texts, "id long, theme long, text string").withColumn("v", encode(F.col("text"), encoder))
    found = cosine_topk(asked, corpus, "id", "v", 10).join(asked.select(F.col("id").alias("query_id"), F.col("theme").alias("want")), "query_id")
    hits = found.join(corpus.select(F.col("id").alias("item_id"), "theme"), "item_id").withColumn("hit", F.col("theme") == F.col("want"))
    return reciprocal_rank(hits, "query_id", "rank", "hit", 10).agg(F.avg("rr")).first()[0]


def test_paraphrases_beat_hashed_words(spark):
    rng = random.Random(3)
    themes, rows = sentences(rng, 1500)
    model = wv.fit(spark.createDataFrame(rows, "id long, theme long, text string").repartition(4), dims=16, least=3)
    # held out: texts of first words only, asked for by second words only
    texts = [(i, t, " ".join(ALIKE[p][0] for p in themes[t] for _ in range(2))) for i, t in enumerate(range(len(themes)))]
    queries = [(i, t, " ".join(ALIKE[p][1] for p in rng.sample(themes[t], 3))) for i, t in enumerate(list(range(len(themes))) * 2)]
    learnt, plain = mrr(spark, queries, texts, model.encoder(spark)), mrr(spark, queries, texts, hashed)
    assert learnt > 0.7 and learnt > plain + 0.3, (learnt, plain)


def test_vectors_match_a_dense_factorisation(spark, monkeypatch):
    monkeypatch.setattr(wv, "HELD", 50)
    monkeypatch.setattr(wv, "BLOCK", 7)
    _, rows = sentences(random.Random(4), 200)
    texts = [t for _, _, t in rows] + [None, ""]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, word int").repartition(3)
    model = wv.fit(df, dims=40, least=2)  # as many directions as words: nothing is left to chance
    names = list(model.places)
    counts = np.zeros((len(names), len(names)))
    for t in texts:
        ids = [model.places[w] for w in wv.words_of(t) if w in model.places]
        for i, a in enumerate(ids):
            for b in ids[i + 1 : i + 1 + wv.WINDOW]:
                counts[a, b] += 1
                counts[b, a] += a != b
    seen = counts.sum(axis=1)
    evened = seen**wv.EVEN
    evened *= seen.sum() / evened.sum()
    with np.errstate(divide="ignore"):
        one = np.maximum(np.log(counts * seen.sum() / np.outer(seen, evened)), 0)
    values, axes = np.linalg.eigh((one + one.T) / 2)
    order = np.argsort(-np.abs(values))
    want = (axes[:, order] * np.sqrt(np.abs(values[order])))
    share = np.array([sum(wv.words_of(t).count(w) for t in texts) for w in names], float)
    share /= share.sum()
    weighted = want * (wv.HALF / (wv.HALF + share))[:, None]
    got = model.weighted.astype(float)
    # the same up to turns within the subspace: all inner products agree
    assert np.abs(got @ got.T - weighted @ weighted.T).max() < 1e-5 * np.abs(weighted @ weighted.T).max()


def test_empty_corpora_and_texts(spark):
    none = wv.fit(spark.createDataFrame([(None,), ("one word",)], "text string"))
    assert not none(["one", ""]).any()
    model = wv.fit(spark.createDataFrame([("a b c d",)] * 10, "text string"), dims=3)
    assert model(["", "zz"]).any() == 0 and model(["a b"]).shape == (1, 3)


@pytest.mark.parametrize("sizes", ["whole", "small"])
def test_own_ranks_are_those_of_the_nearest(spark, monkeypatch, sizes):
    """With ties, copies and vectors without a direction; queries that first items settle, and others."""
    if sizes == "small":
        for name, size in (("FIRST", 5), ("QUERIES", 11), ("CELLS", 64)):
            monkeypatch.setattr(vec, name, size)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        v = rng.integers(-1, 2, 4).astype(float)
        q = v + rng.normal(0, 0.2, 4) if i % 3 else v
        rows.append((i * 7 % 400, [0.0] * 4 if i % 41 == 0 else q.tolist(), v.tolist()))
    rows.append((None, [1.0, 0.0, 0.0, 0.0], [0.01, 0.0, 1.0, -5.0]))
    df = spark.createDataFrame(rows, "id long, q array<double>, v array<double>").repartition(3)
    got = {r.query_id: r["rank"] for r in own_ranks(df, "id", "q", "v", 10, F.col("id") % 4 == 0).collect()}
    near = cosine_topk(df.filter("id % 4 = 0").select("id", F.col("q").alias("v")), df.fillna(-1, ["id"]), "id", "v", 10).filter("query_id = item_id").collect()
    assert len(got) == 100 and {q: r for q, r in got.items() if r is not None} == {r.query_id: r["rank"] for r in near}
    assert own_ranks(df.filter("false"), "id", "q", "v", 10, F.col("id") % 4 == 0).collect() == []


def test_settled_queries_are_asked_no_further(monkeypatch):
    """Queries with k items before their own one don't meet the rest, so work doesn't grow with queries times items."""
    rng = np.random.default_rng(6)
    items, queries = rng.normal(size=(20_000, 8)), rng.normal(size=(300, 8))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    own = np.where(np.arange(300) < 6, 1.1, 0.2)  # six keep their place to the end
    cells, whole = [], vec._ahead
    monkeypatch.setattr(vec, "_ahead", lambda ids, matrix, own, items, rows: cells.append(len(ids) * len(items)) or whole(ids, matrix, own, items, rows))
    monkeypatch.setattr(vec, "CELLS", 1 << 15)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(items.ravel()), 8).cast(pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000) + 1000), lists], names=["id", "v"])
    shared = SimpleNamespace(value=(np.arange(300), queries, own))
    found = {q: n for b in vec._counted_ahead(shared, 10)(iter([batch])) for q, n in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert sorted(found) == list(range(6, 300)) and min(found.values()) >= 10
    assert sum(cells) < 0.05 * 300 * 20_000


def test_halves_are_encoded_as_columns_are(spark):
    texts = [None, "", " \t\n", "one", "One two\tTHREE  four\r\nfive ", "\u00a0x y\u2003z \u0130 \u03a3\u03a3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = df.select("doc_id", txt.tokens(F.col("text")).alias("w"))
    half = lambda k: F.array_join(F.filter("w", lambda x, i: i % 2 == k), " ")
    model = wv.WordVectors(["one", "two", "five"], np.random.default_rng(1).normal(size=(3, 6)), np.array([5.0, 4.0, 3.0]))
    encoders = {"hashed": hashed, "learnt": model}
    want = words.select("doc_id", *[encode(half(k), e).alias(f"{name}_{k}") for name, e in encoders.items() for k in (0, 1)])
    got = encode_halves(df, "doc_id", "text", encoders)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
