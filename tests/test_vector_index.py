"""The index against the scan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.operators import vector_index as vi
from skeinflow.operators.vectors import cosine_topk


def table(spark, n, dims, seed=1, kind="float"):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + rng.normal(size=dims) * 0.4).tolist(), i % 5, None if i % 11 == 0 else "ab"[i % 2]) for i in range(n)]
    rows += [(n, [0.0] * dims, 1, "a"), (n + 1, None, 1, "a"), (n + 2, rows[3][1], 1, "a"), (n + 3, rows[3][1], 2, "b")]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, f"id long, v array<{kind}>, g long, s string").repartition(3)


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize(("kind", "lists", "cells"), [("float", None, 1 << 22), ("double", 40, 7), ("float", 1, 50)])
def test_equals_the_scan(spark, tmp_path, monkeypatch, kind, lists, cells):
    monkeypatch.setattr(vi, "CELLS", cells)
    df = table(spark, 600, 16, kind=kind)
    index = vi.VectorIndex.build(df, str(tmp_path / "i"), "id", "v", lists=lists)
    asked = df.filter("id % 20 = 0 OR id >= 600").select("id", "v")
    for k in (1, 5, 700):
        found, saved = index.search(asked, "id", "v", k)
        assert same(found.select("query_id", "item_id", "similarity", "rank"), cosine_topk(asked, df, "id", "v", k))
        assert (saved > 0.3) == (k < 700 and lists != 1)
    assert sum(n for _, _, n in index.edges.values()) == 603


def test_filters(spark, tmp_path):
    df = table(spark, 500, 8, seed=2)
    index = vi.VectorIndex.build(df, str(tmp_path / "i"), "id", "v", filters=["g", "s"])
    asked = df.filter("id % 25 = 0").select("id", "v", F.when(F.col("id") % 2 == 0, F.col("s")).alias("want"))
    rules = {"s": ("equal", "want")}
    found, _ = index.search(asked, "id", "v", 4, rules=rules)
    assert same(found, cosine_topk(asked, df, "id", "v", 4, rules=rules))
    found, _ = index.search(asked, "id", "v", 4, where=F.col("g") == 3)
    assert same(found, cosine_topk(asked, df, "id", "v", 4, where=F.col("g") == 3))
    assert index.search(asked, "id", "v", 4, where=F.lit(False))[0].collect() == []


def test_one_question_on_a_kept_index(spark, tmp_path):
    df = table(spark, 400, 8, seed=3)
    index = vi.VectorIndex.build(df, str(tmp_path / "i"), "id", "v", filters=["g"]).keep()
    for r in df.filter("id IN (7, 130, 400)").collect():
        one = spark.createDataFrame([(r.id, r.v)], "id long, v array<float>")
        for where in (None, F.col("g") == 2):
            want = [(x.item_id, x.similarity) for x in cosine_topk(one, df, "id", "v", 5, where=where).orderBy("rank").collect()]
            assert index.ask(r.v, 5, where) == want
    index.release()


def test_empty_corpus_and_no_queries(spark, tmp_path):
    df = table(spark, 50, 4)
    none = vi.VectorIndex.build(df.filter("false"), str(tmp_path / "n"), "id", "v")
    assert none.search(df.select("id", "v"), "id", "v", 3)[0].collect() == []
    index = vi.VectorIndex.build(df, str(tmp_path / "i"), "id", "v")
    assert index.search(df.filter("false"), "id", "v", 3)[0].collect() == []


def test_an_index_sends_a_bounded_sample_and_computes_vectors_once(spark, tmp_path, monkeypatch):
    from skeinflow.functions.encoder import encode

    seen, fit = [], vi.fit_centroids
    monkeypatch.setattr(vi, "fit_centroids", lambda rows, lists: seen.append(rows.shape) or fit(rows, lists))
    monkeypatch.setattr(vi, "FIT_BYTES", 50 * 8 * 16)
    texts = spark.sparkContext.accumulator(0)

    def counted(given):
        texts.add(len(given))
        return np.array([[np.cos(len(t) * i) for i in range(16)] for t in given]).reshape(-1, 16)

    def rows(n, parts):
        return spark.range(n, numPartitions=parts).select("id", encode(F.repeat(F.lit("x"), F.col("id").cast("int") % 97), counted).alias("v"))

    index = vi.VectorIndex.build(rows(20_000, 40), str(tmp_path / "i"), "id", "v")
    assert index.n == 20_000 and len(seen) == 1 and 10 <= seen[0][0] <= 50
    # once to place them; the length of one comes from the first task, the sample from few rows
    assert texts.value <= 20_000 + 2 * 500 + 200


def test_blocks_of_queries_are_bounded_by_distances(spark, tmp_path, monkeypatch):
    df = table(spark, 300, 8, seed=4)
    index = vi.VectorIndex.build(df, str(tmp_path / "i"), "id", "v", lists=20)
    asked, sizes, held = df.filter("id % 10 = 0").select("id", "v"), [], vi.VectorIndex._asked
    monkeypatch.setattr(vi, "HELD_CELLS", 20 * 12)
    monkeypatch.setattr(vi.VectorIndex, "_asked", lambda self, ids, *rest: sizes.append(len(ids)) or held(self, ids, *rest))
    assert same(index.search(asked, "id", "v", 4)[0].select("query_id", "item_id", "similarity", "rank"), cosine_topk(asked, df, "id", "v", 4))
    assert len(sizes) > 1
