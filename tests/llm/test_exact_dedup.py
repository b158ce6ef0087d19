import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.llm import exact_dedup as exact_dedup_module
from skeinflow.llm.exact_dedup import exact_dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("piece", [100_000, 3])
def test_matches_brute_force(spark, monkeypatch, keep, parts, piece):
    monkeypatch.setattr(exact_dedup_module, "PIECE_ROWS", piece)
    monkeypatch.setattr(exact_dedup_module, "BROADCAST_RUNS", piece // 10)
    rng = random.Random(parts)
    rows = [(i, rng.choice(["hot"] * 30 + [None, "", " ", "é", "x" * 100 + str(rng.randrange(3)), str(rng.randrange(40))]), 1) for i in range(300)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.row_id: r for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, piece int"), keep=keep).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(text or "", []).append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        best = max(ids) if keep == "largest" else min(ids)
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_null_and_repeated_identifiers(spark, keep):
    rows = [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b")] * 20
    got = exact_dedup(spark.createDataFrame(rows, "doc_id int, text string"), keep=keep).collect()
    assert len(got) == 120 and sum(r.kept for r in got) == 2
    assert {(r.keep_id, r.group_size) for r in got} == {(3, 80), (None, 40)}
    assert [r.row_id for r in got if r.kept and r.keep_id == 3] == [3]


def test_empty_table_and_normalising(spark):
    df = spark.createDataFrame([("b", "A"), ("a", "a ")], "doc_id string, text string")
    assert exact_dedup(df.filter("false")).collect() == []
    assert {(r.row_id, r.keep_id) for r in exact_dedup(df, normalise=lambda c: F.lower(F.trim(c))).collect()} == {("a", "a"), ("b", "a")}


@pytest.mark.parametrize("parts", [1, 3])
def test_texts_with_one_hash_across_partitions(spark, monkeypatch, parts):
    """Texts of one head and, here, one hash alternate over partitions; whole texts decide all the same."""
    monkeypatch.setattr(exact_dedup_module.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    head = "h" * 64
    rows = [(i, head + str(i % 3)) for i in range(90)] + [(100, "z"), (101, "a")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.row_id: (r.keep_id, r.group_size) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: (i % 3, 30) for i in range(90)} | {100: (100, 1), 101: (101, 1)}
