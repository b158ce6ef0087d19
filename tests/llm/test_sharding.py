import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skeinflow.llm.sharding import jump_hash, shard_rows


def reference(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    rng = random.Random(0)
    keys = [rng.getrandbits(64) for _ in range(500)] + list(range(500))
    for n in (1, 2, 8, 9, 1000):
        assert jump_hash(np.array(keys, np.uint64), n).tolist() == [reference(k, n) for k in keys]
    with pytest.raises(ValueError):
        jump_hash(np.zeros(1, np.uint64), 0)


def test_rows(spark):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7), 1) for i in range(-20, 1000)] + [(None, "n", 1), (5, "again", 1), (5, "again", 1)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5), 8).collect()
    assert len(got) == len(rows)
    for r in got:
        key = (r.row_id or 0) % 2**64
        assert (r.shard, r.grown_shard, r.law) == (reference(key, 8), reference(key, 9), "key")
        assert r.grown_shard in (r.shard, 8)
    texts = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.row_id, r["size"], r.text_crc32) for r in got) == texts
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_other_keys_and_empty_table(spark):
    df = spark.createDataFrame([("a", "x"), (None, None)], "doc_id string, text string")
    assert {r["size"] for r in shard_rows(df, 3).collect()} == {1, 2}
    assert shard_rows(df.filter("false"), 3).collect() == []
