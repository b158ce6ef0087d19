import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from skeinflow.llm import vector_codes as module


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = len(kept[0][1])
    width = dims // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    least = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in least] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))

    def nearest():
        return [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = nearest()
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes, strict=True)]
    label_sum = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        label_sum[label] = label_sum.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in c), e, label_sum[label]) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=str), digest


def vectors(rng, n, dims, spread=1.0):
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [float(np.float32(x + rng.gauss(0, 0.1 * spread))) for x in rng.choice(centres)]
        rows.append((i * 7 % n, v, rng.choice([None, 1, 2, 2, 2])))
    rows += [(n, None, 1), (n + 1, [None] + [0.5] * (dims - 1), 1), (n + 2, [math.nan] * dims, 1), (n + 3, [math.inf] + [0.0] * (dims - 1), None), (None, [0.25] * dims, None)]
    return rows + [(3, [0.5] * dims, 2), (n + 4, [-0.0] * dims, 1), (n + 5, rows[0][1], 1)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def answer(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], schema + ", code string, error int").repartition(3)
    found, books, compared = module.vector_codes(df, **options)
    got = module.label_errors(found).collect()
    return sorted(((r.row_id, r.code, r.error, r.label_error) for r in got), key=str), module.codebook_digest(books), compared


@pytest.mark.parametrize(("block", "labels"), [(4096, 100_000), (7, 0)])
def test_matches_brute_force(spark, monkeypatch, block, labels):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "BROADCAST_LABELS", labels)
    rows = vectors(random.Random(1), 300, 32)
    got, digest, compared = answer(spark, rows)
    assert (got, digest) == brute(rows)
    assert compared[0] == 16 * len(got) and compared[2] < compared[1] < compared[0]  # heaps leave most parts alone


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_rounds_and_large_components(spark, rounds):
    """Components near the limit, where distances pass what floating point holds exactly."""
    rows = vectors(random.Random(2), 150, 8, spread=module.limit(8) / 256 / 10)
    got, digest, _ = answer(spark, rows, parts=4, entries=9, rounds=rounds)
    assert (got, digest) == brute(rows, 4, 9, rounds)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 4)] * 16, None) for i in range(40)] + [(100 + i, [0.5 + i % 3] * 16, 7) for i in range(60)]
    got, digest, _ = answer(spark, rows, entries=8)
    assert (got, digest) == brute(rows, entries=8)


def test_few_none_and_refused(spark):
    rows = [(5, [0.5] * 16, 1), (4, [0.25] * 16, None)]
    got, digest, _ = answer(spark, rows)
    assert (got, digest) == brute(rows)
    assert answer(spark, [(1, None, 2)])[0] == []
    assert answer(spark, [])[0] == []
    with pytest.raises(ValueError, match="cut"):
        answer(spark, [(1, [0.5] * 15, 2)])
    with pytest.raises(ValueError, match="length"):
        answer(spark, [(1, [0.5] * 16, 2), (2, [0.5] * 32, 2)])
    with pytest.raises(ValueError, match="64 bits"):
        answer(spark, [(i, [0.5] * 16, 2) for i in range(70)] + [(99, [-1e30] * 16, 2)])
    with pytest.raises(ValueError, match="64 bits"):
        answer(spark, [(1, [1e30] * 16, 2)])


def test_drift_bounds_every_way():
    rng = np.random.default_rng(3)
    before = rng.integers(-500, 500, (4, 9, 3))
    after = before + rng.integers(-40, 40, before.shape)
    points = rng.integers(-600, 600, (400, 3))
    drift = module._drift(before, after)
    for p in range(4):
        code, key = module._nearest(points, before[p])
        heaps = module.Heaps.of(code, key)
        stay = np.ones(len(points), bool)
        stay[heaps.pop(drift[p])] = False
        assert np.array_equal(module._nearest(points, after[p])[0][stay], code[stay]) and stay.any()


def test_sql_matches_brute_force():
    rows = [r for r in vectors(random.Random(4), 200, 32) if r[0] not in (None, 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    want, digest = brute(rows)
    assert sorted((tuple(r) for r in con.execute(module.OP13_SQL).fetchall()), key=str) == [(*r, digest) for r in want]
