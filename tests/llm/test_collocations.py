import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from skeinflow.llm import collocations as module


def brute(rows, least, top, most=5):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= least]
        kept = []
        for p in found:
            inside = any(len(q) > len(p) and f[q] >= f[p] and any(q[i : i + len(p)] == p for i in range(len(q))) for q in found)
            if not inside:
                score, k = min((1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(rng, n):
    words = ["the", "New", "york", "times", "of", "été", "naïve", "a\x01", "b", "x" * 300, *[f"rare{i}" for i in range(60)]]
    rows = [(None, None), ("en", None), ("en", ""), ("fr", " \t ... \n"), (None, "the the the the the the the"), ("und", "the the, the")]
    for i in range(n):
        text = []
        for _ in range(rng.randrange(40)):
            text.append(rng.choice(words[:10]) if rng.random() < 0.8 else rng.choice(words))
            text.append(rng.choice([" ", " ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b", " ; "]))
            if rng.random() < 0.2:
                text.append("The New  York\ttimes of ")
        rows.append((rng.choice(["en", "en", "en", "fr", None]), "".join(text)))
    return rows


def answer(spark, rows, **options):
    df = spark.createDataFrame([(i, lang, text, "x", 7) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    return sorted(tuple(r) for r in module.collocations(df, **options).collect())


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
@pytest.mark.parametrize("sizes", ["whole", "small"])
def test_matches_brute_force(spark, monkeypatch, broadcast, sizes):
    monkeypatch.setattr(module, "BROADCAST_WORDS", broadcast)
    if sizes == "small":
        monkeypatch.setattr(module, "FLUSH", 200)
        monkeypatch.setattr(module, "RANGE", 300)
        monkeypatch.setattr(module, "SAMPLE", 500)
        monkeypatch.setattr(module, "PIECE", 11)
        monkeypatch.setattr(module, "COUNT_WORDS", 5)
    rows = corpus(random.Random(1), 250)
    for least, top in ((5, 40), (2, 100_000)) if sizes == "small" else ((3, 1000),):
        assert answer(spark, rows, min_count=least, top=top) == brute(rows, least, top)


def test_many_words_take_two_digits(spark, monkeypatch):
    """Numbers past 16 bits, and phrases that differ in the higher digit alone."""
    words = [f"w{i}" for i in range(70_000)]
    rows = [("en", " ".join(words)), ("en", " ".join(words)), ("en", " ".join(reversed(words[:500])))]
    got = answer(spark, rows, min_count=2, top=10, max_words=2)
    want = sorted((-(1000 * 2 * 140_500 // ((3 if i < 500 else 2) * (3 if i + 1 < 500 else 2))), f"w{i} w{i + 1}") for i in range(69_999))
    assert [(r[2], r[7]) for r in got] == [(p, -s) for s, p in want[:10]]


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(10**13 - 7, 10**14 + 3, 10**13 - 1, 10**13 - 3)], "a long, n long, l long, r long")
    wide = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    got = df.selectExpr(f"({wide('a')} * {wide('n')} * CAST(1000 AS DECIMAL(4, 0))) div ({wide('l')} * {wide('r')}) AS s").first().s
    assert got == 1000 * (10**13 - 7) * (10**14 + 3) // ((10**13 - 1) * (10**13 - 3))


def packed(rng, pool, rows, n):
    """Packed rows of one range, each of n draws from a pool of keys."""
    for _ in range(rows):
        keys, counts = module._runs(pool[rng.integers(0, len(pool), n)], np.ones(n, np.uint32))
        columns = [[7], [len(keys)], [keys.T.tobytes()], [counts.astype(np.uint32).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "n", "keys", "counts"])


def test_a_range_that_repeats_is_held_merged():
    """A range far above the usual size: 7 million counted keys, of which 400,000 differ."""
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 60_000, (400_000, 5)).astype(np.uint16)
    tracemalloc.start()
    try:
        found = [pc.sum(b.column(1).filter(pc.equal(pc.binary_length(b.column(0)), 10))).as_py() for b in module._merged(1, 5, 1)(packed(rng, pool, 27, 400_000))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == [27 * 400_000]
    assert peak < 330e6, peak


def test_empty_table(spark):
    assert answer(spark, []) == []
    assert answer(spark, [("en", "one two three")]) == []


def test_sql_matches_brute_force():
    rows = corpus(random.Random(2), 300)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    sql = module.OP11_SQL.replace(">= 100", ">= 4")
    assert sorted(con.execute(sql).fetchall()) == brute(rows, 4, 2000)
