import random
import re

import numpy as np
import pytest

from skeinflow.llm import ngram_join
from skeinflow.llm.hashing import shingles
from skeinflow.llm.ngram_join import class_bounds, jaccard_join, overlaps

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, num, den):
    sets, expected = [], {}
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    for i, (doc, _) in enumerate(rows):
        expected[doc] = (len(sets[i]), least[root(i)] if sets[i] else doc, links[i])
    return expected


def corpus(seed, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 6, 9, 12, 20, 60, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, len(copy) // 15)]))
    texts += [None, "", "  \n\t ", "One", "one", "ONE  two", "é " * 3, "x" * 70_000, "x" * 70_000 + " y"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 80, 100)])
@pytest.mark.parametrize("blocks", [False, True])
def test_matches_brute_force(spark, monkeypatch, k, num, den, blocks):
    if blocks:
        for name, value in {"BLOCK_SETS": 2, "FRAGMENT_GRAMS": 30, "TIE_SETS": 2, "CHUNK": 3, "OUT_BYTES": 500}.items():
            monkeypatch.setattr(ngram_join, name, value)
        monkeypatch.setattr(ngram_join, "BROADCAST_TASKS", 0)
    rows = corpus(k)
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, node string, cluster int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(df, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_empty_table_and_null_identifiers(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in jaccard_join(df).collect()), key=str)
    assert got == [(4, 4, 2), (4, 4, 2), (None, 4, 2), (None, None, 0)]


def test_linked_sizes_are_in_adjacent_classes():
    for num in (80, 90, 95):
        bounds = class_bounds(num, 100)
        for small in range(1, 3000):
            large = small * 100 // num
            a, b = np.searchsorted(bounds, [small, large], "right")
            assert b - a <= 1


def test_overlaps_sum_columns(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 8)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    got = overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))
    assert (overlaps(sets[:20], sets[20:]) == got[:20, 20:]).all()


@pytest.mark.parametrize("fragment", [1 << 19, 5000])
def test_long_sets_at_a_high_threshold(spark, monkeypatch, fragment):
    monkeypatch.setattr(ngram_join, "FRAGMENT_GRAMS", fragment)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    rows = [(1, " ".join(base)), (4, "other " * 50)]
    for doc, changes in ((2, 20), (3, 35), (5, 45), (6, 400)):
        copy = list(base)
        for at in rng.sample(range(len(copy)), changes):
            copy[at] = f"x{doc}_{at}"
        rows.append((doc, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 99, 100).collect()}
    want = brute(rows, 3, 99, 100)
    assert got == want and want[2][2] > 0 and want[6][2] == 0


def test_wrong_thresholds(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for num in (0, 100, 101):
        with pytest.raises(ValueError):
            jaccard_join(df, 3, num, 100)


@pytest.mark.parametrize("hot", [0, 1_000_000])
def test_components_of_hot_centres_and_chains(spark, monkeypatch, hot):
    from skeinflow.llm import components as c

    monkeypatch.setattr(c, "HOT_FROM", hot)
    rows = [(5000, i) for i in range(5001, 7000)] + [(i, i + 1) for i in range(100, 160)] + [(7000, 6000), (9, 9), (20, 21), (21, 20)]
    got = {r.node: r.component for r in c.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 5000 for i in range(5000, 7001)} | {i: 100 for i in range(100, 161)} | {9: 9, 20: 20, 21: 20}
    assert c.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hashes_do_not_depend_on_neighbours(monkeypatch):
    from skeinflow.llm import hashing

    monkeypatch.setattr(hashing, "PIECE", 1 << 17)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "c", "déf", "x" * rng.choice([1, 70_000])]) for _ in range(30)).encode() for _ in range(20)]
    together = [g.tolist() for _, g in shingles(texts, 3)]
    alone = [next(shingles([t], 3))[1].tolist() for t in texts]
    assert together == alone


def test_texts_linked_only_through_a_null_identifier(spark):
    words = [f"w{i}" for i in range(110)]
    texts = [" ".join(words[i : i + 100]) for i in (0, 5, 10)]
    rows = [(3, texts[0]), (None, texts[1]), (None, texts[1]), (8, texts[2]), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in jaccard_join(df, 3, 90, 100).collect()), key=str)
    assert got == [(3, 3, 2), (8, 3, 2), (None, 3, 3), (None, 3, 3), (None, None, 0)]


def test_a_component_is_known_by_one_row(spark):
    words = [f"w{i}" for i in range(110)]
    texts = [" ".join(words[i : i + 100]) for i in (0, 5, 10)]
    rows = [(3, texts[0]), (3, texts[1]), (None, texts[2]), (None, "z"), (None, "z"), (None, None), (8, "q")]
    found = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, with_hash=True).collect()
    firsts = [r for r in found if r.doc_id == r.component_id and r.text_hash == r.component_hash]
    assert sorted(str(r.doc_id) for r in firsts) == ["3", "8", "None", "None", "None"]
    assert len({(r.component_id, r.component_hash) for r in found}) == 4


@pytest.mark.parametrize("chunk", [3, 1 << 18])
@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_groups_of_long_segments_are_streamed(monkeypatch, chunk, size):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = random.Random(size)
    rows = sorted((sig, rng.randrange(40)) for sig, n in enumerate([1, 2, 30, 1, 3, 25, 2]) for _ in range(n))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + size]], pa.int64()) for i in (0, 1)], names=["sig", "node"]) for at in range(0, len(rows), size)]
    found = {}
    for batch in ngram_join._groups(iter(batches)):
        for group, node in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            found.setdefault(group, set()).add(node)
    want = [frozenset(n for s, n in rows if s == sig) for sig in range(7)]
    # a group of one node ties nothing, whether it is passed on or not
    assert {frozenset(g) for g in found.values() if len(g) > 1} == {w for w in want if len(w) > 1}
    assert list(ngram_join._groups(iter([])))[0].num_rows == 0
