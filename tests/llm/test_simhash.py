import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from skeinflow.llm import golay, simhash


def test_golay_code_is_perfect():
    words = np.arange(1 << golay.BITS, dtype=np.uint32)
    own = golay.own_index(words)
    assert np.array_equal(np.bincount(own), np.full(4096, 2048))  # 1 + 23 + 253 + 1771 words around each codeword


def test_neighbours_share_an_index():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000, dtype=np.uint32)
    own = golay.own_index(words)
    for bit in range(23):
        near = words ^ np.uint32(1 << bit)
        at, index = golay.indices(near)
        hit = np.zeros(len(words), bool)
        hit[at[index == own[at]]] = True
        assert hit.all()


def test_pairs_within_three_bits_meet():
    rng = random.Random(2)
    bits = [[], *[[i] for i in range(64)], *map(list, combinations(range(64), 2)), *[rng.sample(range(64), 3) for _ in range(6000)]]
    one = np.array([rng.getrandbits(64) for _ in bits], np.uint64)
    two = one ^ np.array([sum(1 << b for b in x) for x in bits], np.uint64)

    def meet(a, b):
        own = {}
        for i, key in zip(*(x.tolist() for x in simhash.keys(a, False)), strict=True):
            own.setdefault(i, set()).add(key)
        found = {i for i, key in zip(*(x.tolist() for x in simhash.keys(b, True)), strict=True) if key in own[i]}
        twice = {i for i, key in zip(*(x.tolist() for x in simhash.keys(b, False)), strict=True) if key in own[i]}
        return found | twice

    assert meet(one, two) | meet(two, one) == set(range(len(bits)))


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain(text, k=3):
    words = words_of(text)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_fingerprint_matches_plain(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "ROWS", 5)
    rng = random.Random(3)
    texts = ["", " \t\n", "One", "one  TWO", "a b c", "É Ünder x \x0b y\x0cZ", "x" * 50, *[" ".join(rng.choice(["a", "Bc", "déf", "g\nh", "ij\t"]) for _ in range(rng.randrange(60))) for _ in range(80)]]
    for text in texts:
        assert simhash.fingerprint(text.encode()) == plain(text), text
    assert simhash.fingerprint(b"") == 0


def brute(rows):
    fps = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{fps[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randrange(300, 600)) for _ in range(8)]
    rows = []
    for i in range(n):
        text = list(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "One two"), (n + 4, "ONE  two"), (n + 4, "one"), (None, "w1 w2 w3 alone"), (None, base[0] and " ".join(base[0]))]


def answer(df):
    found = simhash.simhash_dedup(df).collect()
    return sorted(((r.row_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found), key=str)


@pytest.mark.parametrize(("block", "broadcast", "pairs"), [(4096, 10, 1 << 20), (4, 1000, 50), (2, 0, 3)])
def test_matches_brute_force(spark, monkeypatch, block, broadcast, pairs):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rows = corpus(random.Random(4), 150)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, key string")
    assert answer(df) == brute(rows)
    groups = {}
    for _, fp, component in brute(rows):
        groups.setdefault(component, set()).add(fp)
    assert max(map(len, groups.values())) > 3  # links between different texts, not copies only


def test_chains_of_random_fingerprints(spark, monkeypatch):
    """Fingerprints at two and three bits from each other in chains, over small batches, against all pairs."""
    monkeypatch.setattr(simhash, "PAIRS", 64)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for fp in list(fps)[:60]:
        for _ in range(8):
            fp ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3])))
            fps.add(fp)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        links = {tuple(sorted(x & (1 << 64) - 1 for x in r)) for r in simhash.fingerprint_links(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3}
    assert links <= want

    def classes(edges):
        parent = {x: x for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        groups = {}
        for x in fps:
            groups.setdefault(find(x), []).append(x)
        return sorted(groups.values())

    assert classes(links) == classes(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_dedup(df).collect() == []
