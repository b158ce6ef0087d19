import random
import re

import pytest

from skeinflow.llm import decontaminate
from skeinflow.llm.decontaminate import contaminated


def grams(text, k=5):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def cases():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["é", "straße"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 3, 4, 5, 6, 7, 9, 12, 16, 17, 20, 33, 40, 60, 120, 300])] + [(90, None), (91, "!!"), (92, "")]
    docs = [None, "", "...", say(4), say(50)]
    for _, text in items[:16]:
        docs += [text, f"{say(3000)} {text} {say(2000)}", text.upper().replace(" ", ", "), f"{say(rng.randint(0, 40))} {text}"]
        w = text.split()
        docs += [" ".join([*w[: len(w) * 9 // 10], say(30)]), " ".join([*w[: len(w) // 2], say(200), *w[len(w) // 2 :]])]
    docs += [say(rng.randint(1, 400)) for _ in range(100)]
    return [(i, d) for i, d in enumerate(docs)], items


@pytest.mark.parametrize("pass_bytes", [8 << 20, 900])
def test_matches_brute_force(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    docs, items = cases()
    expected = {}
    for item, text in items:
        want = grams(text)
        for doc, body in docs:
            have = len(want & grams(body))
            if want and 100 * have >= 80 * len(want):
                expected[doc, item] = (len(want), have)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == expected
    assert len(got) > 60


def torn(rng, n, parts, share):
    """An item of ``n`` words and a long document that holds ``share`` of its shingles in about ``parts`` far parts."""
    words = [f"t{rng.randrange(10**6)}" for _ in range(n)]
    cuts = sorted(rng.sample(range(6, n - 5), parts - 1)) if parts > 1 else []
    say = lambda m: " ".join(f"f{rng.randrange(10**6)}" for _ in range(m))
    # each part overlaps the next by four words, so a tear alone loses nothing; then words are lost at random
    pieces = [" ".join(words[max(0, a - 4) : b]) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    body = f"{say(800)} " + f" {say(rng.randint(300, 900))} ".join(rng.sample(pieces, len(pieces))) + f" {say(800)}"
    kept = body.split()
    for at in rng.sample(range(n), n):
        trial = [w for w in kept if w != words[at]]
        if 100 * len(grams(" ".join(words)) & grams(" ".join(trial))) < share * (n - 4):
            break
        kept = trial
    return " ".join(words), " ".join(kept)


@pytest.mark.parametrize("num", [80, 50])
def test_torn_items_are_found(spark, num):
    rng = random.Random(num)
    pairs = [torn(rng, rng.choice([17, 20, 30, 45, 70, 130]), rng.randint(1, 6) if i % 2 else 1, num) for i in range(60)]
    items = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "item_id long, text string")
    docs = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "doc_id long, text string")
    want = {(i, i) for i, (a, b) in enumerate(pairs) if 100 * len(grams(a) & grams(b)) >= num * len(grams(a))}
    assert len(want) >= 55
    found = {(r.doc_id, r.item_id) for r in contaminated(docs, items, num=num).collect()}
    exact = {(r.doc_id, r.item_id) for r in contaminated(docs, items, num=num, exhaustive=True).collect()}
    assert exact == want and found == want


def test_exhaustive_way_matches_the_search(spark):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, contaminated(d, i, exhaustive=True).collect())) == sorted(map(tuple, contaminated(d, i).collect()))
    with pytest.raises(ValueError):
        contaminated(d, i, num=0)


def test_hash_functions_keep_the_promise():
    for num in (100, 80, 60, 50, 20):
        for width in (2, 8, 64, 4096):
            least = width // 2 + 1
            assert (1 - num / 100 * least / (least + 2 * width)) ** decontaminate._functions(width, num, 100) <= decontaminate.MISS


def test_both_sides_are_lower_cased_alike(spark):
    text = "ΑΣΣ İIı ẞß ΌΣΟΣ Ǆ words here"
    docs = spark.createDataFrame([(1, text), (2, text.lower())], "doc_id long, text string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert 1 in {r.doc_id for r in contaminated(docs, items).collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(none, items).collect() == []
    assert contaminated(none.selectExpr("doc_id", "text"), items.filter("false")).collect() == []
    twice = spark.createDataFrame([(7, "x a b c d e f y"), (7, "x a b c d e f y")], "doc_id long, text string")
    assert [r.doc_id for r in contaminated(twice, items.union(items)).collect()] == [7, 7]
