import random
import re

import pytest

from skeinflow.llm import secret_scan as ss

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found)


def corpus():
    rng = random.Random(3)
    bits = ["token=", "Secret: '", 'API_KEY" = ', "apikey:", "passwd=token:", "token=secret=", "AKIA", "AKIAAKIA", "0123456789abcdef", "A1B2C3D4E5F6G7H8", "zz", " ", "\n", "é😀", "abc", "x" * 12, "tokenſ=abcdefghijklmno", "PASSWORD=K0123456789012"]
    return [None, "", "token=" + "a" * 5000] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["token=abcdefghijkl " * 3000]


def spans(df):
    return {r.doc_id: [(s.start, s.rank, s.kind, s.end) for s in r.spans] for r in df.collect()}


def test_matches_brute_force(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, kind string, rank int")
    got = spans(ss.report(ss.versions(df), ss.scan(df)))
    assert got == {i: brute(t) for i, t in rows}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_ledger_scans_only_what_is_unseen(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ss, "BROADCAST_BLOBS", broadcast)
    one = spark.createDataFrame([("p", 1, "token=abcdefghijkl"), ("q", 1, "clean")], "doc_id string, version int, text string")
    two = spark.createDataFrame([("p", 2, "token=abcdefghijkl!"), ("r", 1, "clean"), ("r", 2, "clean")], one.schema)
    ledger = ss.stage(ss.scan(one), "test")
    more = ss.scan(two, ledger)
    assert more.count() == 1
    everything = ledger.unionByName(more)
    got = ss.report(ss.versions(one.unionByName(two)), everything)
    assert sorted((r.doc_id, r.version, len(r.spans)) for r in got.collect()) == [("p", 1, 1), ("p", 2, 1), ("q", 1, 0), ("r", 1, 0), ("r", 2, 0)]
    # another version of the rules sees every blob again
    changed = (*ss.RULES, ss.Rule("pem", "-----BEGIN", "-----BEGIN"))
    assert ss.scan(one, everything, rules=changed).count() == 2
    assert ss.scan(one.filter("false")).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = ss.report(ss.versions(df), ss.scan(df))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_fills_the_ledger_twice(spark, monkeypatch):
    seen = []
    real = ss.scan
    monkeypatch.setattr(ss, "scan", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.spans for r in ss.op5_secret_scan(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute(t)) for i, t in docs.items()}
    first, second = ({r.blob for r in df.collect()} for df in seen)
    assert first and second and not first & second and len(first | second) == len({t or "" for t in docs.values()})
