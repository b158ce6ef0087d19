"""Committed tables and keyed tables against plain versions of them."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from skeinflow.sources import landing, versions
from skeinflow.sources.versions import Conflict, VersionedTable, put_if_absent
from skeinflow.streaming import keyed
from skeinflow.streaming.keyed import KeyedTable

SCHEMA = "k long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_versions_appends_and_replacing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert rows(table.read()) == [] and table.state().version == 0
    table.append(frame(spark, (1, "a"), (None, "b")))
    table.append(frame(spark, (2, "c")))
    table.replace(frame(spark, (9, "z")))
    assert rows(table.read()) == [(9, "z")]
    assert rows(table.read(2)) == [(1, "a"), (2, "c"), (None, "b")]
    assert rows(table.read(0)) == []
    with pytest.raises(ValueError, match="no version"):
        table.read(7)


def test_a_writer_that_dies_leaves_readers_on_the_old_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    table.append(frame(spark, (1, "a")))
    broken = frame(spark, (2, "b")).withColumn("v", F.raise_error(F.lit("dies")))
    with pytest.raises(Exception, match="dies"):
        table.replace(broken)
    table.write(frame(spark, (3, "written, never committed")))
    assert rows(table.read()) == [(1, "a")] and table.versions() == [1]
    assert table.vacuum(idle_hours=0) == 2 and rows(table.read()) == [(1, "a")]
    table.append(frame(spark, (4, "d")))
    assert rows(table.read()) == [(1, "a"), (4, "d")]


def test_two_writers_cannot_both_win(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, by="k")
    table.append(frame(spark, (1, "a"), (2, "b")))
    base = table.state()
    table.replace(frame(spark, (1, "first")), base)
    with pytest.raises(Conflict):
        table.replace(frame(spark, (1, "second")), base)
    table.replace(frame(spark, (2, "other slice")), base)
    base = table.state()
    table.append(frame(spark, (2, "more")))
    with pytest.raises(Conflict):
        table.replace(frame(spark, (2, "doesn't know of more")), base)
    table.append(frame(spark, (None, "no key")))
    assert rows(table.read()) == [(1, "first"), (2, "more"), (2, "other slice"), (None, "no key")]
    assert {p.slice: p.rows for p in table.state().parts if p.slice != "k=2"} == {"k=1": 1, "k=__HIVE_DEFAULT_PARTITION__": 1}


def test_a_version_file_is_made_once(spark, tmp_path):
    won = []
    path = str(tmp_path / "log" / "1.json")

    def write(i):
        if put_if_absent(spark, path, json.dumps(i) * 1000):
            won.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and open(path).read() == json.dumps(won[0]) * 1000 and os.listdir(tmp_path / "log") == ["1.json"]


def test_concurrent_updates_and_repeated_batches(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    table.append(frame(spark, (0, "x")))
    threads = [threading.Thread(target=lambda: table.update(lambda df: df.withColumn("k", F.col("k") + 1))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert rows(table.read()) == [(4, "x")]
    for _ in range(2):
        table.append(frame(spark, (7, "once")), batch=("w", 3))
    table.append(frame(spark, (8, "late")), batch=("w", 2))
    assert rows(table.read()) == [(4, "x"), (7, "once")]


def test_the_ingest_log_is_kept(spark, tmp_path):
    log = landing.IngestLog(spark, str(tmp_path / "log"))
    log.land(frame(spark, (1, "a"), (2, "b")), str(tmp_path / "x"), "s", "A", "w1")
    log.land(frame(spark, (1, "a")), str(tmp_path / "y"), "s", None, "w1")
    log.land(frame(spark, (1, "a")), str(tmp_path / "x"), "s", "A", "w1")
    got = sorted(((r.source, r.symbol, r.window_key, r.row_count, len(r.sha256)) for r in landing.IngestLog(spark, str(tmp_path / "log")).read().collect()), key=str)
    assert got == [("s", "A", "w1", 1, 64), ("s", None, "w1", 1, 64)]


# --- keyed tables

CHANGES = "k long, g string, seq long, v string, op string"


def plain(batches):
    state = {}
    for n, batch in enumerate(batches):
        for k, g, seq, v, op in batch:
            now = (seq, n, op == "d", v, op)
            if (k, g) not in state or now > state[k, g]:
                state[k, g] = now
    return sorted(((k, g, seq, v, op) for (k, g), (seq, _, gone, v, op) in state.items() if not gone), key=str)


@pytest.mark.parametrize("sizes", ["merging", "few", "plain"])
def test_changes_in_any_order_equal_the_batch(spark, tmp_path, monkeypatch, sizes):
    if sizes != "plain":
        monkeypatch.setattr(keyed, "LEAST", 5)
        monkeypatch.setattr(keyed, "MOST_PARTS", 2)
    if sizes == "merging":
        monkeypatch.setattr(keyed, "BROADCAST_KEYS", 0)
    rng = random.Random(sizes)
    batches = [[(rng.choice([None, *range(20)]), rng.choice("ab"), rng.randrange(30), rng.choice("xyz"), rng.choice("uuud")) for _ in range(rng.randrange(40))] for _ in range(8)]
    table = KeyedTable(spark, str(tmp_path / "t"), CHANGES, ["k", "g"], ["seq"], deleted="op = 'd'", buckets=4)
    for n, batch in enumerate(batches):
        table.apply(spark.createDataFrame(batch, CHANGES), n)
        if n in (3, 6):  # replayed
            table.apply(spark.createDataFrame(batch, CHANGES), n)
        if n == 4:
            assert rows(table.current()) == plain(batches[:5])
    assert rows(table.current()) == plain(batches)
    some = spark.createDataFrame([(3, "a"), (None, "b"), (99, "a")], "k long, g string")
    assert rows(table.current(keys=some)) == [r for r in plain(batches) if r[:2] in ((3, "a"), (None, "b"))]
    kinds = {p.tags["kind"] for p in table.table.state().parts}
    assert ("base" in kinds) == (sizes != "plain")
    table.merge(slices={p.slice for p in table.table.state().parts})
    assert rows(table.current()) == plain(batches)


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    path = tmp_path / "t"
    table = KeyedTable(spark, str(path), "k long, seq long, v string", ["k"], ["seq"], buckets=8)
    big = spark.range(60_000).selectExpr("id AS k", "1L AS seq", "uuid() AS v")
    table.apply(big, 0)
    table.merge(slices={p.slice for p in table.table.state().parts})
    before = {f for f in os.listdir(path / "data")}
    table.apply(spark.createDataFrame([(5, 2, "new"), (70_000, 1, "n")], "k long, seq long, v string"), 1)
    size = lambda names: sum(os.path.getsize(os.path.join(d, f)) for n in names for d, _, fs in os.walk(path / "data" / n) for f in fs)
    new = {f for f in os.listdir(path / "data")} - before
    assert size(new) * 100 < size(before)
    assert table.current().count() == 60_001
    assert table.current(keys=spark.createDataFrame([(5,)], "k long")).first().v == "new"


def test_a_merge_leaves_batches_that_come_in_meanwhile(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, seq long, v string", ["k"], ["seq"], buckets=2)
    one = lambda *r: spark.createDataFrame(list(r), "k long, seq long, v string")
    table.apply(one((1, 1, "a"), (2, 1, "b")), 0)
    old = table.table.state()
    slices = {p.slice for p in old.parts}
    table.apply(one((1, 2, "aa")), 1)
    table.merge(old, slices)  # from a state that has been passed
    assert rows(table.current()) == [(1, 2, "aa"), (2, 1, "b")]
    table.merge(old, slices)  # what it merges is gone: nothing happens
    assert rows(table.current()) == [(1, 2, "aa"), (2, 1, "b")]
    assert versions.State.of(table.table.state().json()) == table.table.state()


def test_follows_a_stream(spark, tmp_path):
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    table = KeyedTable(spark, str(tmp_path / "t"), CHANGES, ["k", "g"], ["seq"], deleted="op = 'd'")
    batches = [[(1, "a", 1, "x", "u"), (2, "a", 5, "y", "u")], [(1, "a", 3, "", "d"), (2, "a", 4, "late", "u")], [(1, "a", 2, "late", "u"), (3, "b", 1, "n", "u")]]
    for batch in batches:
        spark.createDataFrame(batch, CHANGES).write.mode("append").parquet(src)
        table.follow(spark.readStream.schema(CHANGES).parquet(src), mark)
    assert rows(table.current()) == plain(batches) == [(2, "a", 5, "y", "u"), (3, "b", 1, "n", "u")]
