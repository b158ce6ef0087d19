"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits, which are padded to words of the Golay code
(see ``golay``). Two fingerprints that differ in one to three bits fall into one of two cases:

* a segment without errors, and then another one with at most one (two others with two each were four): keys of the
  first's bits and the second's index, for each of the six ordered pairs;
* one error in each segment: keys of the indices of the first two, the half of the third that has no error, and what
  the second's and third's parities are, which the errors turn over.

One side is indexed under its own indices, the other is looked up under all of its up to six; since one error turns a
segment's parity, only the odd ones are looked up. So a pair meets under a key, and only pairs of rows of one key, one of
them indexed, are compared bit by bit. Of the links in a key's rows a spanning forest leaves the task, never all pairs.
Keys with more than BLOCK indexed rows are dealt to cells of at most about BLOCK of them; looked up rows are streamed
past a cell. Equal fingerprints are one before anything is keyed, so copies cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm import golay
from skeinflow.llm.components import components
from skeinflow.llm.staging import bound_batches, stage

#: Words in a shingle, and bits in which linked fingerprints may differ.
WORDS, BITS = 3, 3
#: Bytes of a text that are cut into words at once, and rows that are hashed or compared at once.
PIECE, ROWS, PAIRS = 1 << 20, 1 << 14, 1 << 20
#: Indexed rows of a key that one task holds.
BLOCK = 4096
#: Keys with more rows than that whose table is broadcast (16 bytes each); beyond it rows meet it by shuffle.
BROADCAST_KEYS = 100_000
#: First bit and length of each segment.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as xxh64

    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return np.array([xxh64(line[a:b], 42) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), ROWS):
        bits = np.unpackbits(hashes[at : at + ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, k: int = WORDS) -> int:
    """The SimHash of a text's k-word shingles, repeats included, by XXH64 with seed 42; 0 without words.

    A-Z are lower-cased, words separated by ASCII white space; fewer than k words are one shingle. The text is worked
    off in pieces that end at white space.
    """
    total, n, held, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        held += text[at:end].lower().split()
        at = end
        if len(held) >= k:
            found = _hashes(held, k)
            total, n, held = total + _ones(found), n + len(found), held[len(held) - k + 1 :]
    if not n and held:
        total, n = _ones(_hashes(held, len(held))), 1
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py() or b"", k) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["row_id", "fp"])

    return run


def keys(fps: np.ndarray, looked_up: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) under which fingerprints (uint64) are indexed, or looked up. A key holds its parts unhashed."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    odd = [np.bitwise_count(p) & 1 for p in parts]
    every = np.arange(len(fps))
    where, found = [], []

    def add(at: np.ndarray, kind: int, *fields: tuple[np.ndarray, int]) -> None:
        key = np.full(len(at), kind, np.uint64)
        for value, bits in fields:
            key = key << np.uint64(bits) | value.astype(np.uint64)
        where.append(at)
        found.append(key << np.uint64(60 - sum(bits for _, bits in fields)))

    def near(j: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not looked_up:
            return rows, golay.own_index(parts[j][rows])
        at, index = golay.indices(parts[j][rows])
        return rows[at], index

    for j in range(3):
        rows, index = near(j, np.flatnonzero(odd[j]) if looked_up else every)
        for i in range(3):
            if i != j:
                add(rows, 3 * i + j, (parts[i][rows], 22), (index, golay.INDEX_BITS))
    rows, first = near(0, np.flatnonzero(odd[0] == looked_up))
    own = np.arange(len(rows))
    if looked_up:
        own, second = golay.indices(parts[1][rows])
    else:
        second = golay.own_index(parts[1][rows])
    rows, first = rows[own], first[own]
    turn = np.uint8(looked_up)
    for half, kind in ((parts[2] & np.uint32(0x3FF), 9), (parts[2] >> np.uint32(10), 10)):
        add(rows, kind, (first, 12), (second, 12), (odd[1][rows] ^ turn, 1), (odd[2][rows] ^ turn, 1), (half[rows], 11))
    return np.concatenate(where), np.concatenate(found)


def _keyed(looked_up: tuple[bool, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            all_fps = whole.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), ROWS):
                fps = all_fps[at : at + ROWS]
                for side in looked_up:
                    where, key = keys(fps, side)
                    columns = [pa.array(key.view(np.int64)), pa.array(fps[where].view(np.int64)), pa.array(np.full(len(key), side))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "looked_up"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that join what ``root`` holds apart, a spanning forest of them; ``root`` is brought up to date."""
    out_a, out_b = [], []
    while len(a):
        one, two = root[a], root[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        if not len(a):
            break
        # every root takes part in one edge to a lower one, so no circle can close
        high, pick = np.unique(np.maximum(one, two), return_index=True)
        out_a.append(a[pick])
        out_b.append(b[pick])
        root[high] = np.minimum(one, two)[pick]
        while not np.array_equal(up := root[root], root):
            root[:] = up
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (a, b)


def _links(max_bits: int):
    """Rows (key, cell, fp, looked_up) in that order, indexed ones first, to links that span what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)  # the indexed rows of the last group so far, and their roots
        held_root = np.zeros(0, np.int64)
        last = None
        for batch in batches:
            key, cell, fps, later = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fps = fps.view(np.uint64)
            new = np.concatenate([[(key[0], cell[0]) != last], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]) if len(key) else np.zeros(0, bool)
            if not len(new):
                continue
            if new[0]:
                held, held_root = held[:0], held_root[:0]
            # what is held stands before the batch, as rows that have been compared
            n = len(held)
            fps, later, new = np.concatenate([held, fps]), np.concatenate([np.zeros(n, bool), later]), np.concatenate([np.zeros(n, bool), new])
            new[0] = True
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            indexed = np.add.reduceat(~later, starts)
            place = np.arange(len(fps)) - starts[group]
            count = np.minimum(place, indexed[group])
            count[:n] = 0
            root = np.arange(len(fps))
            root[:n] = held_root
            rows = np.flatnonzero(count)
            total = np.cumsum(count[rows])
            at = 0
            while at < len(rows):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
                some = rows[at:end]
                reach = count[some]
                a = np.repeat(some, reach)
                b = np.arange(len(a)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(starts[group[some]], reach)
                close = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
                close &= fps[a] != fps[b]
                a, b = _forest(a[close], b[close], root)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])
                at = end
            last = (key[-1], cell[-1])
            keep = starts[-1] + np.flatnonzero(~later[starts[-1] :])
            held, held_root = fps[keep], np.unique(root[keep], return_index=True)
            held_root = held_root[1][np.searchsorted(held_root[0], root[keep])]

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = BITS) -> DataFrame:
    """(a, b): links at 1 to ``max_bits`` (3 at most) differing bits that span what is linked, of distinct fingerprints (fp: long)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys find up to three differing bits")
    bound_batches(fps.sparkSession)
    schema = "key long, fp long, looked_up boolean"
    indexed = fps.select("fp").mapInArrow(_keyed((False,)), schema)
    hot = stage(indexed.groupBy("key").count().filter(F.col("count") > BLOCK).select(F.col("key").alias("hot"), F.ceil(F.col("count") / BLOCK).cast("int").alias("cells")), "simhash-hot")
    rows = fps.select("fp").mapInArrow(_keyed((False, True)), schema)
    n = hot.count()
    if n:
        rows = rows.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot, F.col("key") == F.col("hot"), "left").drop("hot")
        own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
        # an indexed row is one of its own cell, and is looked up in the cells behind it
        spread = F.explode(F.sequence(F.when(F.col("looked_up"), 0).otherwise(own), F.col("cells") - 1)).alias("cell")
        dealt = rows.filter("cells IS NOT NULL").select("key", spread, "fp", "looked_up", own.alias("own"))
        dealt = dealt.select("key", "cell", "fp", (F.col("looked_up") | (F.col("cell") > F.col("own"))).alias("looked_up"))
        rows = rows.filter("cells IS NULL").select("key", F.lit(0).alias("cell"), "fp", "looked_up").unionByName(dealt)
    else:
        rows = rows.select("key", F.lit(0).alias("cell"), "fp", "looked_up")
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "looked_up").mapInArrow(_links(max_bits), "a long, b long")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, max_bits: int = BITS) -> DataFrame:
    """One row per row: row_id, fp (long), component_id, n_same.

    component_id is the smallest identifier (an integer) that links reach, its own included; rows with equal fingerprints
    are linked, n_same counts them. A null, empty or blank text has fingerprint 0 and is linked like any other. A null
    identifier takes part but names no component, so one of such rows alone is null. Other columns are ignored; repeated
    rows are copies; an empty table gives an empty result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(df[id_col].cast("long").alias("row_id"), df[text_col].cast("string").cast("binary").alias("text"))
    own = stage(docs.mapInArrow(_fingerprints(k), "row_id long, fp long"), "simhash-docs")
    nodes = stage(own.groupBy("fp").agg(F.min("row_id").alias("least"), F.count("*").alias("n_same")), "simhash-nodes")
    reached = components(stage(fingerprint_links(nodes, max_bits), "simhash-links")).withColumnRenamed("node", "fp")
    named = reached.join(nodes, "fp").groupBy("component").agg(F.min("least").alias("all_least"))
    linked = reached.join(named, "component").select("fp", "all_least")
    info = nodes.join(linked, "fp", "left").filter("n_same > 1 OR all_least IS NOT NULL")
    info = stage(info.select("fp", F.coalesce("all_least", "least").alias("component_id"), "n_same"), "simhash-info")
    # both sides of this join come from an exchange of their own, so a fingerprint with very many rows can be split
    joined = own.join(info, "fp", "left")
    return joined.select("row_id", "fp", F.coalesce("component_id", "row_id").alias("component_id"), F.coalesce("n_same", F.lit(1).cast("long")).alias("n_same"))


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_dedup(docs)
    return found.select(F.col("row_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
