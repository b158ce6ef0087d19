"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

MinHash estimates Jaccard similarity, which says little about a short item inside a long document. So both sides are
partitioned by size: items into classes of doubling width w, documents into windows of 2w shingles that advance by w,
minima of tiles of w taken once and shared by all classes. A function finds an item when the item's least shingle is in
the document and is the least of its window. However the item is torn, the document holds num / den of its shingles, so
the least is there with this chance, and its window adds 2w shingles at most to the item's; that bounds the chance from
below whatever the document's length and sets the number of hash functions, each a band of its own, for a chance to
miss of at most MISS. Every candidate is then judged by the exact share of the item's distinct shingles that the
document holds anywhere, in integers. ``exhaustive`` judges every document by all items that share a shingle with it
instead, and misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.hashing import ALNUM, PIECE, batches_of, mix, shingles
from skeinflow.llm.staging import bound_batches

#: Most chance to miss an item, if hash functions are independent.
MISS = 1e-7
#: Bytes of items held by a task at once; more items are searched in several passes over the documents.
PASS_BYTES = 8 << 20


@dataclass
class Index:
    """The items of a pass: their shingles for the exact test, their minima for the search."""

    ids: list
    sizes: np.ndarray
    grams: np.ndarray  # all distinct shingles, sorted
    starts: np.ndarray  # of each shingle's items in ``owners``
    owners: np.ndarray
    classes: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]  # width: item numbers, (sorted minima, their items) per function


def _factors(n: int) -> np.ndarray:
    return (mix(np.arange(101, 101 + n, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _functions(width: int, num: int, den: int) -> int:
    """Hash functions of a class of items of more than ``width`` / 2 shingles and ``width`` at most."""
    if width == 1:
        return 1
    least = width // 2 + 1
    chance = num / den * least / (least + 2 * width)
    return ceil(log(MISS) / log(1 - chance))


def build_index(items: list[tuple[object, str]], k: int, num: int, den: int) -> Index:
    """The index of items (identifier, lower-cased text)."""
    ids, sets = [], []
    for i, grams in shingles([(text or "").encode() for _, text in items], k, ALNUM):
        if len(grams):
            ids.append(items[i][0])
            sets.append(np.unique(grams))
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    grams, starts = np.unique(every[order], return_index=True)
    classes = {}
    for width in sorted({1 << int(n - 1).bit_length() for n in sizes}):
        mine = np.flatnonzero([1 << int(n - 1).bit_length() == width for n in sizes])
        minima = []
        for factor in _factors(_functions(width, num, den)):
            low = np.array([((sets[i] >> np.uint64(32)).astype(np.uint32) * factor).min() for i in mine], np.uint32)
            by = np.argsort(low, kind="stable")
            minima.append((low[by], mine[by]))
        classes[width] = (mine, minima)
    return Index(ids, sizes, grams, np.append(starts, len(every)), owners[order], classes)


def candidates(index: Index, stream: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) pairs that share a band; ``stream`` has the texts' shingles in a row, ``bounds`` where each begins."""
    found: set[tuple[int, int]] = set()
    if not len(stream) or not index.classes:
        return found
    base = 8 if min(index.classes) >= 8 else 1
    keys = (stream >> np.uint64(32)).astype(np.uint32)
    rows = -(-len(keys) // base)
    last = np.full(rows * base, keys[-1], np.uint32)  # a repeated shingle changes no minimum's meaning
    last[: len(keys)] = keys
    tiles = np.ascontiguousarray(last.reshape(rows, base).T)
    most = max(len(minima) for _, minima in index.classes.values())
    for f, factor in enumerate(_factors(most)):
        low, width = (tiles * factor).min(axis=0), base
        for target, (_, minima) in index.classes.items():
            while width < target:
                if len(low) % 2:
                    low = np.append(low, low[-1])
                low, width = np.minimum(low[0::2], low[1::2]), width * 2
            if f >= len(minima):
                continue
            window = low if target == 1 or len(low) == 1 else np.minimum(low[:-1], low[1:])
            values, items = minima[f]
            at = np.searchsorted(values, window)
            hit = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == window)
            for w in hit:
                first = np.searchsorted(bounds, w * width, "right") - 1
                end = np.searchsorted(bounds, (w + (1 if target == 1 else 2)) * width, "left")
                same = items[at[w] : np.searchsorted(values, window[w], "right")]
                found.update((int(t), int(i)) for t in range(first, min(end, len(bounds) - 1)) for i in same)
    return found


def verified(index: Index, grams: np.ndarray, items: list[int] | None, num: int, den: int) -> list[tuple[int, int]]:
    """(item, shared shingles) for those of ``items`` (None: of all) whose share in the text suffices."""
    grams = np.unique(grams)
    at = np.searchsorted(index.grams, grams)
    hit = at[index.grams[np.minimum(at, len(index.grams) - 1)] == grams]
    shared = np.zeros(len(index.ids), np.int64)
    for a, b in zip(index.starts[hit], index.starts[hit + 1], strict=True):
        shared[index.owners[a:b]] += 1
    wanted = sorted(items) if items is not None else np.flatnonzero(shared).tolist()
    return [(i, int(shared[i])) for i in wanted if den * shared[i] >= num * index.sizes[i]]


def _search(shared, k: int, num: int, den: int, item_kind: pa.DataType, exhaustive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            rows, items, sizes, counts = [], [], [], []
            for first, end in batches_of(texts, PIECE):
                grams = [g for _, g in shingles(texts[first:end], k, ALNUM)]
                wanted: dict[int, list[int] | None] = {}
                if exhaustive:
                    wanted = {t: None for t, g in enumerate(grams) if len(g)}
                else:
                    bounds = np.cumsum([0] + [len(g) for g in grams])
                    for t, i in candidates(index, np.concatenate(grams), bounds):
                        wanted.setdefault(t, []).append(i)
                for t, mine in sorted(wanted.items()):
                    for i, n in verified(index, grams[t], mine, num, den):
                        rows.append(first + t)
                        items.append(index.ids[i])
                        sizes.append(int(index.sizes[i]))
                        counts.append(n)
            shares = [n / s for n, s in zip(counts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, item_kind), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(shares, pa.float64())],
                names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
            )

    return run


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", exhaustive: bool = False) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment for items of which a document holds num / den or more.

    Both texts are lower-cased; words are runs of letters and digits (every non-ASCII character counts as one). An item
    with fewer than k words is one shingle, found in documents that consist of these words alone; items and documents
    that are null, empty or without words match nothing. Repeated documents give a row each; repeated items with one
    identifier give one. Other columns are ignored; empty tables give no rows. The items of a pass are broadcast, their
    bytes bounded by PASS_BYTES; more items take more passes. ``exhaustive`` leaves out the search and judges every
    document by all items.
    """
    if not 0 < num <= den:
        raise ValueError("0 < num <= den is needed")
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    bound_batches(spark)
    kind, item_type = docs.schema[id_col].dataType, items.schema[item_id].dataType
    rows = docs.select(docs[id_col].alias("doc_id"), F.lower(docs[text_col].cast("string")).cast("binary").alias("text"))
    texts = items.select(items[item_id].alias("id"), F.lower(items[item_text].cast("string")).alias("text")).filter("text IS NOT NULL").distinct()
    passes = ceil((texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) / PASS_BYTES)
    schema = f"doc_id {kind.simpleString()}, item_id {item_type.simpleString()}, n_item_shingles long, n_shared long, containment double"
    out = None
    for p in range(passes):
        part = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == p)
        index = build_index([(r.id, r.text) for r in part.collect()], k, num, den)
        if index.ids:
            found = rows.mapInArrow(_search(spark.sparkContext.broadcast(index), k, num, den, to_arrow_type(item_type), exhaustive), schema)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, items)


OP8_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') FROM benchmark),
grams AS (SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM grams WHERE side = 'i' GROUP BY id),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS o FROM grams d JOIN grams i ON d.g = i.g WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, o AS n_shared, CAST(o AS DOUBLE) / n AS containment FROM shared JOIN sizes ON id = item_id WHERE 100 * o >= 80 * n
"""
