"""Vector code compression: codebooks per part of a vector, refined by Lloyd rounds over partition-local heaps.

Vectors are kept as blocks of whole numbers. Each block has, for every part position and codebook entry, a heap of the
parts that the entry holds, keyed by how much farther the second-nearest entry is than the nearest (lower bound minus
upper bound). When entries move, a part's nearest may come nearer to its rivals by the entry's own way plus the longest
way of any other: that drift is summed up per entry, and only parts whose key the drift has reached are popped and
compared with all entries again; whatever is closer to its own entry by more than the drift can't change. A heap is an
ascending array, so the popped parts are a prefix of it. Blocks with their heaps are written between rounds, so a lost
executor costs its tasks alone; codebooks, bounded by entries times dimensions, are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.staging import bound_batches, remove, stage, stage_path

#: Vectors and components in a block, about twice as many at most.
BLOCK, BLOCK_CELLS = 4096, 1 << 18
#: Distances held at once.
CELLS = 1 << 21
#: By how much rounded square roots may be off; keys within it of the drift are popped as well.
SLACK = 1e-3
#: Labels whose sums are broadcast back; beyond it rows are shuffled.
BROADCAST_LABELS = 100_000


def limit(dims: int) -> int:
    """Components below this in magnitude keep a vector's squared distances within 62 bits."""
    return int((2**62 / max(1, dims)) ** 0.5) // 2


def _blocks(scale: int, dims: int):
    """(row_id, label, vector) to blocks (ids, labels, values: int64, row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, block = 0, max(1, min(BLOCK, BLOCK_CELLS // max(1, dims)))

        def pack() -> pa.RecordBatch:
            ids, labels = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
            values = np.concatenate([h[2] for h in held])
            columns = [pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([labels.to_pylist()], pa.list_(labels.type)), pa.array([values.tobytes()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "values"])

        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                values = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(batch.num_rows, dims)
                held.append((batch.column(0), batch.column(1), values.astype(np.int64)))
                n += batch.num_rows
                if n >= block:
                    yield pack()
                    n = 0
        if held:
            yield pack()

    return run


def squared(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(parts, entries) squared distances as whole numbers, exactly."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    # below 2**53 the products' sums are whole in floating point too, where they are faster
    kind = np.float64 if 4 * most * most * max(1, parts.shape[1]) < 1 << 53 else np.int64
    x, c = parts.astype(kind), book.astype(kind)
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return out.astype(np.int64)


def _nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the nearest entry, the lower one of equals, and how much farther the second is (infinite without one)."""
    code, gap = np.zeros(len(parts), np.int64), np.full(len(parts), np.inf)
    step = max(1, CELLS // max(1, len(book)))
    for at in range(0, len(parts), step):
        d = squared(parts[at : at + step], book)
        own = d.argmin(axis=1)
        code[at : at + step] = own
        if len(book) > 1:
            two = np.partition(d, 1, axis=1)[:, :2]
            gap[at : at + step] = np.sqrt(two[:, 1].astype(np.float64)) - np.sqrt(two[:, 0].astype(np.float64))
    return code, gap


class Heaps:
    """The heaps of one part position in a block: which part, its entry and its key, by entry and then by key.

    A key is the gap between the bounds plus the entry's drift when it was compared, so it stays while entries move.
    """

    def __init__(self, order: np.ndarray, code: np.ndarray, key: np.ndarray) -> None:
        self.order, self.code, self.key = order, code, key

    @classmethod
    def of(cls, code: np.ndarray, key: np.ndarray) -> Heaps:
        order = np.lexsort((key, code))
        return cls(order, code[order], key[order])

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """The parts whose key the drift of their entry has reached: a prefix of each heap."""
        ends = np.searchsorted(self.code, np.arange(len(drift)), "right").tolist()
        out, begin = [np.zeros(0, np.int64)], 0
        for entry, end in enumerate(ends):
            out.append(self.order[begin : begin + int(np.searchsorted(self.key[begin:end], drift[entry] + SLACK, "right"))])
            begin = end
        return np.concatenate(out)

    def unordered(self) -> tuple[np.ndarray, np.ndarray]:
        code, key = np.empty_like(self.code), np.empty_like(self.key)
        code[self.order], key[self.order] = self.code, self.key
        return code, key


def _round(shared, parts: int, dims: int, first: bool, last: bool):
    """Blocks to blocks after an assignment: what the drift has reached is compared anew, and sums for the codebooks leave
    with the block, or at last codes and errors."""
    width = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drift = shared.value
        entries = books.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = len(row.column("ids")[0])
                values = np.frombuffer(row.column("values")[0].as_py(), np.int64).reshape(n, dims)
                heaps, codes, popped = [], [], 0
                sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
                errors = np.zeros(n, np.int64)
                if not first:
                    kept = [np.frombuffer(row.column(c)[0].as_py(), kind).reshape(parts, n) for c, kind in (("orders", np.int16), ("codes", np.uint8), ("keys", np.float64))]
                for p in range(parts):
                    own = values[:, p * width : (p + 1) * width]
                    if first:
                        code, key = _nearest(own, books[p])
                        popped += n
                    else:
                        before = Heaps(kept[0][p].astype(np.int64), kept[1][p].astype(np.int64), kept[2][p])
                        again = before.pop(drift[p])
                        code, key = before.unordered()
                        code[again], gap = _nearest(own[again], books[p])
                        key[again] = gap + drift[p][code[again]]
                        popped += len(again)
                    if last:
                        far = own - books[p][code]
                        errors += (far * far).sum(axis=1)
                        codes.append(code.astype(np.uint8))
                    else:
                        heap = Heaps.of(code, key)
                        heaps.append(heap)
                        counts[p] = np.bincount(code, minlength=entries)
                        used = np.flatnonzero(counts[p])
                        starts = np.searchsorted(heap.code, used)
                        sums[p, used] = np.add.reduceat(own[heap.order], starts, axis=0)
                found = {"popped": pa.array([popped], pa.int64())}
                if last:
                    found |= {"codes": pa.array([np.stack(codes, axis=1).tobytes()], pa.binary()), "errors": pa.array([errors.tobytes()], pa.binary())}
                    found |= {c: row.column(c) for c in ("ids", "labels")}
                else:
                    stored = {"orders": [h.order.astype(np.int16) for h in heaps], "codes": [h.code.astype(np.uint8) for h in heaps], "keys": [h.key for h in heaps]}
                    found |= {c: pa.array([np.concatenate(x).tobytes()], pa.binary()) for c, x in stored.items()}
                    found |= {"sums": pa.array([sums.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())}
                    found |= {c: row.column(c) for c in ("ids", "labels", "values")}
                yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    return run


def _added(parts: int, entries: int, width: int):
    """A task's blocks' sums and counts, added up: (part, entry, place: -1 for the count, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(parts * entries * width, object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                sums += np.frombuffer(one.as_py(), np.int64)
                counts += np.frombuffer(two.as_py(), np.int64)
        used = np.flatnonzero(counts)
        rows = [(e // entries, e % entries, -1, str(counts[e])) for e in used.tolist()]
        rows += [(e // entries, e % entries, j, str(sums[e * width + j])) for e in used.tolist() for j in range(width)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["part", "entry", "place", "total"])

    return run


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose used entries stand at the floored means of their parts."""
    parts, entries, width = books.shape
    sums = blocks.select("sums", "counts").mapInArrow(_added(parts, entries, width), "part int, entry int, place int, total string")
    rows = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # entries x dimensions at most
    total = {(r.part, r.entry, r.place): int(r.total) for r in rows}
    out = books.copy()
    for (part, entry, place), value in total.items():
        if place >= 0:
            out[part, entry, place] = value // total[part, entry, -1]
    return out


def _drift(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How much nearer each entry's parts may have come to a rival: its own way and the longest of the others'."""
    if not before.shape[1]:
        return np.zeros(before.shape[:2])
    way = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=2))
    out = np.empty_like(way)
    for p, row in enumerate(way):
        top = int(row.argmax())
        others = np.full(len(row), row[top])
        others[top] = np.delete(row, top).max(initial=0.0)
        out[p] = row + others
    return out


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(row_id, label, code, error of each kept vector; codebooks[part, entry, place]; parts compared in each assignment).

    Vectors that are null, or hold null or non-finite components, go. Components become floor(scale * x); a vector is cut
    into ``parts`` equal parts, whose codebooks start as those of the ``entries`` smallest identifiers (null ones last,
    repeated ones in order of the vector) and move ``rounds`` times to the floored means of their parts; an entry without
    parts stays. Equally near entries go to the lower one. With fewer vectors there are fewer entries; empty tables give
    no rows and no entries. All kept vectors need one length that ``parts`` divides, and components that keep squared
    distances within 64 bits (``limit``); anything else is refused by a ValueError. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    spark = df.sparkSession
    bound_batches(spark)
    vector = df[vector_col].cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    label = df[label_col] if label_col else F.lit(None).cast("int")
    kept = df.select(df[id_col].alias("row_id"), label.alias("label"), vector.alias("vector")).filter(F.col("vector").isNotNull() & F.forall("vector", finite))
    least = kept.orderBy(F.col("row_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    dims = len(least[0].vector) if least else parts
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    most = limit(dims)
    odd = (F.size("vector") != dims) | F.exists("vector", lambda x: F.abs(x) * scale >= most)
    other = kept.filter(odd).select(F.size("vector").alias("n")).first()
    if other:
        raise ValueError("vectors differ in length" if other.n != dims else f"components from {most // scale} on don't keep squared distances within 64 bits")
    books = np.array([[int(np.floor(x * scale)) for x in r.vector] for r in least], np.int64)
    books = books.reshape(len(least), parts, dims // parts).transpose(1, 0, 2).copy()

    id_type, label_type = kept.schema["row_id"].dataType, kept.schema["label"].dataType
    listed = [T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type))]
    raw = lambda *names: [T.StructField(c, T.BinaryType()) for c in names]
    popped = [T.StructField("popped", T.LongType())]
    middle = T.StructType([*popped, *raw("orders", "codes", "keys", "sums", "counts"), *listed, *raw("values")])
    final = T.StructType([*popped, *raw("codes", "errors"), *listed])

    path = stage_path(spark, "codes-blocks")
    kept.mapInArrow(_blocks(scale, dims), T.StructType([*listed, *raw("values")])).write.parquet(path)
    blocks = spark.read.schema(T.StructType([*listed, *raw("values")])).parquet(path)
    drift = np.zeros(books.shape[:2])
    compared = []
    for turn in range(rounds + 1):
        last = turn == rounds
        shared = spark.sparkContext.broadcast((books, drift))
        before, path = path, stage_path(spark, "codes-blocks")
        schema = final if last else middle
        blocks.mapInArrow(_round(shared, parts, dims, turn == 0, last), schema).write.parquet(path)
        blocks = spark.read.schema(schema).parquet(path)
        remove(spark, before)
        compared.append(blocks.agg(F.coalesce(F.sum("popped"), F.lit(0)).alias("n")).first().n)
        if not last:
            after = _moved(blocks, books)
            books, drift = after, drift + _drift(books, after)
    kind = T.StructType([T.StructField("row_id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return blocks.select("ids", "labels", "codes", "errors").mapInArrow(_rows(parts), kind), books, compared


def _rows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                digits = batch.column(2)[i].as_py().hex()
                codes = pa.array([digits[2 * parts * j : 2 * parts * (j + 1)] for j in range(len(ids))], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(np.frombuffer(batch.column(3)[i].as_py(), np.int64))], names=["row_id", "label", "code", "error"])

    return run


def label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the sum of errors over rows of the same label; null labels are one label."""
    rows = stage(rows, "codes-rows")
    sums = stage(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows, books, _ = vector_codes(vectors)
    return label_errors(rows).select(F.col("row_id").alias("vec_id"), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = 2) -> str:
    nearest = """
a{i} AS (SELECT vec_id, part, v, e, d FROM (
  SELECT x.vec_id, x.part, x.v, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda j: (x.v[j] - b.v[j]) * (x.v[j] - b.v[j]))) AS d
  FROM parts x JOIN b{i} b ON b.part = x.part) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) = 1)"""
    moved = """
m{i} AS (SELECT part, e, j, CAST(floor(sum(v[j])::DOUBLE / count(*)) AS BIGINT) AS x FROM a{i}, range(1, 1 + (SELECT max(len(v)) FROM parts)) AS t(j) GROUP BY ALL),
b{n} AS (SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (SELECT part, e, list(x ORDER BY j) AS v FROM m{i} GROUP BY ALL) m ON m.part = b.part AND m.e = b.e)"""
    steps = ",".join(nearest.format(i=i) + "," + moved.format(i=i, n=i + 1) for i in range(rounds)) + "," + nearest.format(i=rounds)
    return rf"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS v FROM kept, range(16) AS t(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
b0 AS (SELECT part, e, v FROM parts JOIN first USING (vec_id)),{steps},
done AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM done JOIN kept USING (vec_id), book
"""


OP13_SQL = _sql()
