"""Phrase collocation mining over dictionary-encoded words.

Words that occur often enough get dense numbers per group (language); all others, and the ends of pieces, break the
text, since no phrase that reaches the least count can hold them. Each place in what remains gives one key of fixed
width: the numbers of the word there and of those behind it, padded with zeros. Tasks sort a million keys at a time by
radix passes over 16-bit digits, count the runs, cut the result at splitters taken from a sample of the keys, and send
one packed row per range and million. A range's rows are merged by the same passes; in their order the runs of the first
2, 3, ... words are the counts of all phrases of these lengths. Runs at a range's borders go on in its neighbours, so
they are sent whatever their count is and summed at last. What is left, phrases that reach the least count, is scored by joins.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from skeinflow.llm.staging import bound_batches, stage

#: Distinct words, and bytes of text, after which a task passes its counts on.
COUNT_WORDS, COUNT_BYTES = 1 << 18, 1 << 28
#: Keys that a task sorts at once, about how many a range holds, and how many a range's task takes in before it merges them.
FLUSH, RANGE, HELD = 1 << 20, 1 << 20, 1 << 20
#: Ranges at most, and keys in the sample that places their splitters, at least and for each range.
RANGES, SAMPLE, SAMPLE_RANGE = 1 << 18, 100_000, 8
#: Words and bytes of a dictionary that is broadcast; of a larger one each chunk of texts gets its own words by a join.
BROADCAST_WORDS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Group of rows without one.
UNKNOWN = "und"

# ends of pieces become a full stop, which no word holds; A-Z are lower-cased, tabs are spaces
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with b"." where a piece ends, in lists of about a megabyte."""
    line = text.translate(_TABLE)
    at = 0
    while at < len(line):
        end = line.find(b" ", at + PIECE)
        end = len(line) if end < 0 else end
        yield line[at:end].replace(b".", b" . ").split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, text) to (group, word, n); a row without a word has the number of all words."""
    found: dict[str, Counter] = defaultdict(Counter)
    size = 0

    def flush() -> pa.RecordBatch:
        groups, words, counts = [], [], []
        for group, counter in found.items():
            counter.pop(b".", None)
            groups += [group] * (len(counter) + 1)
            words += [None, *counter.keys()]
            counts += [sum(counter.values()), *counter.values()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["grp", "word", "n"])

    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for words in tokens(text := text.as_py()):
                found[group].update(words)
            size += len(text)
        if size > COUNT_BYTES or sum(map(len, found.values())) > COUNT_WORDS:
            yield flush()
            size = 0
    yield flush()


def _windows(text: bytes, get, most: int) -> Iterator[np.ndarray]:
    """Keys (rows of ``most`` numbers) of the places of a text at which two words or more stand together."""
    held = np.zeros(0, np.uint32)
    for words in tokens(text):
        ids = np.concatenate([held, np.fromiter((get(w, 0) for w in words), np.uint32, len(words))])
        ready = len(ids) - most + 1
        if ready > 0:
            yield _rows(ids, ready, most)
            held = ids[ready:]
        else:
            held = ids
    yield _rows(np.concatenate([held, np.zeros(most - 1, np.uint32)]), len(held), most)


def _rows(ids: np.ndarray, n: int, most: int) -> np.ndarray:
    keys = np.stack([ids[i : n + i] for i in range(most)], axis=1)
    for i in range(1, most):
        keys[:, i] *= keys[:, i - 1] > 0
    return keys[keys[:, 1] > 0]


def _digits(keys: np.ndarray, wide: bool) -> np.ndarray:
    """Numbers as 16-bit digits, the higher one first."""
    if not wide:
        return keys.astype(np.uint16)
    return np.stack([keys >> np.uint32(16), keys & np.uint32(0xFFFF)], axis=2).astype(np.uint16).reshape(len(keys), 2 * keys.shape[1])


def _runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, by radix passes from the last digit to the first, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.arange(len(keys), dtype=np.uint32)
    for j in range(keys.shape[1] - 1, -1, -1):
        digit = keys[:, j]
        if digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[starts], np.add.reduceat(counts, starts, dtype=np.int64)


def _texts(keys: np.ndarray) -> np.ndarray:
    """Keys as byte strings whose order is that of the keys."""
    raw = np.ascontiguousarray(keys.astype(">u2"))
    return raw.view(f"S{raw.shape[1] * 2}").ravel() if len(raw) else np.zeros(0, f"S{keys.shape[1] * 2}")


class _Sorter:
    """Collects keys and packs each FLUSH of them into a batch of (range, n, keys, counts)."""

    def __init__(self, splitters: np.ndarray, wide: bool) -> None:
        self.splitters, self.wide, self.held, self.n = splitters, wide, [], 0

    def add(self, keys: np.ndarray) -> bool:
        self.held.append(_digits(keys, self.wide))
        self.n += len(keys)
        return self.n >= FLUSH

    def flush(self) -> pa.RecordBatch:
        rows = []
        if self.n:
            keys, counts = _runs(np.concatenate(self.held), np.ones(self.n, np.uint32))
            cuts = np.concatenate([[0], np.searchsorted(_texts(keys), self.splitters), [len(keys)]])
            rows = [(r, int(b - a), keys[a:b].T.tobytes(), counts[a:b].astype(np.uint32).tobytes()) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        self.held, self.n = [], 0
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "n", "keys", "counts"])


PACKED = "part int, n int, keys binary, counts binary"


def _texts_of(batches: Iterator[pa.RecordBatch], numbers: dict) -> Iterator[tuple]:
    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield numbers.get(group, {}).get, text.as_py()


def _pack(texts: Iterator[tuple], splitters: np.ndarray, wide: bool, most: int) -> Iterator[pa.RecordBatch]:
    sorter = _Sorter(splitters, wide)
    for get, text in texts:
        for keys in _windows(text, get, most):
            if sorter.add(keys):
                yield sorter.flush()
    yield sorter.flush()


def _sample(texts: Iterator[tuple], share: float, wide: bool, most: int) -> Iterator[pa.RecordBatch]:
    for get, text in texts:
        rng = np.random.default_rng(len(text))
        for keys in _windows(text, get, most):
            some = _texts(_digits(keys[rng.random(len(keys)) < share], wide))
            yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()], pa.binary())], names=["keys"])


def _by_broadcast(shared, work, *args):
    """(group, text) under a dictionary that all tasks have."""
    return lambda batches: work(_texts_of(batches, shared.value), *args)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def _by_chunk(work, schema: pa.Schema, *args):
    """A chunk of texts with the words of it that have a number."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        get = dict(zip(words["word"].to_pylist(), words["id"].to_pylist(), strict=True)).get
        return pa.Table.from_batches(work(((get, text) for own in texts["texts"].to_pylist() for text in own), *args), schema)

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts as rows (chunk, grp, texts); a chunk's name stays once it is written."""
    from pyspark import TaskContext

    n = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = defaultdict(list)
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts[group].append(text)
        for group, own in texts.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([group], pa.string()), pa.array([own], pa.list_(pa.binary()))], names=["chunk", "grp", "texts"])
            n += 1


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, group, texts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = list({w for text in texts for some in tokens(text) for w in some} - {b"."})
            columns = [pa.array([chunk] * len(words), pa.int64()), pa.array([group] * len(words), pa.string()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "grp", "word"])


def _merged(digits: int, most: int, least: int):
    """Packed rows in order of their range to (phrase, n) for phrases of two words or more: those that reach ``least``, and
    the first and last of each length, which may go on in another range."""
    width = digits * most

    def close(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        parts.clear()
        return _runs(*whole)

    def phrases(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        differ = keys[1:] != keys[:-1]
        names, totals = [], []
        for m in range(2, most + 1):
            whole = keys[:, (m - 1) * digits : m * digits].any(axis=1)
            starts = np.flatnonzero(np.concatenate([[True], differ[:, : m * digits].any(axis=1)]))
            n = np.add.reduceat(counts, starts)
            kept = n >= least
            kept[[0, -1]] = True
            kept &= whole[starts]
            raw = np.ascontiguousarray(keys[starts[kept], : m * digits].astype(">u2")).tobytes()
            size = 2 * m * digits
            names += [raw[i : i + size] for i in range(0, len(raw), size)]
            totals.append(n[kept])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(np.concatenate(totals), pa.int64())], names=["phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held, merged = None, [], 0, 0
        for batch in batches:
            for part, n, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now:
                    if parts:
                        yield phrases(*close(parts))
                    now, parts, held, merged = part, [], 0, 0
                parts.append((np.frombuffer(keys, np.uint16).reshape(width, n).T, np.frombuffer(counts, np.uint32)))
                held += n
                if held >= max(HELD, merged):  # what repeats becomes one before more is held
                    parts = [close(parts)]
                    held, merged = 0, len(parts[0][0])
        if parts:
            yield phrases(*close(parts))

    return run


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with dense numbers from 1: their places in partitions, shifted by the rows of the partitions before."""
    placed = stage(words.withColumn("at", F.monotonically_increasing_id()), "collocations-words")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before = np.cumsum([0] + [n for _, n in sizes])
    shifts = words.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before, strict=False)], "part long, before long")
    number = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(F.broadcast(shifts), "part").select("grp", "word", "n", number.alias("id"))


def phrase_counts(df: DataFrame, text_col: str, group_col: str, min_count: int, max_words: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(totals: grp, n; words: grp, word, n, id; phrases: phrase, n; bytes of a word in a phrase), words and phrases of two
    words and more that reach ``min_count``."""
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.coalesce(df[group_col].cast("string"), F.lit(UNKNOWN)).alias("grp"), F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = docs.mapInArrow(_counted, "grp string, word binary, n long").groupBy("grp", "word").agg(F.sum("n").alias("n"))
    counts = stage(counts.filter((F.col("n") >= min_count) | F.col("word").isNull()), "collocations-counts")
    totals = counts.filter("word IS NULL").select("grp", "n")
    words = stage(_numbered(counts.filter("word IS NOT NULL")), "collocations-dictionary")
    size = words.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("places")).first()
    if size.words >= 1 << 32:
        raise ValueError("words are numbered by 32 bits")
    wide = size.words >= 1 << 16
    digits = 2 if wide else 1
    ranges = min(RANGES, size.places // RANGE + 1)
    share = min(1.0, max(SAMPLE, SAMPLE_RANGE * ranges) / max(1, size.places)) ** 0.5  # of the texts, and of a text's places
    splitters = np.zeros(0, f"S{2 * digits * max_words}")

    if size.words <= BROADCAST_WORDS and size.bytes <= BROADCAST_BYTES:
        numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in words.select("grp", "word", "id").toLocalIterator():
            numbers[r.grp][bytes(r.word)] = r.id
        shared = spark.sparkContext.broadcast(dict(numbers))
        coded = lambda part, schema, work, *args: docs.sample(part, seed=1).mapInArrow(_by_broadcast(shared, work, *args), schema) if part < 1 else docs.mapInArrow(_by_broadcast(shared, work, *args), schema)
    else:
        chunks = stage(docs.mapInArrow(_chunks, "chunk long, grp string, texts array<binary>"), "collocations-chunks")
        own = chunks.select("chunk", "grp", "texts").mapInArrow(_chunk_words, "chunk long, grp string, word binary").join(words.select("grp", "word", "id"), ["grp", "word"]).select("chunk", "word", "id")
        coded = lambda part, schema, work, *args: chunks.filter(F.rand(1) < part).groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_by_chunk(work, _arrow(schema), *args), schema)

    if ranges > 1:
        rows = coded(share, "keys binary", _sample, share, wide, max_words).collect()  # bounded by SAMPLE and RANGES
        found = np.sort(np.frombuffer(b"".join(bytes(r["keys"]) for r in rows), splitters.dtype))
        splitters = found[np.arange(1, ranges) * len(found) // ranges] if len(found) else splitters
    packed = coded(1.0, PACKED, _pack, splitters, wide, max_words)
    merged = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_merged(digits, max_words, min_count), "phrase binary, n long")
    phrases = stage(merged.groupBy("phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "collocations-phrases")
    return totals, words, phrases, 2 * digits


def collocations(df: DataFrame, text_col: str = "text", group_col: str = "lang", min_count: int = 100, max_words: int = 5, top: int = 2000) -> DataFrame:
    """Each group's first ``top`` phrases: grp, rank, phrase, a, l, r, n, score.

    Pieces end at . , ; : ! ? and at line ends, words at spaces and tabs; A-Z are lower-cased. a, l, r count the phrase's,
    its first part's and its rest's occurrences in pieces, overlaps included, n all words of the group. The score is
    floor(1000 a n / (l r)) of the cut that scores least, of such cuts the first. A phrase that stands in a longer one
    which is as frequent goes. Order: score, a, both descending, and the phrase's bytes. A null group is ``und``, a null
    text empty; a group without phrases, and an empty table, give no rows. Words may be of any length; repeated rows
    count again; other columns are ignored.
    """
    if not 2 <= max_words or min_count < 1:
        raise ValueError("two words and one occurrence at least are needed")
    spark = df.sparkSession
    totals, words, phrases, size = phrase_counts(df, text_col, group_col, min_count, max_words)
    packed = F.unhex(F.lpad(F.hex("id"), 2 * size, "0"))
    single = words.select(packed.alias("part"), F.col("n").alias("part_n"), F.col("grp"))
    sub = lambda name, start, length: F.expr(f"substring(phrase, {start}, {length})").alias(name)
    n_bytes = "octet_length(phrase)"

    # a phrase in a longer one that is as frequent stands in one of a word more that is, too
    within = phrases.filter(f"{n_bytes} > {2 * size}").select(F.explode(F.array(sub("head", 1, f"{n_bytes} - {size}"), sub("tail", size + 1, n_bytes))).alias("phrase"), F.col("n").alias("longer"))
    within = within.groupBy("phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(within, "phrase", "left").filter("longer IS NULL OR longer < n").select("phrase", F.col("n").alias("a"))
    kept = kept.withColumn("part", sub("part", 1, size)).join(single.select("part", "grp"), "part").drop("part").join(totals, "grp")

    counts = phrases.select(F.col("phrase").alias("part"), F.col("n").alias("part_n")).unionByName(single.select("part", "part_n"))
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.expr(f"{n_bytes} div {size} - 1").cast("int"))).alias("k"))
    cuts = cuts.withColumn("part", sub("part", 1, f"k * {size}")).join(counts.withColumnRenamed("part_n", "l"), "part").drop("part")
    cuts = cuts.withColumn("part", sub("part", f"k * {size} + 1", n_bytes)).join(counts.withColumnRenamed("part_n", "r"), "part").drop("part")
    wide = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    score = F.expr(f"({wide('a')} * {wide('n')} * CAST(1000 AS DECIMAL(4, 0))) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("grp", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = best.select("grp", "phrase", "a", "n", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))

    first = [F.desc("score"), F.desc("a")]
    ahead = F.rank().over(Window.partitionBy("grp", "salt").orderBy(*first))
    chosen = stage(scored.withColumn("place", ahead).filter(F.col("place") <= top).drop("place"), "collocations-chosen")
    number = F.conv(F.hex(F.expr(f"substring(phrase, at * {size} + 1, {size})")), 16, 10).cast("long")
    spelt = chosen.select("phrase", F.explode(F.sequence(F.lit(0), F.expr(f"{n_bytes} div {size} - 1").cast("int"))).alias("at"))
    spelt = spelt.select("phrase", "at", number.alias("id")).join(words.select("id", F.col("word").cast("string").alias("word")), "id")
    spelt = spelt.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = chosen.join(spelt, "phrase").withColumn("phrase", F.array_join("words.word", " "))
    for keys, name in ((["grp", "salt"], "place"), (["grp"], "rank")):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*first, "phrase"))
        named = named.withColumn(name, place.cast("long")).filter(F.col(name) <= top)
    return named.select("grp", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return collocations(docs, min_count=100, max_words=5, top=2000).withColumnRenamed("grp", "lang")


OP11_SQL = r"""
WITH pieces AS (
  SELECT doc_id, lang, row_number() OVER () AS piece, w FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
      SELECT doc_id, lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)) WHERE len(w) > 0),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, piece, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, m, w[i:i + m - 1] AS p FROM places, range(1, 6) AS t(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, p, a FROM f WHERE len(p) > 1),
covered AS (SELECT lang, p, max(a) AS longer FROM (SELECT lang, p[1:len(p) - 1] AS p, a FROM candidates UNION ALL SELECT lang, p[2:], a FROM candidates) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN covered USING (lang, p) WHERE longer IS NULL OR longer < c.a),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.p, c.a, x.a AS l, y.a AS r, n, k, 1000 * CAST(c.a AS HUGEINT) * n // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, array_to_string(p, ' ') AS phrase FROM best) QUALIFY rank <= 2000
"""
