"""Substring dedup by hashing of lines and the sentences in them.

Units are lines, and the sentences in them, so that a passage pasted into a longer line is still found. Units are
normalised to their words (runs of letters and digits, A-Z lower-cased) and hashed to 64 bits, lines apart from
sentences. Digests are grouped globally; the unit of the least (identifier, offset) is kept. Neighbouring repeated
sentences of a document form a span, which goes if it has PIECE_WORDS words or more. Of a shorter one those lines go
that occurred before as lines, so a line of sentences that only occurred here and there stays, and so does a stray short
sentence in its line. A repeated line of PIECE_WORDS words or more is such a span already, so only shorter lines are
hashed as lines.

Repeats within a map task are settled there, so of a hot line one row per task is shuffled; what remains is sorted by
digest and compared with its neighbours in a streaming pass. Offsets count code points of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.hashing import ALNUM, batches_of, mix, words
from skeinflow.llm.staging import bound_batches

#: Least words of a removed span that isn't made of repeated lines.
PIECE_WORDS = 12
#: Units combined at once in a map task.
CHUNK = 1 << 18

UNITS = ["digest", "doc", "row", "at", "start", "end", "words", "kind", "repeated"]
#: What a unit is: a sentence, or a line under PIECE_WORDS words.
SENTENCE, LINE = 0, 1
_ENDS = np.zeros(256, bool)
_ENDS[[ord("."), ord("!"), ord("?")]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _digests(h: np.ndarray, a: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    """Digests of the units of ``n`` words from the ``a``-th on; the words' order counts, and so does the kind of unit."""
    if not len(a):
        return np.zeros(0, np.uint64)
    at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.add.reduceat(mix(h[at] + mix(place.astype(np.uint64))), np.cumsum(n) - n) + (n + (kind << 32)).astype(np.uint64))


def units(raw: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The sentences of a buffer that hold words, in order, as (digest, first byte, end, words), and its lines under
    PIECE_WORDS words as (digest, number of the first sentence, end, words)."""
    h, begins = words(raw, ALNUM)
    if not len(h):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3), (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    after = _WHITE[raw[1:]] & _ENDS[raw[:-1]]
    cuts = np.union1d(np.flatnonzero(raw == 10) + 1, np.flatnonzero(after) + 1)
    cuts = np.concatenate(([0], cuts[(cuts > 0) & (cuts < len(raw))], [len(raw)]))
    first = np.searchsorted(begins, cuts)
    held = np.flatnonzero(np.diff(first) > 0)
    a, n = first[held], np.diff(first)[held]
    # a unit begins at its first character that is not white space
    start = cuts[held]
    black = np.flatnonzero(~_WHITE[raw])
    start = black[np.searchsorted(black, start)]
    end = black[np.searchsorted(black, cuts[held + 1]) - 1] + 1
    line = np.searchsorted(np.flatnonzero(raw == 10), start)
    heads = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    total = np.add.reduceat(n, heads)
    tails = np.concatenate((heads[1:], [len(a)])) - 1
    short = total < PIECE_WORDS
    lines = _digests(h, a[heads[short]], total[short], LINE), heads[short], end[tails[short]], total[short]
    return (_digests(h, a, n, SENTENCE), start, end, n), lines


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it; the first does."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    return np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    count = 0

    def combine() -> pa.RecordBatch:
        digest, doc, row, at, start, end, n, kind = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((at, row, doc, digest))
        fresh = _changes(digest[order], doc[order], row[order], at[order])
        order = order[fresh]
        digest = digest[order]
        repeated = np.concatenate(([False], digest[1:] == digest[:-1]))
        columns = [digest.view(np.int64), *(c[order] for c in (doc, row, at, start, end, n, kind)), repeated]
        # settled rows need no meeting place: they are dealt out by their document instead
        columns[0] = np.where(repeated, mix(columns[1].view(np.uint64)).view(np.int64), columns[0])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=UNITS)

    for batch in batches:
        docs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = [x or b"" for x in batch.column(2).to_pylist()]
        for a, b in batches_of(texts):
            raw = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
            (digest, start, end, n), (line, head, line_end, line_n) = units(raw)
            bounds = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
            owner = np.searchsorted(bounds, start, "right") - 1
            chars = np.cumsum((raw & 0xC0) != 0x80) if len(raw) else np.zeros(0, np.int64)
            before = lambda at: np.where(at > 0, chars[np.maximum(at, 1) - 1], 0) if len(chars) else at  # noqa: B023, E731
            base = before(bounds[owner])
            number = np.arange(len(owner)) - np.searchsorted(owner, owner)
            held.append([digest, docs[a + owner], rows[a + owner], number, before(start) - base, before(end) - base, n, np.full(len(n), SENTENCE)])
            owner, base = owner[head], base[head]
            held.append([line, docs[a + owner], rows[a + owner], number[head], before(start[head]) - base, before(line_end) - base, line_n, np.full(len(line), LINE)])
            count += len(digest) + len(line)
            if count >= CHUNK:
                yield combine()
                held, count = [], 0
    if count:
        yield combine()


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units settled before, and those after the first of each digest; units of equal rows count as one."""
    last = np.zeros((4, 0), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        marked = np.asarray(batch.column(8).to_pylist())
        open_ = np.flatnonzero(~marked)
        if len(open_):
            # digest, doc, row, at of the open units, after the last one of the batches before
            own = np.concatenate([last, np.stack([batch.column(i).to_numpy() for i in range(4)])[:, open_]], axis=1)
            marked[open_] = (~_changes(own[0]) & _changes(*own))[last.shape[1] :]
            last = own[:, -1:]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(1, 8)], names=UNITS[1:8]).filter(pa.array(marked))


def spans_of(run: list[tuple], lines: dict[int, int], min_words: int | None) -> list[tuple]:
    """The (start, end) to remove of a run of neighbouring repeated sentences (start, end, words), where ``lines`` has the
    end of each short repeated line by its start."""
    if sum(u[2] for u in run) >= (PIECE_WORDS if min_words is None else min_words):
        return [(run[0][0], run[-1][1])]
    out: list[tuple] = []
    until = joined = None  # the end of the line that goes, and of the one before it
    for start, end, _ in run if min_words is None else ():
        if until is None and start in lines:
            until = lines[start]
            if joined is None:
                out.append((start, until))
            else:
                out[-1] = (out[-1][0], until)
        joined = until if until == end else None
        until = None if until == end else until
    return out


def _spans(min_words: int | None):
    """Repeated units in order of (doc, row, at) to one row per document row: its spans, joined where neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, runs, lines = None, None, [], {}
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            spans = [{"start": a, "end": b} for units in runs for a, b in spans_of(units, lines, min_words)]
            if spans:
                for column, value in zip(out, (*key, spans), strict=True):
                    column.append(value)

        def flush() -> pa.RecordBatch:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), span), strict=True)], names=["doc", "row", "spans"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for doc, row, at, start, end, n, kind in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (doc, row) != key:
                    close()
                    key, last, runs, lines = (doc, row), None, [], {}
                if kind == LINE:
                    lines[start] = end
                    continue
                if last == at - 1:
                    runs[-1].append((start, end, n))
                elif last != at:
                    runs.append([(start, end, n)])
                last = at
            yield flush()
        close()
        yield flush()

    return run


def _cut(text: str, spans: list[dict]) -> str:
    """The text without its spans; white space around a cut shrinks to one line feed or space."""
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["end"]
    kept.append(text[at:])
    if len(kept) == 1:
        return text
    # each kept part's words, and the white space between two of them, one of which may be blank
    out, gap = [], kept[0][: len(kept[0]) - len(kept[0].lstrip())]
    for i, part in enumerate(kept):
        body = part.strip()
        if body:
            lead = part[: len(part) - len(part.lstrip())]
            if out:
                out.append("\n" if "\n" in gap or "\n" in lead else " ")
            elif i == 0:
                out.append(lead)
            out.append(body)
            gap = part[len(part.rstrip()) :]
        else:
            gap += part
    if out and kept[-1].strip():
        out.append(gap)
    return "".join(out)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_cut(t or "", s or []) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], names=["doc_id", "spans", "text"])


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """One row per row: doc_id, spans (array of start, end) that were removed, text (without the spans).

    The earliest occurrence is the one of the least identifier, then of the least text hash and offset; a null
    identifier ranks as the least integer. Null, empty and blank texts have no units and come back empty or as they
    are. A line goes that occurred before as a line, whatever its length, and so do neighbouring repeated sentences of
    PIECE_WORDS words or more. ``min_words``, if given, is the least number of words of every span instead, of lines and
    sentences alike; at 1 every repeated sentence goes. Rows with
    the same identifier and text count as one and share the result. Identifiers are integers; other columns are ignored;
    an empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    doc, row = F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc"), F.xxhash64(text).alias("row")
    found = df.select(doc, row, text.cast("binary").alias("body")).mapInArrow(_unit_rows, "digest long, doc long, row long, at long, start long, end long, words long, kind long, repeated boolean")
    settled = found.repartition("digest").sortWithinPartitions("digest", "doc", "row", "at")
    repeats = settled.mapInArrow(_repeats, "doc long, row long, at long, start long, end long, words long, kind long")
    placed = repeats.repartition("doc", "row").sortWithinPartitions("doc", "row", "at")
    spans = placed.mapInArrow(_spans(min_words), "doc long, row long, spans array<struct<start:bigint,end:bigint>>")
    texts = df.select(df[id_col].alias("doc_id"), text.alias("text"), doc, row)
    joined = texts.join(spans, ["doc", "row"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
    kind = df.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_cleaned, f"doc_id {kind}, spans array<struct<start:bigint,end:bigint>>, text string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cleaned = substring_dedup(docs)
    joined = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return cleaned.select("doc_id", F.size("spans").cast("long").alias("n_spans"), joined.alias("spans"), "text")
