"""An offline text encoder: hashed words with signs, scaled to unit length.

It stands in for a sentence encoder with the same contract (a fixed number of dimensions, unit length, an empty text is
all zeros). Any function from texts to a matrix can take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions of a vector.
DIMS = 384
#: Words whose places a worker remembers.
KNOWN = 200_000
#: Texts whose vectors a worker holds at once.
ROWS = 512

Encoder = Callable[[list[str]], np.ndarray]

_places: dict[str, tuple[int, int]] = {}


def place(word: str) -> tuple[int, int]:
    """(dimension, sign) of a word, from the first nine hexadecimal digits of its md5."""
    found = _places.get(word)
    if found is None:
        digits = md5(word.encode("utf-8", "surrogatepass")).hexdigest()
        found = int(digits[:8], 16) % DIMS, 1 if int(digits[8], 16) < 8 else -1
        if len(_places) >= KNOWN:
            _places.clear()
        _places[word] = found
    return found


def hashed(texts: list[str]) -> np.ndarray:
    """(texts, DIMS) of lower-case words between white space (space, tab, line feed, carriage return)."""
    out = np.zeros((len(texts), DIMS))
    for i, text in enumerate(texts):
        row = [0] * DIMS  # a list takes single words faster than an array
        for word in text.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
            if word:
                at, sign = _places.get(word) or place(word)
                row[at] += sign
        out[i] = row
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _lists(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def halves(text: str) -> tuple[str, str]:
    """Every second word of a text, from its first and from its second on."""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return " ".join(words[::2]), " ".join(words[1::2])


def encode_halves(df: DataFrame, id_col: str, text_col: str, encoders: dict[str, Encoder]) -> DataFrame:
    """(id, name_0, name_1 for each encoder): the vectors of a text's halves. A text is read once for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                parts = [halves(t or "") for t in batch.column(1).to_pylist()]
                sides = [[p[k] for p in parts] for k in (0, 1)]
                columns = [_lists(encoder(side)) for encoder in encoders.values() for side in sides]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    names = [f"{name}_{k}" for name in encoders for k in (0, 1)]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{n} array<double>" for n in names]]))
    return out.withColumnRenamed("id", id_col)


def encode(text: Column, encoder: Encoder = hashed) -> Column:
    """The vector of a text as array<double>; null counts as empty. Batches go through Arrow, never row by row, and come
    back ROWS at a time, however many texts a batch brings."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                texts = whole.slice(at, ROWS)
                yield _lists(encoder([t or "" for t in texts.to_pylist()]))

    return F.arrow_udf(run, "array<double>", F.ArrowUDFType.SCALAR_ITER)(text)
