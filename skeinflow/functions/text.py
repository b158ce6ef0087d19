"""Masking, chunking and the offline sentiment scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.bytepairs import encode, encoder

#: What counts as an e-mail address and as a phone number, and their marks.
EMAIL, EMAIL_MARK = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]"
PHONE, PHONE_MARK = r"\+?1?[\s.\-]?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}", "[PHONE]"
#: Tokens of a chunk, tokens shared with the next, fewest tokens of a chunk.
CHUNK, OVERLAP, LEAST = 500, 50, 50
#: Bytes of an Arrow batch of texts; one longer text still travels whole.
BATCH_BYTES = 4 << 20
#: Words of the offline scorer.
POSITIVE = (
    "achieve", "advance", "beat", "benefit", "best", "better", "boost", "exceed", "favorable", "gain", "gains", "good", "grow", "growth", "improve", "improved", "improvement", "increase", "increased", "innovative",
    "leading", "opportunity", "outperform", "positive", "profit", "profitable", "progress", "rebound", "record", "recovery", "rise", "robust", "solid", "strength", "strong", "stronger", "success", "successful", "surge", "upgrade",
)
NEGATIVE = (
    "adverse", "against", "bad", "bankruptcy", "breach", "closure", "concern", "decline", "decrease", "default", "deficit", "delay", "disappointing", "dispute", "downgrade", "drop", "fail", "failure", "fall", "fraud",
    "idiot", "impairment", "investigation", "lawsuit", "litigation", "lose", "loss", "losses", "miss", "negative", "pathetic", "penalty", "recall", "risk", "shortage", "stupid", "weak", "weakness", "worse", "worthless",
)
#: White space between tokens.
BLANK = "[ \\t\\n\\r]+"


def mask_pii(text: Column) -> Column:
    """E-mail addresses, then phone numbers, replaced by their marks; null becomes empty."""
    masked = F.regexp_replace(F.coalesce(text, F.lit("")), EMAIL, EMAIL_MARK)
    return F.regexp_replace(masked, PHONE, PHONE_MARK)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def chunks(df: DataFrame, text_col: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """A row per chunk of ``df`` (chunk_index, n_tokens, body_chunk): windows of ``size`` tokens that advance by
    ``size - overlap``, up to the first one with fewer than ``least`` tokens. Blank texts have no chunk."""
    step = size - overlap
    words = df.withColumn("_words", tokens(F.col(text_col)))
    # windows at 0, step, ... hold at least ``least`` tokens up to this start
    last = F.size("_words") - least
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = words.select("*", F.posexplode(starts).alias("chunk_index", "_start"))
    part = F.slice("_words", F.col("_start") + 1, F.lit(size))
    return rows.withColumn("n_tokens", F.size(part).cast("long")).withColumn("body_chunk", F.array_join(part, " ")).withColumn("chunk_index", F.col("chunk_index").cast("long")).drop("_words", "_start")


def token_chunks(df: DataFrame, text_col: str, ranks_file: bytes, pattern: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """``chunks`` by byte-pair tokens of a local rank file: chunk_index, n_tokens, body_chunk.

    A chunk's text is its tokens' bytes; a character cut at a chunk's edge becomes the replacement character. Null,
    empty and blank texts have no chunk. Texts may be of any length; chunks leave a task as rows of their own.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared = spark.sparkContext.broadcast(ranks_file)
    step = size - overlap

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(shared.value, pattern)
        kind = pa.list_(pa.struct([("n_tokens", pa.int64()), ("body_chunk", pa.string())]))
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                ids = encode(enc, text) if text and text.strip() else []
                parts = [ids[at : at + size] for at in range(0, max(0, len(ids) - least + 1), step)]
                rows.append([{"n_tokens": len(p), "body_chunk": enc.decode(p)} for p in parts])
            yield pa.array(rows, kind)

    found = F.arrow_udf(cut, "array<struct<n_tokens:bigint,body_chunk:string>>", F.ArrowUDFType.SCALAR_ITER)(F.col(text_col))
    rows = df.select("*", F.posexplode(found).alias("_at", "_chunk"))
    return rows.select(*df.columns, F.col("_at").cast("long").alias("chunk_index"), "_chunk.n_tokens", "_chunk.body_chunk")


def _hits(words: Column, known: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known))).cast("long")


#: Words of a text that a model gets.
SCORED_WORDS = 512

#: Three shares (negative, neutral, positive) of each text, that sum to one.
Scorer = Callable[[list[str]], list[tuple[float, float, float]]]


def model_sentiment(text: Column, make: Callable[[], Scorer]) -> Column:
    """``lexicon_sentiment``'s struct by a model; ``make`` loads it once in each Python worker.

    Blank texts are neutral and don't reach the model, which sees the first SCORED_WORDS words; shares are rounded to
    five digits.
    """
    kind = pa.struct([(c, pa.float64()) for c in ("pos_prob", "neu_prob", "neg_prob", "score")])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = make()
        for texts in batches:
            cut = [" ".join((t or "").split()[:SCORED_WORDS]) for t in texts.to_pylist()]
            asked = [i for i, t in enumerate(cut) if t]
            rows = [(0.0, 1.0, 0.0)] * len(cut)
            for i, row in zip(asked, scorer([cut[i] for i in asked]) if asked else [], strict=True):
                rows[i] = row
            yield pa.array([{"pos_prob": round(p, 5), "neu_prob": round(n, 5), "neg_prob": round(g, 5), "score": round(p - g, 5)} for g, n, p in rows], kind)

    return F.arrow_udf(run, "struct<pos_prob:double,neu_prob:double,neg_prob:double,score:double>", F.ArrowUDFType.SCALAR_ITER)(text)


def lexicon_sentiment(text: Column) -> Column:
    """struct(pos_prob, neu_prob, neg_prob, score): shares of the words found in the lexicon; blank texts are neutral.

    A stand-in with the contract of a three-class model: the classes sum to one and the score is pos - neg.
    """
    words = tokens(F.lower(text))
    pos, neg, n = _hits(words, POSITIVE), _hits(words, NEGATIVE), F.size(words)
    share = lambda k: F.when(n > 0, k.cast("double") / n.cast("double")).otherwise(F.lit(0.0))
    neutral = F.when(n > 0, (n - pos - neg).cast("double") / n.cast("double")).otherwise(F.lit(1.0))
    return F.struct(share(pos).alias("pos_prob"), neutral.alias("neu_prob"), share(neg).alias("neg_prob"), share(pos - neg).alias("score"))
