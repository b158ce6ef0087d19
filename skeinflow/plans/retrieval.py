"""Retrieval with citations: chunk facts, evaluation, prompt and fallback text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.encoder import encode
from skeinflow.functions.keys import chunk_key, name_key
from skeinflow.functions.text import chunks
from skeinflow.operators.metrics import reciprocal_rank
from skeinflow.operators.vector_index import VectorIndex
from skeinflow.operators.vectors import cosine_topk
from skeinflow.session import small_batches
from skeinflow.sources.shared import stage

#: Characters of a chunk quoted in a prompt and in the fallback text.
PROMPT_CHARS, EXCERPT_CHARS = 600, 280
ROOT = "https://archive.example.org/filings"


def with_vectors(table: DataFrame, source_type: str) -> DataFrame:
    """A chunk table with its source type, company key and embedding."""
    small_batches(table.sparkSession)
    return table.select("*", F.lit(source_type).alias("source_type"), name_key(F.col("symbol")).alias("company_key"), encode(F.col("body_chunk")).alias("embedding"))


def chunk_table(docs: DataFrame, kind: str) -> DataFrame:
    """chunk_key, accession, symbol, chunk_index, n_tokens, body_chunk, as_of_date of documents (doc_id, lang, text).

    The document's identifier stands for the accession and the day, its language for the symbol.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("accession"), F.col("lang").alias("symbol"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int")).alias("as_of_date"), "text")
    cut = chunks(rows, "text")
    key = chunk_key(F.lit(kind), F.col("symbol"), F.col("as_of_date"), F.col("accession"), F.col("chunk_index"))
    return cut.select(key.alias("chunk_key"), "accession", "symbol", "chunk_index", "n_tokens", "body_chunk", "as_of_date")


def dim_chunk(parts: dict[str, DataFrame], types: DataFrame) -> DataFrame:
    """All chunks with their filing type."""
    every = None
    for code, df in parts.items():
        rows = df.select("chunk_key", F.col("accession").alias("filing_accession"), F.lit(code).alias("source_type"), name_key(F.col("symbol")).alias("company_key"), "chunk_index", "n_tokens", "as_of_date")
        every = rows if every is None else every.unionByName(rows)
    typed = every.join(F.broadcast(types.select("code", "filing_type_key")), F.col("source_type") == F.col("code"))
    return typed.select("chunk_key", "filing_accession", "source_type", "filing_type_key", "company_key", "chunk_index", "n_tokens", F.lit(None).cast("long").alias("page_approx"), F.lit(ROOT).alias("source_url_root"), "as_of_date")


def citations(queries: DataFrame, ids: str = "top_k_ids") -> DataFrame:
    """One row per query and cited chunk, positions from 1."""
    return queries.select("*", F.posexplode(ids).alias("_at", "chunk_id")).withColumn("rank_position", (F.col("_at") + 1).cast("long")).drop("_at", ids)


def ranked_ids(found: DataFrame) -> DataFrame:
    """query_id, top_k_ids in rank order from top-k rows; k identifiers per query."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return found.groupBy("query_id").agg(F.transform(pairs, lambda p: p["item_id"]).alias("top_k_ids"))


_corpora: dict[tuple[str, str], DataFrame] = {}


def load_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """The chunk tables of ``paths`` as one, kept in the executors' memory and disks for the session; asking again gives
    the same table. ``forget_corpora`` lets go of them."""
    key = (spark.sparkContext.applicationId, "\n".join(paths))  # a new application's tables are its own
    if key not in _corpora:
        _corpora[key] = spark.read.parquet(*paths).persist(StorageLevel.MEMORY_AND_DISK)
    return _corpora[key]


def forget_corpora() -> None:
    for table in _corpora.values():
        table.unpersist()
    _corpora.clear()


#: Symbols up to which a batch of questions filters the corpus before vectors are read.
PUSHED = 1000
#: Characters of an error kept in an answer.
ERROR_CHARS = 200

#: Found chunks up to which they are sent to the corpus for their texts.
BROADCAST_FOUND = 100_000

#: What a model is asked to do.
TASK_TEXT = "Answer in one paragraph of four to six plain sentences. Cite two chunks or more by their keys in brackets. Say nothing that chunks and attributions don't support, and say so where they contradict the prediction."

#: A reply's text, tokens in and tokens out for a prompt.
Generator = Callable[[str], tuple[str, int, int]]


def retrieve(questions: DataFrame, corpus: DataFrame | VectorIndex, k: int = 8) -> DataFrame:
    """(query_id, item_id, similarity, rank): for each question the nearest chunks that meet its own filters.

    ``questions`` holds query_id, question, symbol, as_of_date, source_types; a null of the last three filters nothing.
    ``corpus`` holds chunk_key, symbol, as_of_date, source_type, embedding. What no question can use is filtered before
    any vector is read. ``corpus`` may be an index of such a table, with symbol, as_of_date and source_type as its filters.
    """
    asked = questions.select("query_id", "symbol", "as_of_date", "source_types", encode(F.col("question")).alias("embedding"))
    span = questions.agg(F.max("as_of_date").alias("last"), F.count_if(F.col("as_of_date").isNull()).alias("open"), F.count_if(F.col("symbol").isNull()).alias("any")).first()
    where = F.lit(True)
    if span.last is not None and not span.open:
        where = where & (F.col("as_of_date") <= F.lit(span.last))
    symbols = [r.symbol for r in questions.select("symbol").distinct().limit(PUSHED + 1).collect()]
    if symbols and not span.any and len(symbols) <= PUSHED:
        where = where & F.col("symbol").isin(symbols)
    rules = {"symbol": ("equal", "symbol"), "as_of_date": ("until", "as_of_date"), "source_type": ("among", "source_types")}
    if isinstance(corpus, VectorIndex):
        return corpus.search(asked, "query_id", "embedding", k, where, rules)[0]
    return cosine_topk(asked, corpus, "query_id", "embedding", k, where=where, item_id="chunk_key", rules=rules)


def _contexts(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """``questions`` with the prediction of their symbol, day and rung: 0.5, class 0 and no attributions if there is none."""
    known = predictions.select(F.col("symbol").alias("_symbol"), F.col("trade_date").alias("_day"), F.col("model_rung").alias("_rung"), "prob_up", "predicted_class", "attributions")
    on = questions["symbol"].eqNullSafe(known["_symbol"]) & (questions["as_of_date"] == known["_day"]) & (questions["rung"] == known["_rung"])
    rows = questions.join(known, on, "left").drop("_symbol", "_day", "_rung")
    return rows.withColumns({"prob_up": F.coalesce("prob_up", F.lit(0.5)), "predicted_class": F.coalesce(F.col("predicted_class").cast("long"), F.lit(0).cast("long"))})


def _block(attributions: Column) -> Column:
    """The eight largest attributions by size, a line each; ``attributions`` is JSON."""
    entries = F.map_entries(F.from_json(attributions, "map<string,double>"))
    ranked = F.slice(F.array_sort(F.transform(entries, lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("k"), e["value"].alias("v")))), 1, 8)
    lines = F.transform(ranked, lambda e: F.concat(F.lit("  - "), e["k"], F.lit(": "), F.when(e["v"] >= 0, "+").otherwise("-"), F.replace(F.format_number(F.abs(e["v"]), 4), F.lit(","), F.lit(""))))
    return F.coalesce(F.when(F.size(lines) > 0, F.array_join(lines, "\n")), F.lit("  (no attribution available)"))


def _generated(prompts: Column, generator: Generator) -> Column:
    """struct(text, tokens_in, tokens_out, latency_ms, error) of each prompt; an error leaves the text null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for prompt in part:
                began = time.monotonic()
                try:
                    text, n_in, n_out = generator(prompt) if prompt is not None else (None, 0, 0)
                    rows.append((text, n_in, n_out, int((time.monotonic() - began) * 1000), None))
                except Exception as error:  # noqa: BLE001  whatever a model raises, the fallback answers
                    rows.append((None, 0, 0, int((time.monotonic() - began) * 1000), str(error)[:ERROR_CHARS]))
            yield pd.DataFrame(rows, columns=["text", "tokens_in", "tokens_out", "latency_ms", "error"])

    return F.pandas_udf(run, "text string, tokens_in long, tokens_out long, latency_ms long, error string")(prompts)


def answers(questions: DataFrame, corpus: DataFrame, predictions: DataFrame, k: int = 8, generator: Generator | None = None, model: str = "model") -> DataFrame:
    """query_id, question, symbol, as_of_date, rung, top_k_chunk_ids, source, llm_model, tokens_in, tokens_out, latency_ms,
    prompt, response, error for questions (query_id, question, symbol, as_of_date, source_types, rung).

    The source is "model" where ``generator`` answered, "template-fallback" where there is none or it failed, and
    "no-retrieval" where no chunk meets the filters: then nothing is generated and usage is zero.
    """
    found = stage(retrieve(questions, corpus, k), "found")  # k rows a question
    found = F.broadcast(found) if found.count() <= BROADCAST_FOUND else found  # else the whole corpus would be shuffled for them
    found = found.join(corpus.select(F.col("chunk_key").alias("item_id"), "body_chunk"), "item_id")
    cite = F.concat(F.lit("["), F.col("item_id"), F.lit("]"))
    body = F.coalesce("body_chunk", F.lit(""))
    quote = F.concat(cite, F.lit(" sim="), F.format_number("similarity", 3), F.lit(": "), F.substring(body, 1, EXCERPT_CHARS), F.lit("..."))
    each = F.struct("rank", F.col("item_id").alias("id"), cite.alias("cite"), quote.alias("quote"), F.concat(cite, F.lit(": "), F.substring(body, 1, PROMPT_CHARS)).alias("chunk"))
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(each)).alias("p"))  # k entries
    rows = _contexts(questions, predictions).join(lists, "query_id", "left")
    part = lambda name, n=None: F.transform(F.slice("p", 1, n) if n else F.col("p"), lambda x: x[name])
    way = F.when(F.col("predicted_class") == 1, "UP").otherwise("DOWN")
    who, day = F.coalesce("symbol", F.lit("any company")), F.coalesce(F.col("as_of_date").cast("string"), F.lit("any day"))
    chance = F.format_number("prob_up", 2)
    prompt = F.concat(
        F.lit("Explain a model's prediction: "), who, F.lit(" goes "), way, F.lit(" on "), day, F.lit(" with probability "), chance, F.lit(".\n\nAttributions:\n"), _block(F.col("attributions")),
        F.lit("\n\nChunks:\n"), F.array_join(part("chunk"), "\n\n"), F.lit("\n\nQuestion: "), F.col("question"),
        F.lit("\n\n" + TASK_TEXT),
    )
    fallback = F.concat(
        F.lit("The rung-"), F.col("rung").cast("string"), F.lit(" model predicts "), who, F.lit(" "), way, F.lit(" on "), day, F.lit(" with probability "), chance, F.lit(". For '"), F.col("question"),
        F.lit("' the nearest passages are "), F.array_join(part("cite", 3), ", "), F.lit(". Excerpts:\n\n"), F.array_join(part("quote", 3), "\n\n"),
    )
    some = F.col("p").isNotNull()
    rows = rows.withColumns({"prompt": F.when(some, prompt), "fallback": fallback})
    empty = F.struct(F.lit(None).cast("string").alias("text"), *[F.lit(0).cast("long").alias(c) for c in ("tokens_in", "tokens_out", "latency_ms")], F.lit(None).cast("string").alias("error"))
    rows = rows.withColumn("g", _generated(F.col("prompt"), generator) if generator else empty)
    source = F.when(~some, "no-retrieval").when(F.col("g.text").isNotNull(), "model").otherwise("template-fallback")
    reply = F.when(~some, F.concat(F.lit("Nothing is on file for "), who, F.lit(" up to "), day, F.lit("."))).otherwise(F.coalesce("g.text", "fallback"))
    usage = [F.when(some, F.col(f"g.{c}")).otherwise(F.lit(0).cast("long")).alias(c) for c in ("tokens_in", "tokens_out", "latency_ms")]
    return rows.withColumn("source", source).select(
        "query_id", "question", "symbol", "as_of_date", "rung", F.coalesce(part("id"), F.array().cast("array<string>")).alias("top_k_chunk_ids"), "source",
        F.when(F.col("source") == "model", F.lit(model)).otherwise(F.col("source")).alias("llm_model"), *usage, "prompt", reply.alias("response"), F.col("g.error").alias("error"),
    )


AUDIT = ["question", "symbol", "as_of_date", "rung", "top_k_chunk_ids", "llm_model", "tokens_in", "tokens_out", "response", "latency_ms"]


def log_queries(given: DataFrame, path: str) -> None:
    """Appends an audit row for every answer but those without retrieval."""
    given.filter("source <> 'no-retrieval'").select(F.expr("uuid()").alias("query_key"), F.current_timestamp().alias("ts"), *AUDIT).write.mode("append").parquet(path)


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, question, symbol, as_of_date, source_types, expected_substring of a file of JSON lines."""
    rows = spark.read.schema("question string, symbol string, as_of_date date, expected_substring string").json(path).filter("question IS NOT NULL")
    return rows.select(F.xxhash64("question", "symbol", "as_of_date").alias("query_id"), "question", "symbol", "as_of_date", F.lit(None).cast("array<string>").alias("source_types"), "expected_substring")


def scored_questions(found: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rr, precision, n_hits: a hit is a chunk whose key contains the question's expected_substring."""
    hits = expected.join(found, "query_id", "left").withColumn("hit", F.coalesce(F.contains("item_id", "expected_substring"), F.lit(False))).withColumn("rank", F.coalesce("rank", F.lit(1).cast("long")))
    return reciprocal_rank(hits, "query_id", "rank", "hit", k)


def summary(scored: DataFrame) -> DataFrame:
    """One row: n_queries, mrr, precision, over all questions; averages to nine digits."""
    mean = lambda c: F.round(F.sum(F.round(F.col(c) * 1e9).cast("long")).cast("double") / F.count("*").cast("double") / 1e9, 9)
    return scored.agg(F.count("*").alias("n_queries"), mean("rr").alias("mrr"), mean("precision").alias("precision"))
