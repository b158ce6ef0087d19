"""The library's queries by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import text as txt
from skeinflow.functions.encoder import encode_halves, hashed
from skeinflow.functions.keys import article_id
from skeinflow.ml import folds as fd
from skeinflow.ml import sentiment as fitted
from skeinflow.ml import word_vectors
from skeinflow.operators import rangejoin
from skeinflow.operators.asof import asof_join
from skeinflow.operators.metrics import reciprocal_rank
from skeinflow.operators.quality import keep_valid, not_null, related, unique, violations
from skeinflow.operators.upsert import last_wins, upsert_columns
from skeinflow.operators.vector_index import VectorIndex
from skeinflow.operators.vectors import cosine_topk, mean_pool, own_ranks
from skeinflow.plans import dims, evaluation, fixtures, fundamentals, panel, prices, reports, retrieval, sentiment
from skeinflow.plans.oracle import lexicon, mask, sql
from skeinflow.session import table
from skeinflow.sources.landing import IngestLog
from skeinflow.sources.shared import stage, stage_path
from skeinflow.streaming.ingest import drain, file_stream
from skeinflow.streaming.keyed import KeyedTable
from skeinflow.streaming.refresh import WindowedTable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
FOLD_START, FOLD_END = date(1995, 1, 1), date(2001, 8, 1)


def query(body: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL of its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body)
        return f

    return add


# --- bars, prices, typing


@query("SELECT * FROM bars")
def daily_bars(spark, d):
    return fixtures.daily_bars(spark, d)


@query("SELECT * FROM prices")
def price_features(spark, d):
    return prices.price_features(fixtures.daily_bars(spark, d))


@query(r"""
    SELECT event_id, CAST(round(TRY_CAST(nullif(t, '') AS DECIMAL(18,6)) * 1000000) AS BIGINT) AS micro, t = '' AS blank, CAST(TRY_CAST(nullif(t, '') AS DECIMAL(18,2)) AS DOUBLE) AS value_2
    FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'nan' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS t FROM events) WHERE t IS NOT NULL AND (event_id % 2 = 0 OR t <> '')""")
def typed_projection(spark, d):
    raw = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 13 == 0, "nan").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("t"))
    kept = raw.filter("t IS NOT NULL AND (event_id % 2 = 0 OR t <> '')")
    number = "try_cast(nullif(t, '') AS decimal(18,{}))".format
    return kept.select("event_id", F.expr(f"cast(round({number(6)} * 1000000) AS bigint)").alias("micro"), (F.col("t") == "").alias("blank"), F.expr(number(2)).cast("double").alias("value_2"))


def expectations() -> dict:
    return {"quantity": F.col("l_quantity").between(1, 45), "not_returned": F.col("l_returnflag") != "R", "shipped": F.to_date("l_shipdate").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))}


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 1 AND 45 AND l_returnflag <> 'R' AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def expectations_drop(spark, d):
    return keep_valid(table(spark, d, "lineitem"), expectations()).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""
    SELECT 'quantity' AS expectation, count(*) AS n_rows, count(*) FILTER (NOT coalesce(l_quantity BETWEEN 1 AND 45, false)) AS n_broken FROM lineitem
    UNION ALL SELECT 'not_returned', count(*), count(*) FILTER (NOT coalesce(l_returnflag <> 'R', false)) FROM lineitem
    UNION ALL SELECT 'shipped', count(*), count(*) FILTER (NOT coalesce(CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31', false)) FROM lineitem""")
def expectations_report(spark, d):
    return violations(table(spark, d, "lineitem"), expectations())


@query("""
    SELECT 'nation name not null' AS test, count(*) AS n_broken FROM nation WHERE n_name IS NULL
    UNION ALL SELECT 'order key unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'line key unique', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
    UNION ALL SELECT 'nation has region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
    UNION ALL SELECT 'label has document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def schema_checks(spark, d):
    t = lambda n: table(spark, d, n)
    checks = {
        "nation name not null": not_null(t("nation"), "n_name"),
        "order key unique": unique(t("orders"), "o_orderkey"),
        "line key unique": unique(t("lineitem"), "l_orderkey"),
        "nation has region": related(t("nation"), "n_regionkey", t("region"), "r_regionkey"),
        "label has document": related(t("labels"), "doc_id", t("documents").withColumnRenamed("doc_id", "parent"), "parent"),
    }
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("test"), "n_broken")
        out = row if out is None else out.unionByName(row)
    return out


# --- upserts

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1")
def upsert_last_wins(spark, d):
    rows = table(spark, d, "lineitem").select(*LINE).withColumn("l_shipdate", F.to_date("l_shipdate"))
    return last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query("""
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN b.lang ELSE a.lang END AS lang, CASE WHEN b.doc_id IS NULL THEN a.n ELSE b.n END AS n
    FROM (SELECT doc_id, lang, n_chars AS n FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, upper(lang) AS lang, nullif(n_chars % 100, 7) AS n FROM documents WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id""")
def upsert_partial(spark, d):
    docs = table(spark, d, "documents")
    base = docs.filter("doc_id % 3 <> 0").select("doc_id", "lang", F.col("n_chars").alias("n"))
    changes = docs.filter("doc_id % 2 = 0").select("doc_id", F.upper("lang").alias("lang"), F.nullif(F.col("n_chars") % 100, F.lit(7).cast("long")).alias("n"))
    return upsert_columns(base, changes, ["doc_id"], ["n"])


# --- dimensions


@query("SELECT date_key, full_date, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, CAST(day AS BIGINT) AS day, CAST(week AS BIGINT) AS week, CAST(day_of_week AS BIGINT) AS day_of_week, is_trading_day FROM calendar")
def dim_date(spark, d):
    return dims.dim_date(spark)


@query("""
    SELECT md5(f::VARCHAR) AS date_key, f AS full_date, CAST(year(f) AS BIGINT) AS year, CAST(month(f) AS BIGINT) AS month, CAST(day(f) AS BIGINT) AS day, CAST(weekofyear(f) AS BIGINT) AS week, CAST(dayofweek(f) AS BIGINT) AS day_of_week, true AS is_trading_day
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS f FROM orders)""")
def dim_date_observed(spark, d):
    return dims.dim_date_observed(spark, d)


@query("SELECT * FROM companies")
def dim_company(spark, d):
    return dims.dim_company(spark, d)


@query("SELECT c.* FROM companies c WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = c.symbol)")
def dim_company_exists(spark, d):
    traded = fixtures.daily_bars(spark, d).select("symbol").distinct()
    return dims.dim_company(spark, d).join(traded, "symbol", "left_semi").select("company_key", "symbol", "sector_key", "sector_name")


@query("SELECT md5(lower(trim(r_name))) AS sector_key, r_name AS sector_name FROM region")
def dim_sector(spark, d):
    return dims.dim_sector(spark, d)


@query("SELECT n_name AS symbol, coalesce(r_name, 'Unknown') AS sector_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def universe(spark, d):
    return dims.universe(spark, d)


@query("SELECT * FROM types")
def dim_filing_type(spark, d):
    return dims.dim_filing_type(spark)


@query("""
    SELECT types.*, row_count FROM types JOIN (SELECT '10K' AS code, count(*) AS row_count FROM documents UNION ALL SELECT '8K', count(*) FROM events UNION ALL SELECT 'NEWS', count(*) FROM pages UNION ALL SELECT 'PRESS', count(*) FROM conversations) c
    USING (code) WHERE row_count > 0""")
def dim_filing_type_present(spark, d):
    return dims.dim_filing_type_present(spark, d)


@query("""
    SELECT name, CAST(i AS BIGINT) AS window_no, CAST(first + CAST(i * step AS INTEGER) AS DATE) AS window_start, CAST(least(first + CAST((i + 1) * step AS INTEGER) - 1, last) AS DATE) AS window_end
    FROM (VALUES ('news', DATE '1995-01-01', DATE '2001-12-31', 30), ('press', DATE '1995-01-01', DATE '1995-06-30', 60)) t(name, first, last, step), range(200) r(i) WHERE first + CAST(i * step AS INTEGER) <= last""")
def backfill_windows(spark, d):
    from skeinflow.sources.landing import backfill_windows as windows

    return windows(spark, "news", date(1995, 1, 1), date(2001, 12, 31), 30).unionByName(windows(spark, "press", date(1995, 1, 1), date(1995, 6, 30), 60))


# --- text


def _masked(name: str, key: list[str], column: str) -> None:
    def run(spark, d):
        return table(spark, d, name).select(*key, F.md5(txt.mask_pii(F.col(column))).alias("body_md5"), (txt.mask_pii(F.col(column)) != F.coalesce(column, F.lit(""))).alias("changed"))

    run.__name__ = f"mask_{name}"
    query(f"SELECT {', '.join(key)}, md5(b) AS body_md5, b <> coalesce({column}, '') AS changed FROM (SELECT *, {mask(column)} AS b FROM {name})")(run)


for _name, _key, _column in (("documents", ["doc_id"], "text"), ("pages", ["page_id"], "html"), ("conversations", ["conv_id", "turn"], "text")):
    _masked(_name, _key, _column)


@query("SELECT page_id, 'h' || page_id % 7 || '::' || 'p' || page_id || '::' || substr(md5(coalesce(url, '')), 1, 12) AS article_id FROM pages")
def article_ids(spark, d):
    return table(spark, d, "pages").select("page_id", article_id(F.concat(F.lit("h"), F.col("page_id") % 7), F.concat(F.lit("p"), F.col("page_id")), F.col("url")).alias("article_id"))


@query("SELECT * FROM chunk_rows")
def chunk_documents(spark, d):
    return retrieval.chunk_table(table(spark, d, "documents"), "10K")


@query("""
    SELECT replace(chunk_key, '10K-', source_type || '-') AS chunk_key, accession AS filing_accession, source_type, filing_type_key, md5(lower(trim(symbol))) AS company_key, chunk_index, n_tokens, CAST(NULL AS BIGINT) AS page_approx,
      'https://archive.example.org/filings' AS source_url_root, as_of_date
    FROM (SELECT *, CASE WHEN CAST(accession AS BIGINT) % 4 = 0 THEN '8K' ELSE '10K' END AS source_type FROM chunk_rows) JOIN types ON code = source_type""")
def dim_chunk(spark, d):
    docs = table(spark, d, "documents")
    parts = {"10K": retrieval.chunk_table(docs.filter("doc_id % 4 <> 0"), "10K"), "8K": retrieval.chunk_table(docs.filter("doc_id % 4 = 0"), "8K")}
    return retrieval.dim_chunk(parts, dims.dim_filing_type(spark))


@query(f"""
    SELECT doc_id, CASE WHEN n > 0 THEN CAST(p AS DOUBLE) / n ELSE 0 END AS pos_prob, CASE WHEN n > 0 THEN CAST(n - p - g AS DOUBLE) / n ELSE 1 END AS neu_prob, CASE WHEN n > 0 THEN CAST(g AS DOUBLE) / n ELSE 0 END AS neg_prob, CASE WHEN n > 0 THEN CAST(p - g AS DOUBLE) / n ELSE 0 END AS score
    FROM (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: lower(x) IN {lexicon(txt.POSITIVE)})) AS p, len(list_filter(w, lambda x: lower(x) IN {lexicon(txt.NEGATIVE)})) AS g FROM words_docs)""")
def lexicon_sentiment(spark, d):
    return table(spark, d, "documents").select("doc_id", txt.lexicon_sentiment(F.col("text")).alias("s")).select("doc_id", "s.*")


def _told(spark, d):
    """doc_id, text, label (0 negative for toxic rows, 2 positive for good ones, else 1) and whether it is held out."""
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    rows = table(spark, d, "labels").select("doc_id", label.alias("label")).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)


@query()
def fitted_sentiment(spark, d):
    """All documents by a scorer fitted to four fifths of the labelled ones."""
    model = fitted.fit(_told(spark, d).filter("NOT held_out"))
    return model.scored(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "s.*")


@query()
def fitted_sentiment_eval(spark, d):
    """label, n, accuracy on the labelled documents that were held out."""
    told = stage(_told(spark, d), "told")
    rows = fitted.fit(told.filter("NOT held_out")).scored(told.filter("held_out"), "text")
    best = F.when(F.col("s.neg_prob") >= F.greatest("s.neu_prob", "s.pos_prob"), 0).when(F.col("s.neu_prob") >= F.col("s.pos_prob"), 1).otherwise(2)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((best == F.col("label")).cast("double")), 6).alias("accuracy"))


# --- fundamentals and as-of


@query("SELECT symbol, filing_date, CAST(revenue AS BIGINT) AS revenue, CAST(gross_profit AS BIGINT) AS gross_profit, CAST(net_income AS BIGINT) AS net_income, CAST(total_assets AS BIGINT) AS total_assets, CAST(total_equity AS BIGINT) AS total_equity, CAST(free_cash_flow AS BIGINT) AS free_cash_flow FROM statements")
def fundamentals_quarterly(spark, d):
    return fundamentals.joined_statements(*fixtures.statements(spark, d)).select("symbol", "filing_date", "revenue", "gross_profit", "net_income", "total_assets", "total_equity", "free_cash_flow")


@query("SELECT * FROM funds")
def fundamentals_ttm(spark, d):
    return fundamentals.trailing(fundamentals.joined_statements(*fixtures.statements(spark, d)))


@query("SELECT symbol, trade_date, close_px, filing_date, roe, debt_eq, net_income_ttm FROM asof_funds")
def asof_fundamentals(spark, d):
    return asof_join(price_features(spark, d).select("symbol", "trade_date", "close_px"), fundamentals_ttm(spark, d), ["symbol"], "trade_date", "filing_date", ["roe", "debt_eq", "net_income_ttm"])


@query("SELECT symbol, trade_date, filing_date, roe FROM asof_funds")
def asof_rownumber(spark, d):
    """The second strategy: statements hold until the next one, days meet them in bins, a row number takes the latest."""
    return rangejoin.asof_rownumber(price_features(spark, d).select("symbol", "trade_date"), fundamentals_ttm(spark, d).select("symbol", "filing_date", "roe"), ["symbol"], "trade_date", "filing_date", ["roe"])


@query("SELECT symbol, trade_date, filing_date, roe FROM asof_funds")
def asof_bucketed(spark, d):
    """The third: the carried row with each series split by year."""
    return asof_join(price_features(spark, d).select("symbol", "trade_date"), fundamentals_ttm(spark, d), ["symbol"], "trade_date", "filing_date", ["roe"], bucket=F.year("_at"))


@query("""
    SELECT v.user_id, v.event_id AS view_id, count(*) AS n_purchases, min(p.event_id) AS first_purchase FROM (SELECT * FROM events WHERE event_type = 'view') v
    JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 7 DAY GROUP BY ALL""")
def purchases_within_a_week(spark, d):
    """A range join of its own: the purchases of the seven days from each view on."""
    events = table(spark, d, "events")
    views = events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("low"), (F.col("ts") + F.expr("INTERVAL 7 DAY")).alias("high"))
    bought = events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    pairs = rangejoin.range_join(bought, views, ["user_id"], "ts", "low", "high", ["view_id"], bin_size=7 * 86_400)
    return pairs.groupBy("user_id", "view_id").agg(F.count("*").alias("n_purchases"), F.min("event_id").alias("first_purchase"))


@query("""
    SELECT p.event_id, p.user_id, v.event_id AS view_id, CAST(v.ts AS VARCHAR) AS view_at FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_events(spark, d):
    events = table(spark, d, "events")
    views = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    out = asof_join(events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "view_ts", ["view_id"], bucket=F.to_date("_at"))
    return out.select("event_id", "user_id", "view_id", F.col("view_ts").cast("string").alias("view_at"))


# --- sentiment and panel


@query("SELECT * FROM news")
def news_daily(spark, d):
    return sentiment.news_daily(fixtures.scored(spark, d))


@query("SELECT * FROM press")
def press_daily(spark, d):
    return sentiment.press_daily(fixtures.scored(spark, d))


@query("SELECT * FROM filings")
def filings_distinct_daily(spark, d):
    return sentiment.filings_daily(fixtures.scored(spark, d))


@query("SELECT * FROM senti")
def sentiment_grid(spark, d):
    s = fixtures.scored(spark, d)
    return sentiment.sentiment_grid(dims.dim_date(spark), dims.dim_company(spark, d), sentiment.news_daily(s), sentiment.press_daily(s), sentiment.filings_daily(s))


@query("SELECT * FROM both_daily")
def sentiment_full_outer(spark, d):
    s = fixtures.scored(spark, d)
    return sentiment.full_outer(sentiment.news_daily(s), sentiment.press_daily(s))


@query("SELECT symbol, pc_date AS as_of_date, " + ", ".join(f"v{i}" for i in range(1, 65)) + " FROM pooled")
def embedding_pool(spark, d):
    return fixtures.pooled_vectors(spark, d)


@query("SELECT symbol, pc_date AS as_of_date, filing_pc1, filing_pc2, filing_pc3, filing_pc4, filing_pc5 FROM pcs")
def embedding_projection(spark, d):
    return fixtures.projected_facts(spark, d)


@query()
def embedding_facts(spark, d):
    return fixtures.embedding_facts(spark, d)


def _panel(spark, d, facts):
    """The panel with ``facts`` of the filings. Its parts are bounded by calendar and universe but stand on all orders, lines and
    events, which each of its passes would read anew: they are written once."""
    parts = {"prices": price_features, "funds": fundamentals_ttm, "grid": sentiment_grid}
    return panel.feature_panel(*[stage(f(spark, d), name) for name, f in parts.items()], stage(facts, "facts"), stage(dims.dim_company(spark, d), "companies"), SECTORS)


@query("SELECT * FROM panel")
def feature_panel(spark, d):
    return _panel(spark, d, fixtures.projected_facts(spark, d))


@query("SELECT * FROM panel_b")
def feature_panel_b(spark, d):
    return panel.feature_panel_b(price_features(spark, d), fundamentals_ttm(spark, d), sentiment_full_outer(spark, d), fixtures.projected_facts(spark, d), dims.dim_company(spark, d))


@query("SELECT count(*) AS n_rows, count(*) FILTER (as_of_date > trade_date) AS n_leaks FROM panel")
def leakage_guard(spark, d):
    return panel.leaks(feature_panel(spark, d))


# --- incremental work


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_incremental(spark, d):
    from skeinflow.sources.landing import new_rows

    return new_rows(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT event_id, user_id, CAST(date_trunc('quarter', ts) AS DATE) AS quarter, CAST(r AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('quarter', ts) ORDER BY md5(event_id::VARCHAR)) AS r FROM events) WHERE r <= 30")
def stratified_sample(spark, d):
    from skeinflow.sources.landing import stratified

    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date(F.date_trunc("quarter", "ts")).alias("quarter"))
    return stratified(rows, ["user_id", "quarter"], "event_id", 30)


# --- retrieval


@query("SELECT label, " + ", ".join(f"CAST(sum(CAST(round(CAST(embedding[{i}] AS DOUBLE) * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS v{i}" for i in range(1, 65)) + " FROM embeddings GROUP BY label")
def embedding_mean_pool(spark, d):
    return mean_pool(table(spark, d, "embeddings"), ["label"], "embedding", 64)


def _found(spark, d, k=8):
    vectors = table(spark, d, "embeddings")
    return cosine_topk(vectors.filter("vec_id % 50 = 0"), vectors, "vec_id", "embedding", k)


@query("SELECT * FROM nearest")
def cosine_top_k(spark, d):
    return _found(spark, d)


@query("SELECT * FROM nearest")
def indexed_top_k(spark, d):
    """The same through an index of all vectors, which leaves most similarities out."""
    vectors = table(spark, d, "embeddings")
    index = VectorIndex.build(vectors, stage_path(spark, "index"), "vec_id", "embedding")
    return index.search(vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding", 8)[0]


@query("""
    SELECT query_id, vec_id AS item_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS BIGINT) AS rank FROM (
      SELECT query_id, vec_id, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS similarity FROM asked CROSS JOIN embeddings WHERE label IN (1, 3))
    QUALIFY rank <= 5""")
def cosine_filtered(spark, d):
    vectors = table(spark, d, "embeddings")
    return cosine_topk(vectors.filter("vec_id % 50 = 0"), vectors, "vec_id", "embedding", 5, where=F.col("label").isin(1, 3))


@query("""
    SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0) AS rr, count(*) FILTER (hit) / 5.0::DOUBLE AS precision, count(*) FILTER (hit) AS n_hits
    FROM (SELECT n.*, e.label = a.q_label AS hit FROM nearest n JOIN asked a USING (query_id) JOIN embeddings e ON e.vec_id = n.item_id WHERE rank <= 5) GROUP BY query_id""")
def retrieval_eval(spark, d):
    label = table(spark, d, "embeddings").select("vec_id", "label")
    own, other = label.toDF("query_id", "q_label"), label.toDF("item_id", "i_label")
    hits = _found(spark, d, 5).join(own, "query_id").join(other, "item_id").withColumn("hit", F.col("q_label") == F.col("i_label"))
    return reciprocal_rank(hits, "query_id", "rank", "hit", 5)


@query("SELECT query_id, item_id AS chunk_id, rank AS rank_position, CAST(label AS BIGINT) AS label FROM nearest JOIN embeddings ON vec_id = item_id")
def rag_citations(spark, d):
    cited = retrieval.citations(retrieval.ranked_ids(_found(spark, d)))
    return cited.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("label")), "chunk_id").select("query_id", "chunk_id", "rank_position", "label")


@query("""
    SELECT count(*) AS n_queries, round(CAST(sum(CAST(round(rr * 1e9) AS BIGINT)) AS DOUBLE) / count(*) / 1e9, 9) AS mrr, round(CAST(sum(CAST(round(precision * 1e9) AS BIGINT)) AS DOUBLE) / count(*) / 1e9, 9) AS precision FROM (
      SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0) AS rr, count(*) FILTER (hit) / 5.0::DOUBLE AS precision
      FROM (SELECT n.*, e.label = a.q_label AS hit FROM nearest n JOIN asked a USING (query_id) JOIN embeddings e ON e.vec_id = n.item_id WHERE rank <= 5) GROUP BY query_id)""")
def retrieval_summary(spark, d):
    return retrieval.summary(retrieval_eval(spark, d))


def _questions(spark, d):
    """The benchmark's items as questions, some of them without a symbol, a day or a filing type."""
    i = F.col("item_id")
    symbol = F.when(i % 4 != 0, F.get(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (i % 4).cast("int")))
    day = F.when(i % 5 != 0, F.date_add(F.lit("1996-01-01").cast("date"), (i % 40 * 50).cast("int")))
    return table(spark, d, "benchmark").select(i.alias("query_id"), F.col("text").alias("question"), symbol.alias("symbol"), day.alias("as_of_date"), F.when(i % 3 == 0, F.array(F.lit("8K"))).alias("source_types"), (i % 3).alias("rung"))


def _chunks(spark, d):
    docs = table(spark, d, "documents")
    parts = [retrieval.with_vectors(retrieval.chunk_table(docs.filter(f), kind), kind) for kind, f in (("10K", "doc_id % 4 <> 0"), ("8K", "doc_id % 4 = 0"))]
    return parts[0].unionByName(parts[1])


@query("SELECT chunk_key, symbol, source_type, CAST(dim AS BIGINT) AS dim, round(CAST(w AS DOUBLE) / sqrt(CAST(sum(w * w) OVER (PARTITION BY chunk_key) AS DOUBLE)), 9) AS x FROM chunk_words WHERE w <> 0")
def chunk_embeddings(spark, d):
    """The vectors of all chunks, a row per dimension in use."""
    # outer, since Spark would have the vectors computed a second time to see whether they have dimensions
    rows = _chunks(spark, d).select("chunk_key", "symbol", "source_type", F.posexplode_outer("embedding").alias("dim", "x")).filter("x <> 0")
    return rows.select("chunk_key", "symbol", "source_type", F.col("dim").cast("long").alias("dim"), F.round("x", 9).alias("x"))


@query("SELECT query_id, item_id, similarity, rank FROM retrieved")
def question_retrieval(spark, d):
    return retrieval.retrieve(_questions(spark, d), _chunks(spark, d), 5)


@query("SELECT query_id, item_id, similarity, rank FROM retrieved")
def question_retrieval_indexed(spark, d):
    """The same through an index of the chunks, with each question's own filters."""
    index = VectorIndex.build(_chunks(spark, d), stage_path(spark, "index"), "chunk_key", "embedding", filters=["symbol", "as_of_date", "source_type"])
    return retrieval.retrieve(_questions(spark, d), index, 5)


@query("""
    SELECT CAST(query_id AS BIGINT) AS query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0) AS rr, count(*) FILTER (hit) / 5.0::DOUBLE AS precision, count(*) FILTER (hit) AS n_hits
    FROM (SELECT q.query_id, rank, coalesce(contains(item_id, '10K-' || coalesce(q.symbol, 'en')), false) AS hit FROM questions q LEFT JOIN retrieved USING (query_id)) GROUP BY query_id""")
def question_eval(spark, d):
    asked = _questions(spark, d)
    expected = asked.select("query_id", F.concat(F.lit("10K-"), F.coalesce("symbol", F.lit("en"))).alias("expected_substring"))
    return retrieval.scored_questions(retrieval.retrieve(asked, _chunks(spark, d), 5), expected, 5)


@query()
def encoder_eval(spark, d):
    """How well the halves of a document find each other (every second word of each, among all documents'), by hashed words
    and by an encoder learnt from all texts: n_queries and the mean reciprocal rank of either."""
    docs = table(spark, d, "documents")
    model = word_vectors.fit(docs).encoder(spark)
    sides = stage(encode_halves(docs, "doc_id", "text", {"hashed": hashed, "learnt": model}), "halves")
    out = None
    for name in ("hashed", "learnt"):
        rows = own_ranks(sides, "doc_id", f"{name}_0", f"{name}_1", 10, F.col("doc_id") % 50 == 0).withColumn("hit", F.col("rank").isNotNull())
        ranks = reciprocal_rank(rows.withColumn("rank", F.coalesce("rank", F.lit(1).cast("long"))), "query_id", "rank", "hit", 10)
        mean = ranks.agg(F.lit(name).alias("encoder"), F.count("*").alias("n_queries"), F.round(F.avg("rr"), 6).alias("mrr"))
        out = mean if out is None else out.unionByName(mean)
    return out


#: SQL of the answers: each question with its cited chunks and the prediction of its symbol, day and rung.
_ANSWERED = """
    SELECT q.query_id, q.rung, n, coalesce(ids, '') AS ids, question, cites, quotes, chunks, coalesce(q.symbol, 'any company') AS who, coalesce(q.as_of_date::VARCHAR, 'any day') AS day,
      CASE WHEN coalesce(p.predicted_class, 0) = 1 THEN 'UP' ELSE 'DOWN' END AS way, format('{:.2f}', coalesce(p.prob_up, 0.5::DOUBLE)) AS chance, coalesce(block, '  (no attribution available)') AS block
    FROM questions q LEFT JOIN (
      SELECT query_id, count(*) AS n, string_agg(item_id, ',' ORDER BY rank) AS ids, string_agg('[' || item_id || ']', ', ' ORDER BY rank) FILTER (rank <= 3) AS cites,
        string_agg('[' || item_id || '] sim=' || format('{:.3f}', similarity) || ': ' || substr(body_chunk, 1, 280) || '...', chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 3) AS quotes,
        string_agg('[' || item_id || ']: ' || substr(body_chunk, 1, 600), chr(10) || chr(10) ORDER BY rank) AS chunks
      FROM retrieved JOIN all_chunks ON chunk_key = item_id GROUP BY query_id) f USING (query_id)
    LEFT JOIN (SELECT ['de', 'en', 'es', 'fr'][CAST(n_nationkey % 4 AS BIGINT) + 1] AS symbol, trade_date, model_rung, prob_up, predicted_class, block FROM preds LEFT JOIN attributed USING (symbol, trade_date, model_rung) JOIN nation ON n_name = preds.symbol WHERE n_nationkey < 4) p
      ON p.symbol IS NOT DISTINCT FROM q.symbol AND p.trade_date = q.as_of_date AND p.model_rung = q.rung"""
_FALLBACK = "'The rung-' || rung || ' model predicts ' || who || ' ' || way || ' on ' || day || ' with probability ' || chance || '. For ' || chr(39) || question || chr(39) || ' the nearest passages are ' || cites || '. Excerpts:' || chr(10) || chr(10) || quotes"
_TASK_TEXT = retrieval.TASK_TEXT.replace("'", "''")


def _answers(spark, d):
    asked = _questions(spark, d)
    symbols = table(spark, d, "nation").filter("n_nationkey < 4").select(F.col("n_name").alias("symbol"), F.get(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("n_nationkey") % 4).cast("int")).alias("lang"))
    known = evaluation.logistic_predictions(feature_panel(spark, d), attributions=True).join(F.broadcast(symbols), "symbol")
    known = known.select(F.col("lang").alias("symbol"), "trade_date", "model_rung", "prob_up", "predicted_class", "attributions")
    return retrieval.answers(asked, _chunks(spark, d), known, 5)


@query(f"""
    SELECT query_id, rung, CASE WHEN n IS NULL THEN 'no-retrieval' ELSE 'template-fallback' END AS source, ids, CASE WHEN n IS NULL THEN 'Nothing is on file for ' || who || ' up to ' || day || '.' ELSE {_FALLBACK} END AS response
    FROM ({_ANSWERED})""")
def rag_answers(spark, d):
    return _answers(spark, d).select("query_id", "rung", "source", F.array_join("top_k_chunk_ids", ",").alias("ids"), "response")


@query(f"SELECT query_id, {_FALLBACK} AS response FROM ({_ANSWERED}) WHERE n IS NOT NULL")
def rag_fallback_text(spark, d):
    return _answers(spark, d).filter("source = 'template-fallback'").select("query_id", "response")


@query(f"""
    SELECT query_id, 'Explain a model' || chr(39) || 's prediction: ' || who || ' goes ' || way || ' on ' || day || ' with probability ' || chance || '.' || chr(10) || chr(10) || 'Attributions:' || chr(10) || block || chr(10) || chr(10)
      || 'Chunks:' || chr(10) || chunks || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || '{_TASK_TEXT}' AS prompt
    FROM ({_ANSWERED}) WHERE n IS NOT NULL""")
def rag_prompt(spark, d):
    return _answers(spark, d).filter("prompt IS NOT NULL").select("query_id", "prompt")


@query()
def chunk_documents_bpe(spark, d):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return txt.token_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", ranks, public_tokenizers.PATTERN).select("doc_id", "chunk_index", "n_tokens", "body_chunk")


# --- folds, evaluation, backtest


def _folds(spark):
    return fd.folds_frame(spark, fd.walk_forward(FOLD_START, FOLD_END))


@query("SELECT fold_id, CAST(train_start AS DATE) AS train_start, CAST(train_end AS DATE) AS train_end, test_start, CAST(test_end AS DATE) AS test_end FROM fold_rows")
def walkforward_folds(spark, d):
    return _folds(spark)


def _predictions(spark, d):
    return evaluation.logistic_predictions(feature_panel(spark, d))


def _assigned(spark, d):
    return fd.assign(_predictions(spark, d), _folds(spark))


@query("SELECT date_key, company_key, symbol, trade_date, model_rung, prob_up, predicted_class, y_5d_up FROM preds")
def predictions(spark, d):
    return _predictions(spark, d)


@query("SELECT symbol, trade_date, model_rung, prob_up, fold_id FROM assigned")
def fold_assignment(spark, d):
    return _assigned(spark, d).select("symbol", "trade_date", "model_rung", "prob_up", "fold_id")


@query("SELECT model_rung, fold_id, n, n_pos, auc FROM aucs")
def fold_auc(spark, d):
    return evaluation.fold_auc(_assigned(spark, d))


@query("SELECT model_rung, fold_id, count(*) AS n, CAST(count(*) FILTER (predicted_class = y_5d_up) AS DOUBLE) / count(*) AS accuracy FROM assigned GROUP BY ALL")
def fold_accuracy(spark, d):
    return evaluation.fold_accuracy(_assigned(spark, d))


@query("""
    SELECT count(*) AS n, coalesce(sum(rk) FILTER (dd > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (dd < 0), 0) AS w_minus, least(coalesce(sum(rk) FILTER (dd > 0), 0), coalesce(sum(rk) FILTER (dd < 0), 0)) AS statistic FROM (
      SELECT dd, CAST(rank() OVER (ORDER BY round(abs(dd), 9)) + (count(*) OVER (PARTITION BY round(abs(dd), 9)) - 1) / 2.0 AS DOUBLE) AS rk FROM (
        SELECT round(b.auc - a.auc, 9) AS dd FROM aucs a JOIN aucs b ON a.fold_id = b.fold_id WHERE a.model_rung = 1 AND b.model_rung = 2) WHERE dd <> 0)""")
def wilcoxon_statistic(spark, d):
    return evaluation.rung_test(fold_auc(spark, d))


@query("""
    SELECT * FROM (
      SELECT model_rung, fold_id, 'accuracy' AS metric, CAST(count(*) FILTER (predicted_class = y_5d_up) AS DOUBLE) / count(*) AS value FROM assigned GROUP BY ALL
      UNION ALL SELECT model_rung, fold_id, 'n_test_rows', CAST(count(*) AS DOUBLE) FROM assigned GROUP BY ALL UNION ALL SELECT model_rung, fold_id, 'test_auc', auc FROM aucs)""")
def run_metrics(spark, d):
    return evaluation.run_metrics(_assigned(spark, d))


@query()
def wilcoxon_chance(spark, d):
    return evaluation.rung_chance(fold_auc(spark, d))


def _traded(spark, d):
    """The synthetic bars jump by hundreds of per cent a day, so baskets trade at the 50-row average."""
    return price_features(spark, d).withColumn("close_px", F.col("sma_50"))


def _pnl(spark, d):
    return evaluation.backtest(_assigned(spark, d), _traded(spark, d))


def _kept_pnl(spark, d):
    """The backtest as a stage table, for what reads it more than once."""
    from skeinflow.sources.shared import stage

    return stage(_pnl(spark, d), "pnl")


@query("SELECT * FROM pnl")
def backtest_pnl(spark, d):
    return _pnl(spark, d)


@query("""
    SELECT model_rung, trade_date, round(ret - CAST(len(list_filter(basket, lambda x: NOT list_contains(old, x))) + len(list_filter(old, lambda x: NOT list_contains(basket, x))) AS DOUBLE) / 10.0::DOUBLE * 0.0005::DOUBLE, 6) AS net_ret FROM (
      SELECT *, coalesce(lag(basket) OVER (PARTITION BY model_rung ORDER BY trade_date), []) AS old FROM (
        SELECT model_rung, trade_date, CAST(sum(CAST(round(y_5d_logret * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS ret, list(symbol) AS basket FROM (
          SELECT * FROM (SELECT a.*, y_5d_logret, dense_rank() OVER (PARTITION BY model_rung ORDER BY a.trade_date) - 1 AS day_no FROM assigned a JOIN panel_b b ON a.date_key = b.date_key AND a.company_key = b.company_key WHERE y_5d_logret IS NOT NULL)
          WHERE day_no % 5 = 0 QUALIFY row_number() OVER (PARTITION BY model_rung, trade_date ORDER BY prob_up DESC, symbol) <= 5) GROUP BY ALL))""")
def backtest_pnl_b(spark, d):
    return evaluation.backtest_log(feature_panel_b(spark, d), _assigned(spark, d))


def _bench(spark, d, pnl):
    return evaluation.benchmark(_traded(spark, d), pnl)


@query("SELECT * FROM bench")
def benchmark_eqw(spark, d):
    return _bench(spark, d, _kept_pnl(spark, d))


def _pnl_bench(spark, d):
    pnl = _kept_pnl(spark, d)
    return evaluation.with_benchmark(pnl, _bench(spark, d, pnl))


@query("SELECT * FROM pnl_bench")
def backtest_with_benchmark(spark, d):
    return _pnl_bench(spark, d)


@query("""
    SELECT model_rung, count(DISTINCT trade_date) AS n_periods, arg_max(cum_net_ret, trade_date) AS final_cum, round(m * 50.4::DOUBLE * 100, 4) AS ann_ret_pct, round(CASE WHEN count(*) > 1 THEN m / greatest(sqrt(CAST(count(*) * s2 - s1 * s1 AS DOUBLE) / (CAST(count(*) AS DOUBLE) * (count(*) - 1))) / 1e6, 1e-9) * sqrt(50.4::DOUBLE) END, 4) AS sharpe FROM (
      SELECT *, sum(u) OVER w AS s1, sum(u::HUGEINT * u) OVER w AS s2, CAST(sum(u) OVER w AS DOUBLE) / count(*) OVER w / 1e6 AS m FROM (SELECT *, CAST(round(net_ret * 1e6) AS BIGINT) AS u FROM pnl) WINDOW w AS (PARTITION BY model_rung))
    GROUP BY model_rung, s1, s2, m""")
def backtest_summary(spark, d):
    return evaluation.summary(_pnl(spark, d))


# --- reports


@query("SELECT trade_date, model_rung, cum_net_ret, CASE WHEN row_number() OVER (PARTITION BY trade_date ORDER BY model_rung) = 1 THEN benchmark_cum END AS benchmark FROM pnl_bench")
def report_cumulative(spark, d):
    return reports.cumulative(_pnl_bench(spark, d))


@query("""
    SELECT model_rung, trade_date, p.symbol, sector_name, prob_up FROM preds p JOIN companies USING (company_key) WHERE (model_rung, trade_date) IN (SELECT (model_rung, max(trade_date)) FROM preds GROUP BY model_rung)
    QUALIFY row_number() OVER (PARTITION BY model_rung ORDER BY prob_up DESC, p.symbol) <= 5""")
def report_top5(spark, d):
    return reports.top5(_predictions(spark, d), dims.dim_company(spark, d))


@query("""
    SELECT sector_name, CAST(sum(CAST(round(prob_up * 1e5) AS BIGINT)) AS DOUBLE) / count(*) / 1e5 AS avg_prob, count(*) AS n FROM preds JOIN companies USING (company_key)
    WHERE model_rung = 2 AND trade_date = (SELECT max(trade_date) FROM preds WHERE model_rung = 2) GROUP BY sector_name""")
def report_sector(spark, d):
    return reports.sectors(_predictions(spark, d), dims.dim_company(spark, d))


@query("""
    SELECT symbol, prob_up, prob_up >= CASE WHEN len(ps) >= 5 THEN ps[5] ELSE ps[-1] END AS in_top FROM (
      SELECT symbol, prob_up, list_reverse_sort(list(prob_up) OVER ()) AS ps FROM preds WHERE model_rung = 2 AND trade_date = (SELECT max(trade_date) FROM preds WHERE model_rung = 2))""")
def report_distribution(spark, d):
    return reports.distribution(_predictions(spark, d))


@query("""
    SELECT symbol, rung_1, rung_2, round(rung_2 - rung_1, 5) AS delta FROM (
      SELECT symbol, max(prob_up) FILTER (model_rung = 1) AS rung_1, max(prob_up) FILTER (model_rung = 2) AS rung_2 FROM preds WHERE model_rung IN (1, 2) AND trade_date = (SELECT max(trade_date) FROM preds WHERE model_rung IN (1, 2)) GROUP BY symbol)
    ORDER BY greatest(rung_1, rung_2) DESC, symbol LIMIT 10""")
def report_rung_pivot(spark, d):
    return reports.rung_pivot(_predictions(spark, d))


@query("""
    SELECT s.symbol, p.model_rung, coalesce(p.prob_up, 0.5) AS prob_up, coalesce(p.predicted_class, 0) AS predicted_class
    FROM (SELECT n_name AS symbol FROM nation) s LEFT JOIN (SELECT * FROM preds WHERE trade_date = DATE '2000-01-11' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY model_rung DESC) = 1) p ON p.symbol = s.symbol""")
def report_lookup(spark, d):
    return reports.lookup(_predictions(spark, d), dims.universe(spark, d), "2000-01-11")


@query("SELECT trade_date, p.symbol, sector_name, model_rung, prob_up, predicted_class FROM preds p JOIN companies USING (company_key) WHERE trade_date = (SELECT max(trade_date) FROM preds WHERE model_rung = 2)")
def report_latest(spark, d):
    return reports.latest_at_rung(_predictions(spark, d), dims.dim_company(spark, d))


@query("SELECT symbol, sector_name FROM companies")
def lookup_companies(spark, d):
    return reports.companies(dims.dim_company(spark, d))


@query("SELECT DISTINCT trade_date FROM preds WHERE symbol = (SELECT min(n_name) FROM nation)")
def lookup_days(spark, d):
    return reports.days_of(_predictions(spark, d), table(spark, d, "nation").agg(F.min("n_name").alias("symbol")))


@query("SELECT model_rung, prob_up, predicted_class FROM preds WHERE symbol = (SELECT min(n_name) FROM nation) AND trade_date = DATE '2000-01-11'")
def lookup_predictions(spark, d):
    return reports.predictions_of(_predictions(spark, d), table(spark, d, "nation").agg(F.min("n_name").alias("symbol")), "2000-01-11")


_LATEST = "SELECT p.*, sector_name FROM preds p JOIN companies USING (company_key) WHERE trade_date = (SELECT max(trade_date) FROM preds WHERE model_rung = 2)"


def _panels(spark, d):
    return reports.panels(report_latest(spark, d))


@query(f"SELECT model_rung, trade_date, symbol, sector_name, prob_up FROM ({_LATEST}) QUALIFY row_number() OVER (PARTITION BY model_rung ORDER BY prob_up DESC, symbol) <= 5")
def panel_top5(spark, d):
    return _panels(spark, d)["top5"]


@query(f"SELECT sector_name, CAST(sum(CAST(round(prob_up * 1e5) AS BIGINT)) AS DOUBLE) / count(*) / 1e5 AS avg_prob, count(*) AS n FROM ({_LATEST}) WHERE model_rung = 2 GROUP BY sector_name")
def panel_sectors(spark, d):
    return _panels(spark, d)["sectors"]


@query(f"SELECT symbol, prob_up, prob_up >= CASE WHEN len(ps) >= 5 THEN ps[5] ELSE ps[-1] END AS in_top FROM (SELECT symbol, prob_up, list_reverse_sort(list(prob_up) OVER ()) AS ps FROM ({_LATEST}) WHERE model_rung = 2)")
def panel_distribution(spark, d):
    return _panels(spark, d)["distribution"]


WEIGHTS = {"bb_z": 1.0, "vol_20d": -2.0, "log_ret_1d": 100.0, "macd_hist": 0.001}


@query("""
    SELECT price_key, feature, weight, CAST(row_number() OVER (PARTITION BY price_key ORDER BY weight, feature) AS BIGINT) AS place FROM (
      SELECT * FROM (SELECT price_key, unnest(['bb_z', 'vol_20d', 'log_ret_1d', 'macd_hist']) AS feature, unnest([bb_z * 1.0::DOUBLE, vol_20d * -2.0::DOUBLE, log_ret_1d * 100.0::DOUBLE, macd_hist * 0.001::DOUBLE]) AS weight FROM panel)
      QUALIFY row_number() OVER (PARTITION BY price_key ORDER BY abs(weight) DESC, feature) <= 3)""")
def attribution_topn(spark, d):
    pairs = [x for name, w in WEIGHTS.items() for x in (F.lit(name), F.col(name) * F.lit(w))]
    return reports.attribution_top(feature_panel(spark, d).select("price_key", F.create_map(*pairs).alias("w")), "price_key", "w", 3)


# --- streams


@query(f"SELECT doc_id, md5(b) AS body_md5 FROM (SELECT *, {mask('text')} AS b FROM documents)")
def stream_masked(spark, d):
    schema = table(spark, d, "documents").schema
    rows = file_stream(spark, f"{d}/documents.parquet*", schema)
    out, mark = stage_path(spark, "masked"), stage_path(spark, "masked-offsets")
    drain(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(txt.mask_pii(F.col("text"))).alias("body_md5")), out, mark)
    return spark.read.schema("doc_id long, body_md5 string").parquet(out)


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, CAST(max(ts) AS VARCHAR) AS at FROM events GROUP BY ALL")
def stream_scd1(spark, d):
    rows = file_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema, as_text=False)
    current = KeyedTable(spark, stage_path(spark, "scd1"), "user_id long, event_type string, event_id long, ts timestamp", ["user_id", "event_type"], ["ts", "event_id"])
    current.follow(rows.select("user_id", "event_type", "event_id", "ts"), stage_path(spark, "scd1-offsets"))
    return current.current().select("user_id", "event_type", "event_id", F.col("ts").cast("string").alias("at"))


@query("""
    SELECT user_id, event_id, event_type, CAST(ts AS VARCHAR) AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""")
def stream_scd1_late(spark, d):
    """Changes that come out of order in several batches, where an error takes its user out; the last batch comes twice."""
    landed, mark = stage_path(spark, "late"), stage_path(spark, "late-offsets")
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    current = KeyedTable(spark, stage_path(spark, "late-keys"), events.schema, ["user_id"], ["ts", "event_id"], deleted="event_type = 'error'")
    for part in range(3):
        own = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part)
        own.write.mode("append").parquet(landed)
        current.follow(spark.readStream.schema(events.schema).parquet(landed), mark)
    current.apply(own, 2)
    return current.current().select("user_id", "event_id", "event_type", F.col("ts").cast("string").alias("at"))


# --- committed tables


@query("SELECT 'orders' AS source, CAST(year(o_orderdate) AS VARCHAR) AS window_key, count(*) AS row_count FROM orders GROUP BY ALL")
def ingest_log(spark, d):
    """Orders land year by year, the first of them half at first; the log has a row for each year."""
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    root, log = stage_path(spark, "landed"), IngestLog(spark, stage_path(spark, "log"))
    years = sorted(r.year for r in orders.select("year").distinct().collect())
    log.land(orders.filter((F.col("year") == years[0]) & (F.col("o_orderkey") % 2 == 0)), f"{root}/{years[0]}", "orders", None, str(years[0]))
    for year in years:
        log.land(orders.filter(F.col("year") == year), f"{root}/{year}", "orders", None, str(year))
    return log.read().select("source", "window_key", "row_count")


@query("SELECT model_rung, trade_date, symbol, prob_up, predicted_class FROM preds")
def kept_predictions(spark, d):
    """Rungs kept one by one in a committed table, one of them again in place of what it had."""
    rows = stage(_predictions(spark, d), "predictions")
    path = stage_path(spark, "kept")
    evaluation.keep_predictions(rows.filter("model_rung = 1").withColumn("prob_up", F.lit(0.5)), path)
    for rung in (0, 1, 2):
        kept = evaluation.keep_predictions(rows.filter(F.col("model_rung") == rung), path)
    return evaluation.labelled(kept, rows.select("date_key", "company_key", "symbol", "y_5d_up").distinct()).select("model_rung", "trade_date", "symbol", "prob_up", "predicted_class")


@query("SELECT * FROM prices")
def refreshed_prices(spark, d):
    """The features kept up to date: first without some bars and with others wrong, then refreshed to all bars as they are."""
    bars = stage(fixtures.daily_bars(spark, d), "bars")
    chance = F.pmod(F.xxhash64("symbol", "trade_date"), F.lit(200))
    early = bars.filter(chance != 0).withColumn("close_px", F.when(chance == 1, F.col("close_px") + 1).otherwise(F.col("close_px")))
    kept = WindowedTable(spark, stage_path(spark, "refreshed"), ["symbol"], "trade_date", 50, prices.price_features, bars)
    kept.refresh(early)
    kept.refresh(bars)
    return kept.current()


# --- models (approximations of models that aren't available offline; no SQL)


@query()
def pca_components(spark, d):
    from skeinflow.ml.pca import components

    out, _ = components(table(spark, d, "embeddings"), "embedding")
    return out.select("vec_id", *[f"filing_pc{i}" for i in range(1, 6)])


def _rung0(spark, d, rows):
    from skeinflow.ml import autoregression

    return autoregression.walk_forward(rows, _folds(spark), most=None)


@query()
def rung0_ar(spark, d):
    return _rung0(spark, d, stage(feature_panel(spark, d), "panel"))


STRUCTURED = [*panel.PRICE_FEATURES, *panel.RATIOS, *panel.PROXIES]


def _fitted_panel(spark, d):
    """The panel with the true components of the filings."""
    return _panel(spark, d, fixtures.embedding_facts(spark, d).drop("company_key", "fact_embedding_key"))


def _flags():
    return [f"is_{s.lower().replace(' ', '_')}" for s in SECTORS]


@query()
def feature_panel_pca(spark, d):
    return _fitted_panel(spark, d)


def _rung1(spark, d, rows):
    from skeinflow.ml import trees

    return trees.walk_forward(rows, _folds(spark), STRUCTURED, 1, trees.RUNG_1)


@query()
def rung1_trees(spark, d):
    return _rung1(spark, d, stage(feature_panel(spark, d), "panel"))


@query()
def fold_components(spark, d):
    """The components of each company's filings as each fold may know them: its basis ends with its training time."""
    from skeinflow.ml import pca

    return pca.fold_components(fixtures.filing_vectors(spark, d), "as_of_date", "vector", _folds(spark))


def _rung2(spark, d, rows):
    from skeinflow.ml import trees

    known = stage(fold_components(spark, d).drop("symbol"), "fold-components")
    return trees.walk_forward(rows, _folds(spark), [*STRUCTURED, *panel.SENTIMENT, *panel.PCS, *_flags(), *panel.CROSSES], 2, trees.RUNG_2, known=known)


@query()
def rung2_trees(spark, d):
    return _rung2(spark, d, stage(feature_panel(spark, d), "panel"))


def _kept(spark, d):
    """The fitted rungs' predictions from the table that they are kept in, with their labels."""
    path, rows = stage_path(spark, "predictions"), stage(feature_panel(spark, d), "panel")
    for rung in (_rung0, _rung1, _rung2):
        kept = evaluation.keep_predictions(rung(spark, d, rows), path)
    days = rows.select("date_key", "company_key", "symbol", "trade_date", "y_5d_up")
    return evaluation.labelled(kept.drop("trade_date"), days).join(days.select("date_key", "trade_date").distinct(), "date_key")


@query()
def fitted_backtest(spark, d):
    """The backtest on the fitted rungs' own predictions."""
    return evaluation.backtest(_kept(spark, d), _traded(spark, d))


@query()
def attribution_json(spark, d):
    """The attributions of the first rung's rows, through JSON and back."""
    rows = rung1_trees(spark, d).filter("attributions IS NOT NULL").withColumn("key", F.concat_ws("|", "fold_id", "date_key", "company_key"))
    return reports.attribution_top(rows.select("key", reports.decoded(F.col("attributions")).alias("w")), "key", "w", 10)


@query(f"""
    SELECT doc_id, symbol, md5(lower(trim(symbol))) AS company_key, p AS published_at, CAST(TRY_CAST(p AS TIMESTAMP) AS DATE) AS trade_date, CASE WHEN n > 0 THEN CAST(a AS DOUBLE) / n ELSE 0 END AS pos_prob, CASE WHEN n > 0 THEN CAST(n - a - g AS DOUBLE) / n ELSE 1 END AS neu_prob,
      CASE WHEN n > 0 THEN CAST(g AS DOUBLE) / n ELSE 0 END AS neg_prob, CASE WHEN n > 0 THEN CAST(a - g AS DOUBLE) / n ELSE 0 END AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('quarter', TRY_CAST(p AS TIMESTAMP)) ORDER BY md5(doc_id::VARCHAR)) AS r FROM (
      SELECT doc_id, lang AS symbol, CASE WHEN doc_id % 10 = 0 THEN 'unknown' ELSE '2024-0' || (doc_id % 9 + 1) || '-15 10:00:00' END AS p, len(w) AS n, len(list_filter(w, lambda x: lower(x) IN {lexicon(txt.POSITIVE)})) AS a, len(list_filter(w, lambda x: lower(x) IN {lexicon(txt.NEGATIVE)})) AS g
      FROM words_docs WHERE doc_id NOT IN (SELECT doc_id FROM labels))) WHERE r <= 30""")
def score_incremental(spark, d):
    from skeinflow.plans.scoring import score_new

    published = F.when(F.col("doc_id") % 10 == 0, "unknown").otherwise(F.concat(F.lit("2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-15 10:00:00")))
    articles = table(spark, d, "documents").select("doc_id", F.col("lang").alias("symbol"), published.alias("published_at"), "text")
    return score_new(articles, table(spark, d, "labels"), "doc_id", "text", txt.lexicon_sentiment, 30)
