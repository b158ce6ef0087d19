"""The market concepts of the plans, read from the synthetic star schema.

A company is a nation, a sector a region. Bars are the orders of a nation's customers per day, statements the line items
of its suppliers per quarter, scored articles the events; these lie in January 2024 and are moved back by SHIFT days, so
that they meet the bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.exact import units
from skeinflow.session import table
from skeinflow.sources.shared import stage

#: Days from the events to the bars.
SHIFT = 8766
#: The calendar of the plans.
FIRST_DAY, LAST_DAY = "1995-01-01", "2001-12-31"


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trade_date, open_px, high_px, low_px, close_px, volume."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    named = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")
    rows = orders.join(named, orders.o_custkey == named.c_custkey)
    price = F.col("o_totalprice")
    return rows.groupBy(F.col("n_name").alias("symbol"), F.to_date("o_orderdate").alias("trade_date")).agg(
        F.min_by(price, "o_orderkey").alias("open_px"), F.max(price).alias("high_px"), F.min(price).alias("low_px"), F.max_by(price, "o_orderkey").alias("close_px"), F.count("*").alias("volume")
    )


def statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(income, balance, cash flow) per (symbol, filing_date), whole ten-thousandths; every seventh balance is missing."""
    line, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    named = supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", "n_name")
    price, off, tax = units(F.col("l_extendedprice"), 100), units(F.col("l_discount"), 100), units(F.col("l_tax"), 100)
    rows = line.select("l_suppkey", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("filing_date"), (price * (100 - off)).alias("net"), (price * tax).alias("duty"), (price * off).alias("rebate"), "l_returnflag", "l_linestatus")
    by = rows.join(named, rows.l_suppkey == named.s_suppkey).groupBy(F.col("n_name").alias("symbol"), "filing_date")
    flag = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("net")).otherwise(0))
    sums = by.agg(
        F.count("*").alias("n"), F.sum("net").alias("revenue"), flag("l_returnflag", "N").alias("kept"), flag("l_returnflag", "R").alias("returned"),
        flag("l_linestatus", "F").alias("filled"), F.sum("duty").alias("duty"), F.sum("rebate").alias("rebate"),
    )
    key = ["symbol", "filing_date"]
    income = sums.select(*key, "revenue", (F.col("revenue") - F.col("returned")).alias("gross_profit"), (F.col("filled") - F.col("duty")).alias("operating_income"), (F.col("kept") - F.col("returned")).alias("net_income"), (F.col("filled") - F.col("rebate")).alias("ebitda"))
    balance = sums.filter(F.col("n") % 7 != 0).select(*key, (F.col("revenue") + F.col("duty")).alias("total_assets"), (F.col("returned") + F.col("duty")).alias("total_liabilities"), (F.col("revenue") - 2 * F.col("returned")).alias("total_equity"), F.col("duty").alias("total_debt"), F.col("rebate").alias("cash"))
    flows = sums.select(*key, (F.col("kept") - F.col("rebate")).alias("free_cash_flow"), (F.col("kept") + F.col("duty")).alias("operating_cash_flow"))
    return income, balance, flows


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, symbol, trade_date, kind (news, press, 8K), accession, pos, neu, neg, score in thousandths."""
    events, nation = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    cents = units(F.col("value"), 100)
    pos, neg = F.pmod(cents, F.lit(601)), F.pmod(cents * 7, F.lit(400))
    kind = F.when(F.col("event_type").isin("click", "view"), "news").when(F.col("event_type") == "error", "8K").otherwise("press")
    rows = events.select("event_id", "user_id", F.date_sub(F.to_date("ts"), SHIFT).alias("trade_date"), kind.alias("kind"), F.floor(F.col("event_id") / 2).alias("accession"), pos.alias("pos"), (1000 - pos - neg).alias("neu"), neg.alias("neg"), (pos - neg).alias("score"))
    return rows.join(F.broadcast(nation), F.pmod("user_id", F.lit(25)) == nation.n_nationkey).select("event_id", F.col("n_name").alias("symbol"), "trade_date", "kind", "accession", "pos", "neu", "neg", "score")


#: Dimensions of the vectors.
DIMS = 64


def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, as_of_date, v1..v64: vectors averaged per (company, filing)."""
    from skeinflow.operators.vectors import mean_pool

    vectors, nation = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "nation")
    rows = vectors.select("label", "vec_id", "embedding").join(F.broadcast(nation), F.col("label") == nation.n_nationkey)
    rows = rows.select(F.col("n_name").alias("symbol"), F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("vec_id") % 40 * 60).cast("int")).alias("as_of_date"), "embedding")
    return mean_pool(rows, ["symbol", "as_of_date"], "embedding", DIMS)


def projected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, as_of_date, filing_pc1..5: pooled vectors on five fixed axes, the i-th of which adds every fifth dimension
    from i on. They take the components' place where SQL has to follow."""
    whole = lambda j: F.round(F.col(f"v{j}") * 1e6).cast("long")
    axis = lambda i: sum((whole(j) for j in range(i + 5, DIMS + 1, 5)), whole(i)).cast("double") / F.lit(1e6)
    return pooled_vectors(spark, sf_dir).select("symbol", "as_of_date", *[axis(i).alias(f"filing_pc{i}") for i in range(1, 6)])


def filing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_key, symbol, as_of_date, vector: the pooled vectors of the filings."""
    from skeinflow.functions.keys import name_key

    return pooled_vectors(spark, sf_dir).select(name_key(F.col("symbol")).alias("company_key"), "symbol", "as_of_date", F.array(*[f"v{i}" for i in range(1, DIMS + 1)]).alias("vector"))


def embedding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_embedding_key (1000 on, by company and filing), company_key, symbol, as_of_date, filing_pc1..5: the principal
    components of the pooled vectors, fitted on all filings."""
    from skeinflow.ml.pca import components
    from skeinflow.operators.numbering import number_rows

    pooled = stage(filing_vectors(spark, sf_dir), "filings")  # a row for each company and filing day; each pass would pool all vectors anew
    if pooled.isEmpty():
        return spark.createDataFrame([], "fact_embedding_key long, company_key string, symbol string, as_of_date date, " + ", ".join(f"filing_pc{i} double" for i in range(1, 6)))
    found, _ = components(pooled, "vector")
    numbered = number_rows(found, "company_key", ["as_of_date"], "fact_embedding_key", 1000)
    return numbered.select("fact_embedding_key", "company_key", "symbol", "as_of_date", *[f"filing_pc{i}" for i in range(1, 6)])
