"""Dimensions of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.keys import date_key, name_key
from skeinflow.plans import fixtures
from skeinflow.session import table

#: The filing types and their labels.
FILING_TYPES = [("10K", "10-K Annual Report"), ("8K", "8-K Material Event"), ("NEWS", "News Article"), ("PRESS", "Press Release")]
#: The table that stands for each filing type's rows.
FILING_TABLES = {"10K": "documents", "8K": "events", "NEWS": "pages", "PRESS": "conversations"}


def _calendar(days: DataFrame, trading) -> DataFrame:
    d = F.col("full_date")
    part = lambda c: c.cast("long")
    return days.select(
        date_key(d).alias("date_key"), "full_date", part(F.year(d)).alias("year"), part(F.month(d)).alias("month"), part(F.dayofmonth(d)).alias("day"),
        part(F.weekofyear(d)).alias("week"), part(F.dayofweek(d) - 1).alias("day_of_week"), trading.alias("is_trading_day"),
    )


def dim_date(spark: SparkSession, first: str = fixtures.FIRST_DAY, last: str = fixtures.LAST_DAY) -> DataFrame:
    """Every day of the range; Sunday is 0, Monday to Friday are trading days."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("full_date"))
    return _calendar(days, F.dayofweek("full_date").between(2, 6))


def dim_date_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days on which something traded; all are trading days."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("full_date")).filter("full_date IS NOT NULL").distinct()
    return _calendar(days, F.lit(True))


def dim_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(name_key(F.col("r_name")).alias("sector_key"), F.col("r_name").alias("sector_name")).distinct()


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector_name; 'Unknown' for a company without a sector."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
    return joined.select(F.col("n_name").alias("symbol"), F.coalesce("r_name", F.lit("Unknown")).alias("sector_name"))


def dim_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of the universe that have traded."""
    traded = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_nationkey").distinct()
    names = table(spark, sf_dir, "nation").join(traded, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("n_name").alias("traded"))
    known = universe(spark, sf_dir).join(F.broadcast(names), F.col("symbol") == F.col("traded"), "left_semi")
    return known.select(name_key(F.col("symbol")).alias("company_key"), "symbol", name_key(F.col("sector_name")).alias("sector_key"), "sector_name")


def dim_filing_type(spark: SparkSession) -> DataFrame:
    types = spark.createDataFrame(FILING_TYPES, "code string, label string")
    return types.select(name_key(F.col("code")).alias("filing_type_key"), "code", "label")


def dim_filing_type_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing types that have rows, with their number."""
    counts = None
    for code, name in FILING_TABLES.items():
        part = table(spark, sf_dir, name).agg(F.count("*").alias("row_count")).select(F.lit(code).alias("code"), "row_count")
        counts = part if counts is None else counts.unionByName(part)
    return dim_filing_type(spark).join(counts.filter("row_count > 0"), "code").select("filing_type_key", "code", "label", "row_count")
