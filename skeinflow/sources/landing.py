"""Landing, incremental work and audit of ingested files."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.functions.keys import article_id, sanitised
from skeinflow.operators.upsert import upsert
from skeinflow.sources.versions import VersionedTable


def backfill_windows(spark: SparkSession, name: str, first: date, last: date, step: int) -> DataFrame:
    """name, window_no, window_start, window_end: inclusive windows of ``step`` days that cover first to last, both included."""
    starts = F.posexplode(F.sequence(F.lit(first), F.lit(last), F.expr(f"interval {step} days"))).alias("window_no", "window_start")
    end = F.least(F.date_add("window_start", step - 1), F.lit(last))
    return spark.range(1).select(F.lit(name).alias("name"), starts).select("name", F.col("window_no").cast("long").alias("window_no"), "window_start", end.alias("window_end"))


def new_rows(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among ``done``; null keys equal each other, so they aren't admitted again on every run."""
    right = done.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = None
    for k in keys:
        term = df[k].eqNullSafe(right[f"_{k}"])
        on = term if on is None else on & term
    return df.join(right, on, "left_anti")


def stratified(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """The ``n`` rows of each stratum that come first by the md5 of their key, with their place."""
    order = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string"))))
    return df.withColumn("place", order.cast("long")).filter(F.col("place") <= n)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text under a sanitised name; days as YYYY-MM-DD."""
    day = lambda c, t: F.date_format(c, "yyyy-MM-dd") if t == "date" else F.col(c).cast("string")
    return df.select(*[day(f"`{c}`", t).alias(sanitised(c)) if t == "date" else F.col(f"`{c}`").cast("string").alias(sanitised(c)) for c, t in df.dtypes])


def land_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def land_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def land_texts(df: DataFrame, path: str, name: str, body: str, mode: str = "overwrite") -> None:
    """One folder per ``name`` with the body as text, so the name is found again in the path."""
    df.select(F.col(name), F.col(body).alias("value")).write.mode(mode).partitionBy(name).text(path, lineSep="\u0000")


def replace_slice(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions of ``by`` that ``df`` holds and leaves the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, n_bytes, sha256 of every file below ``path``, hashed where the files lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_checksum(files: DataFrame) -> DataFrame:
    """One row: sha256 of a folder's manifest, "name:size" lines in order of the names."""
    line = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(":"), F.col("n_bytes").cast("string"), F.lit("\n"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("sha256"), F.count("*").alias("n_files"))


AUDIT = "source string, symbol string, window_key string, file_path string, row_count long, sha256 string, ingested_at timestamp"


def audit_row(spark: SparkSession, source: str, symbol: str | None, window_key: str, path: str, rows: int, sha256: str | None) -> DataFrame:
    """One audit row; a missing file has 64 zeros for its checksum."""
    row = spark.createDataFrame([(source, symbol, window_key, path, rows, sha256 or "0" * 64)], AUDIT.rsplit(",", 1)[0])
    return row.withColumn("ingested_at", F.current_timestamp())


def log_ingest(log: DataFrame, row: DataFrame) -> DataFrame:
    """The log after a row: one per (source, symbol, window), the latest."""
    return upsert(log, row, ["source", "symbol", "window_key"], ["ingested_at"])


def whole_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """symbol, filing_date, accession, body of text files; symbol and day are groups 1 and 2 of ``pattern`` in the path. Empty bodies go."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path"))
    return rows.select(F.regexp_extract("file", pattern, 1).alias("symbol"), F.expr(f"try_to_date(regexp_extract(file, r'{pattern}', 2))").alias("filing_date"), F.element_at(F.split("file", "/"), -1).alias("accession"), F.col("value").alias("body")).filter(F.length(F.trim("body")) > 0)


def read_json_documents(spark: SparkSession, path: str, schema: str, quarantine: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(good rows, rows of unreadable documents with their text in ``quarantine``) of multi-line JSON files."""
    rows = spark.read.schema(f"{schema}, {quarantine} string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", quarantine).json(path)
    bad = F.col(quarantine).isNotNull()
    return rows.filter(~bad).drop(quarantine), rows.filter(bad)


#: The fields of landed files, as text.
PRICES = "date string, open string, high string, low string, close string, adj_close string, volume string"
INCOME = "symbol string, date string, revenue string, grossProfit string, operatingIncome string, netIncome string, ebitda string"
BALANCE = "symbol string, date string, totalAssets string, totalLiabilities string, totalStockholdersEquity string, totalDebt string, cashAndCashEquivalents string"
CASH_FLOW = "symbol string, date string, freeCashFlow string, operatingCashFlow string"
NEWS = "symbol string, publishedDate string, title string, site string, url string, text string"
PRESS = "symbol string, publishedDate string, title string, text string"
#: Quarters of a statement that are kept; characters below which a filing's body counts as a summary only.
QUARTERS, SHORT_BODY = 24, 200


def read_prices(spark: SparkSession, path: str, pattern: str = r"([^/]+)\.[a-z]+$", kind: str = "parquet") -> DataFrame:
    """Landed daily bars as raw text rows (symbol, trade_date, open, high, low, close, adj_close, volume).

    Column names are sanitised, those of two levels to their first. The symbol is group 1 of ``pattern`` in the file's
    path where no column holds it. Missing prices of the day stay null, a missing adj_close or volume is blank, and a
    volume is whole.
    """
    rows = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path)
    names = {c: sanitised(c.strip("()").replace("'", "").split(",")[0].strip()) for c in rows.columns}
    file = F.col("_metadata.file_path")
    flat = rows.select(file.alias("_file"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    has = lambda c: F.col(c) if c in flat.columns else F.lit(None).cast("string")
    day = F.date_format("date", "yyyy-MM-dd") if dict(flat.dtypes)["date"].startswith(("date", "timestamp")) else F.col("date").cast("string")
    symbol = F.coalesce(has("symbol"), F.regexp_extract("_file", pattern, 1))
    blank = lambda c: F.coalesce(F.when(F.lower(has(c).cast("string")) != "nan", has(c).cast("string")), F.lit(""))
    volume = F.coalesce(F.expr("try_cast(try_cast(_volume AS double) AS bigint)").cast("string"), F.lit(""))
    out = flat.withColumn("_volume", blank("volume"))
    return out.select(symbol.alias("symbol"), day.alias("trade_date"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")], blank("adj_close").alias("adj_close"), volume.alias("volume"))


def read_statements(spark: SparkSession, path: str, schema: str, quarters: int = QUARTERS) -> tuple[DataFrame, DataFrame]:
    """(rows under sanitised names, the latest ``quarters`` of each symbol; unreadable documents) of landed statements."""
    good, bad = read_json_documents(spark, path, schema)
    rows = good.select(*[F.col(c).alias(sanitised(c)) for c in good.columns]).filter("symbol IS NOT NULL AND date IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return rows.withColumn("_place", place).filter(F.col("_place") <= quarters).drop("_place"), bad


def read_articles(spark: SparkSession, path: str, schema: str = NEWS) -> tuple[DataFrame, DataFrame]:
    """(article_id, symbol, published_at, title, site, url, body; unreadable documents) of landed news (NEWS) or press (PRESS)."""
    good, bad = read_json_documents(spark, path, schema)
    has = lambda c: F.col(c) if c in good.columns else F.lit(None).cast("string").alias(c)
    what = [F.col("url")] if "url" in good.columns else [F.col("title"), F.col("text")]
    return good.select(article_id(F.col("symbol"), F.col("publishedDate"), *what).alias("article_id"), "symbol", F.col("publishedDate").alias("published_at"), "title", has("site"), has("url"), F.col("text").alias("body")), bad


def whole_bodies(df: DataFrame, *bodies: str, least: int = SHORT_BODY) -> DataFrame:
    """``df`` with a column body: the first of ``bodies`` with ``least`` characters, else the last that isn't empty, else blank."""
    long = [F.when(F.length(b) >= least, F.col(b)) for b in bodies]
    some = [F.when(F.length(b) > 0, F.col(b)) for b in reversed(bodies)]
    return df.withColumn("body", F.coalesce(*long, *some, F.lit("")))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; blank and unreadable lines go."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def ensure_databases(spark: SparkSession, *names: str) -> None:
    """Makes the layers' databases where they are absent."""
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


#: The columns of a table of scored articles.
SCORED = "{key} string, symbol string, company_key string, published_at string, trade_date date, pos_prob decimal(8,5), neu_prob decimal(8,5), neg_prob decimal(8,5), finbert_score decimal(8,5)"


def ensure_table(spark: SparkSession, name: str, schema: str) -> None:
    """Makes an empty Parquet table where it is absent."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def save_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
    """Replaces a table of the catalog by ``df``."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def land_and_log(df: DataFrame, path: str, log: DataFrame | None, source: str, symbol: str | None, window_key: str, land=land_parquet) -> DataFrame:
    """Lands ``df`` and returns the log with the landing's audit row: its rows, and the checksum of the folder's manifest.

    The landed files are counted and hashed, so the row says what is there.
    """
    spark = df.sparkSession
    land(df, path)
    found = manifest_checksum(checksums(spark, path).filter(~F.element_at(F.split("file", "/"), -1).startswith("_"))).first()
    n = df.count() if land is not land_parquet else spark.read.schema(df.schema).parquet(path).count()
    row = audit_row(spark, source, symbol, window_key, path, n, found.sha256)
    return log_ingest(log, row) if log is not None else row


class IngestLog:
    """The audit log as a committed table: one row per (source, symbol, window), the latest landing's.

    A landing is logged after its files are there; a writer that dies in between leaves the log as it was, and of two
    that log at the same time the second goes on from the first one's version.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path, AUDIT)

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def add(self, row: DataFrame) -> None:
        self.table.update(lambda log: log_ingest(log, row))

    def land(self, df: DataFrame, path: str, source: str, symbol: str | None, window_key: str, land=land_parquet) -> None:
        self.add(land_and_log(df, path, None, source, symbol, window_key, land))


def recent(df: DataFrame, day: str, today: date, months: int) -> DataFrame:
    return df.filter(F.col(day) >= F.lit(today - timedelta(30 * months)))
