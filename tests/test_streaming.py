"""Streams equal the batch, twice over."""

from pyspark.sql import functions as F

from skeinflow.streaming.ingest import drain, drain_watched, file_stream, full_refresh, incremental, json_documents, text_documents

SCHEMA = "k long, seq long, v string"


def test_new_files_only(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([(1, 1, "a")], SCHEMA).write.parquet(src)
    stream = lambda: file_stream(spark, src, SCHEMA).drop("ingest_ts")
    drain(stream(), out, mark)
    drain(stream(), out, mark)
    assert [(r.k, r.v) for r in spark.read.parquet(out).collect()] == [("1", "a")]
    spark.createDataFrame([(2, 1, "b")], SCHEMA).write.mode("append").parquet(src)
    drain(stream(), out, mark)
    assert spark.read.parquet(out).filter(F.col("source_path").contains("src")).count() == 2
    full_refresh(spark, out, mark)
    drain(stream(), out, mark)
    assert spark.read.parquet(out).count() == 2


def test_incremental_work(spark, tmp_path):
    done = str(tmp_path / "done")
    work = lambda df: df.withColumn("score", F.length("v"))
    assert incremental(spark, spark.createDataFrame([(1, 1, "a")], SCHEMA), done, ["k"], work).count() == 1
    got = incremental(spark, spark.createDataFrame([(1, 1, "zz"), (2, 1, "bb")], SCHEMA), done, ["k"], work)
    assert sorted((r.k, r.score) for r in got.collect()) == [(1, 1), (2, 2)]


def test_json_documents(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    (tmp_path / "src" / "AB").mkdir(parents=True)
    (tmp_path / "src" / "AB" / "1.json").write_text('[{"symbol": "AB",\n "netIncome": 3}, {"symbol": null, "netIncome": 4}]')
    stream = lambda: json_documents(spark, src, "symbol string, netIncome long")
    drain(stream(), out, mark)
    (tmp_path / "src" / "2.json").write_text('{"symbol": "C"}')
    drain(stream(), out, mark)
    got = spark.read.parquet(out).collect()
    assert sorted((str(r.symbol), str(r.netIncome)) for r in got) == [("AB", "3"), ("C", "None"), ("None", "4")]
    assert all(r.source_path.endswith(".json") and r.ingest_ts for r in got)


def test_text_documents(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    (tmp_path / "src" / "AB").mkdir(parents=True)
    (tmp_path / "src" / "AB" / "2024-02-30.txt").write_text("no day")
    (tmp_path / "src" / "AB" / "2024-02-28.txt").write_text("two\nlines")
    drain(text_documents(spark, src, r"([A-Z]+)/(\d{4}-\d{2}-\d{2})"), out, mark)
    assert sorted((r.symbol, str(r.filing_date), r.body) for r in spark.read.parquet(out).collect()) == [("AB", "2024-02-28", "two\nlines"), ("AB", "None", "no day")]


def test_violations_of_a_stream_are_counted(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([(1, 1, "a"), (None, 2, "b"), (3, -1, None)], SCHEMA).write.parquet(src)
    rules = {"key": F.col("k").isNotNull(), "positive": F.col("seq") > 0, "named": F.col("v") != ""}
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    assert drain_watched(stream(), rules, out, mark) == {"n_rows": 3, "key": 1, "positive": 1, "named": 1}
    assert [r.k for r in spark.read.parquet(out).collect()] == [1]
    assert drain_watched(stream(), rules, out, mark)["n_rows"] == 0
