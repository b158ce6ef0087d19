"""Landed files, their forms as raw text, tables of the catalog and the audit log."""

from datetime import date

from pyspark.sql import functions as F

from skeinflow.sources import landing


def test_prices(spark, tmp_path):
    rows = [(date(2024, 1, 2), 1.5, 2.0, 1.0, 1.75, 1.7, 1200.0), (date(2024, 1, 3), 1.5, None, 1.0, float("nan"), None, None), (date(2024, 1, 4), 1.0, 1.0, 1.0, 1.0, float("nan"), float("nan"))]
    spark.createDataFrame(rows, "Date date, Open double, High double, Low double, Close double, `Adj Close` double, Volume double").coalesce(1).write.parquet(str(tmp_path / "AB.parquet"))
    got = sorted(tuple(r) for r in landing.read_prices(spark, str(tmp_path / "AB.parquet"), r"([A-Z]+)\.parquet").collect())
    assert [(r[0], r[1], r[5], r[6], r[7]) for r in got] == [("AB", "2024-01-02", "1.75", "1.7", "1200"), ("AB", "2024-01-03", "NaN", "", ""), ("AB", "2024-01-04", "1.0", "", "")]
    (tmp_path / "C.csv").write_text("Date,Open,High,Low,Close,Volume,Symbol\\n2024-01-02,1,2,1,2,7,X\\n".replace("\\n", chr(10)))
    r = landing.read_prices(spark, str(tmp_path / "C.csv"), kind="csv").first()
    assert (r.symbol, r.trade_date, r.close, r.adj_close, r.volume) == ("X", "2024-01-02", "2", "", "7")


def test_two_level_names(spark, tmp_path):
    spark.createDataFrame([("2024-01-02", 1.0, 2.0, 3.0, 4.0, 5)], "`('Date', '')` string, `('Open', 'AB')` double, `('High', 'AB')` double, `('Low', 'AB')` double, `('Close', 'AB')` double, `('Volume', 'AB')` int").write.parquet(str(tmp_path / "AB.parquet"))
    r = landing.read_prices(spark, str(tmp_path / "AB.parquet"), r"([A-Z]+)\.parquet").first()
    assert (r.symbol, r.trade_date, r.open, r.close, r.volume) == ("AB", "2024-01-02", "1.0", "4.0", "5")


def test_statements_and_articles(spark, tmp_path):
    docs = [f'{{"symbol": "A", "date": "20{20 + i // 4}-0{i % 4 * 3 + 1 if i % 4 < 3 else 9}-01", "netIncome": "{i}"}}' for i in range(30)]
    (tmp_path / "s.json").write_text("[" + ",".join(docs) + ', {"date": "2020-01-01"}]')
    (tmp_path / "bad.json").write_text("[{")
    good, bad = landing.read_statements(spark, str(tmp_path / "*.json"), landing.INCOME)
    assert good.count() == 24 and "netincome" in good.columns and good.agg(F.min("date")).first()[0] > "2021" and len(bad.collect()) == 1
    news = tmp_path / "news"
    news.mkdir()
    (news / "n.json").write_text('[{"symbol": "A", "publishedDate": "2024-01-01", "title": "t", "url": "u", "text": "b"}]')
    r = landing.read_articles(spark, str(news))[0].first()
    assert r.article_id.startswith("A::2024-01-01::") and (r.body, r.url, r.site) == ("b", "u", None)
    r = landing.read_articles(spark, str(news), landing.PRESS)[0].first()
    assert (r.url, r.site, r.body) == (None, None, "b")


def test_bodies_and_recent(spark):
    rows = [(1, "x" * 200, "y" * 300, "z"), (2, "short", "y" * 300, "z"), (3, "short", "mid", ""), (4, None, None, None)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    assert [r.body[:3] for r in landing.whole_bodies(df, "a", "b", "c").orderBy("i").collect()] == ["xxx", "yyy", "mid", ""]
    days = spark.createDataFrame([(date(2024, 1, 1),), (date(2023, 1, 6),), (date(2023, 1, 5),)], "d date")
    assert landing.recent(days, "d", date(2024, 1, 1), 12).count() == 2


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\\n\\n{"a": \\n{"a": 2, "b": 3}\\n'.replace("\\n", chr(10)))
    assert sorted(r.a for r in landing.read_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    landing.land_json(df, str(tmp_path / "j"))
    assert spark.read.schema("name string, n int").json(str(tmp_path / "j")).count() == 2
    landing.land_texts(df.selectExpr("name", "concat('line', char(10), n) AS body"), str(tmp_path / "t"), "name", "body")
    got = spark.read.text(str(tmp_path / "t"), wholetext=True, recursiveFileLookup=True).collect()
    assert sorted(r.value.strip(chr(0)) for r in got) == ["line\\n1".replace("\\n", chr(10)), "line\\n2".replace("\\n", chr(10))]
    landing.land_parquet(df, str(tmp_path / "p"), ["name"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("name = 'a'").first().n == 1


def test_landing_is_logged(spark, tmp_path):
    df = spark.range(5)
    log = landing.land_and_log(df, str(tmp_path / "a"), None, "s", "A", "w1")
    again = landing.land_and_log(df.limit(3), str(tmp_path / "a"), log, "s", "A", "w1")
    more = landing.land_and_log(df, str(tmp_path / "b"), again, "s", "A", "w2", land=landing.land_json)
    assert sorted((r.window_key, r.row_count) for r in more.collect()) == [("w1", 3), ("w2", 5)] and all(len(r.sha256) == 64 for r in more.collect())


def test_catalog_tables(spark):
    landing.ensure_databases(spark, "skein_gold", "skein_gold")
    try:
        landing.ensure_table(spark, "skein_gold.scored", landing.SCORED.format(key="article_id"))
        landing.ensure_table(spark, "skein_gold.scored", landing.SCORED.format(key="article_id"))
        assert spark.table("skein_gold.scored").columns[0] == "article_id"
        for n in (2, 3):
            landing.save_table(spark.range(n), "skein_gold.t")
        assert spark.table("skein_gold.t").count() == 3
    finally:
        spark.sql("DROP DATABASE IF EXISTS skein_gold CASCADE")
