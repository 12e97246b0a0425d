import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from grainloom.sources import readers, writers
from grainloom.streaming.landing import land_news, land_stream


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_vendor_prices(spark, tmp_path, rows):
    p = put(tmp_path / "a.csv", 'Date,Price,Open,High,Low,Vol.,Change\n01/02/2020,"1,234.50",1,2,0.5,1.5K,x\n25/12/2020,-,1,2,0.5,2M,x\nbad,1,1,1,1,1,x\n')
    got = rows(readers.read_vendor_ohlcv(spark, p, "palm").select("date", "close", "volume"))
    assert got == [(dt.date(2020, 1, 2), 1234.5, 1500.0), (dt.date(2020, 12, 25), None, 2e6)]


def test_cot(spark, tmp_path, rows):
    p = put(tmp_path / "c.txt", '"SOYBEAN OIL - CBT",x,2020-01-07,a,b,c,d,e,100, 40\n"SOYBEAN OIL - CBT",x,2020-01-14,a,b,c,d,e,.,40\n"WHEAT",x,2020-01-07,a,b,c,d,e,1,2\nSOYBEAN OIL,short\n')
    assert rows(readers.read_cot_text(spark, p, "soybean oil")) == [(dt.date(2020, 1, 7), dt.date(2020, 1, 10), 100.0, 40.0, 60.0)]


def test_supply(spark, tmp_path, rows):
    head = "Commodity_Description,Country_Name,Market_Year,Calendar_Year,Month,Attribute_Description,Value\n"
    p = put(tmp_path / "s.csv", head + 'Oil,Brazil,2020,2020,01,Production,"1,000"\nOil,Brazil,2009,2009,01,Production,1\nOther,Brazil,2020,2020,01,Production,1\n')
    assert [r["value"] for r in readers.read_supply_bulk(spark, p, ["Oil"]).collect()] == [1000.0]
    with pytest.raises(ValueError):
        readers.read_supply_bulk(spark, put(tmp_path / "t.csv", "a,b\n1,2\n"), ["Oil"])
    flat = put(tmp_path / "f.csv", "release_date,stu\n2020-01-10,0.5\nbad,1\n")
    assert rows(readers.read_supply_flat(spark, flat, {"stock": ("stu",), "world": ("w",)})) == [(dt.date(2020, 1, 10), None, 0.5, None, 1)]


def test_other_files(spark, tmp_path, rows):
    two = put(tmp_path / "fred.csv", "DATE,VALUE\n2020-01-01,1.5\n2020-01-02,.\n2020-01-01,2.5\n")
    assert rows(readers.read_two_column_csv(spark, two, "v")) == [(dt.date(2020, 1, 1), 2.5)]
    sheet = put(tmp_path / "m.csv", "x,Palm oil,Soybean oil\n,$/mt,$/mt\n1960M01,1,2\n1960M02,3,\n")
    assert rows(readers.read_month_sheet(spark, sheet, "palm oil", "v")) == [(dt.date(1960, 1, 1), 1.0), (dt.date(1960, 2, 1), 3.0)]
    ids = put(tmp_path / "i.csv", "Sourcekey,ABC,DEF\nDate,first,second\n2020-01-15,\"1,000\",2\n")
    assert rows(readers.read_series_by_id(spark, ids, "ABC", "v")) == [(dt.date(2020, 1, 1), 1000.0)]
    art = put(tmp_path / "n.json", json.dumps({"articles": [{"language": "English", "title": " A ", "url": "u", "domain": "", "sourcecountry": "US", "seendate": "20200102T000000Z"}, {"language": "French", "title": "B", "url": "v"}, {"language": "English", "title": "", "url": "w"}]}))
    assert rows(readers.read_articles_json(spark, art)) == [(dt.date(2020, 1, 2), "A", "u", "US")]
    for i, doc in enumerate([[{"a": 1}], {"Data": [{"a": 1}]}, {"results": [{"a": 1}]}]):
        assert rows(readers.read_supply_json(spark, put(tmp_path / f"j{i}.json", json.dumps(doc)), "a: int")) == [(1,)]
    exp = put(tmp_path / "e.csv", "날짜,재고\n2020-01-01,5\n")
    assert rows(readers.read_internal_export(spark, exp, {"date": ("날짜",), "inventory_ton": ("재고",)}, ["date"])) == [("2020-01-01", "5")]
    with pytest.raises(ValueError):
        readers.read_internal_export(spark, exp, {"date": ("일자",)}, ["date"])


def test_series_fallback(spark, rows):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "a", 1.0), (dt.date(2020, 1, 2), "b", 2.0)], "date date, commodity string, v double")
    assert len(rows(readers.read_series(df, "v", "a", fallback=True))) == 1
    assert len(rows(readers.read_series(df, "v", "z", fallback=True))) == 2
    assert len(rows(readers.read_series(df, "v", "z"))) == 0


def test_first_writer_wins(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (None, "n", 2)], "k int, v string, seq int")
    b = spark.createDataFrame([(1, "z", 0), (2, "w", 1), (None, "m", 2)], "k int, v string, seq int")
    for df in (a, b, b):
        writers.append_first_wins(df, path, ["k"], "seq")
    assert rows(spark.read.parquet(path)) == [(1, "x"), (2, "w"), (None, "n")]
    with pytest.raises(ValueError):
        writers.append_new_only(a, path, ["k"])


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.log_decisions(spark.createDataFrame([("Buy",), ("Wait",)], "recommended_action string"), path)
    log = spark.read.parquet(path)
    first = log.where("recommended_action = 'Buy'").select("id", F.lit("Split").alias("actual_action"), F.lit(5.0).alias("quantity_actual_ton"), F.lit(None).cast("string").alias("reason_override"))
    done = {r["recommended_action"]: r["actual_action"] for r in writers.with_actuals(log, first).collect()}
    assert done == {"Buy": "Split", "Wait": None}


def test_streams(spark, tmp_path, rows):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, "z", 2)], "k int, v string, seq int").coalesce(1).write.parquet(src)
    for _ in range(2):
        land_stream(spark.readStream.schema("k int, v string, seq int").parquet(src), out, ["k"], str(tmp_path / "ck"), "seq").awaitTermination()
    assert rows(spark.read.parquet(out)) == [(1, "x"), (2, "z")]
    news = str(tmp_path / "news")
    spark.createDataFrame([("Drought", "u", "reuters", dt.datetime(2020, 1, 1)), ("Drought again", "u", "reuters", dt.datetime(2020, 1, 2))], "title string, url string, source string, seen_at timestamp").coalesce(1).write.parquet(news)
    land_news(spark.readStream.schema("title string, url string, source string, seen_at timestamp").parquet(news), str(tmp_path / "scored"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "scored")).count() == 1


def test_queries_have_the_oracles_columns(spark):
    from grainloom import queries

    assert len(queries.oracle_sql()) >= 60 and set(queries.oracle_sql()) <= set(queries.queries())
