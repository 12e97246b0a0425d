import datetime as dt

from pyspark.sql import functions as F

from grainloom.operators import align
from grainloom.plans import features


def test_releases_meet_the_backbone_in_one_shuffle_and_keep_their_values(spark, rows):
    base = spark.createDataFrame([("a", dt.date(2001, 1, d), float(d)) for d in (2, 4, 6)] + [("b", dt.date(2001, 1, 3), 1.0)], "series string, date date, c double")
    one = spark.createDataFrame([("a", dt.date(2001, 1, 1), 1), ("a", dt.date(2001, 1, 4), None), ("a", dt.date(2001, 1, 5), 5)], "series string, date date, x int")
    two = spark.createDataFrame([("b", dt.date(2001, 1, 3), 7.0, "u"), ("a", dt.date(2001, 1, 4), 8.0, None)], "series string, date date, y double, z string")
    got = align.align_asof_all([one, two], base, ["series"])
    assert got.columns == ["series", "date", "c", "x", "y", "z"]
    assert rows(got) == rows(align.align_asof(two, align.align_asof(one, base, ["series"]), ["series"]))
    assert rows(got.select("c", "x", "y", "z")) == rows(spark.createDataFrame([(2.0, 1, None, None), (4.0, 1, 8.0, None), (6.0, 5, 8.0, None), (1.0, None, 7.0, "u")], got.select("c", "x", "y", "z").schema))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_sets_are_counted_in_one_pass(spark, rows):
    df = spark.createDataFrame([("a", dt.date(2001, 1, 1), 1.0, 2, 1), ("a", dt.date(2001, 1, 2), float("nan"), 2, 1), ("a", dt.date(2001, 1, 3), 1.0, None, 0), ("a", dt.date(2001, 1, 4), 1.0, 2, None), ("b", dt.date(2001, 1, 4), None, 2, 0)], "series string, date date, x double, n int, y int")
    sets = {"both": ["x", "n"], "first": ["x"], "second": ["n"]}
    got = features.count_sets(features.complete_sets(df, sets, "y"), sets, "y")
    one = [(v, len(c), *df.select(*c, "y").dropna().agg(F.count(F.lit(1)), F.sum("y")).first()) for v, c in sets.items()]
    assert rows(got) == sorted(one, key=repr) == [("both", 2, 1, 1), ("first", 1, 2, 1), ("second", 1, 3, 2)]
    assert rows(features.count_sets(features.complete_sets(df.limit(0), sets, "y"), sets, "y")) == [("both", 2, 0, None), ("first", 1, 0, None), ("second", 1, 0, None)]
    assert features.count_sets(features.complete_sets(df, sets, "y"), sets, "y")._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
