"""Bucketed, versioned and checked landing tables."""

import pytest
from pyspark.sql import functions as F

from grainloom.sources import tables


def test_appends_read_only_the_buckets_they_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.col("id").alias("seq"))
    assert len(tables.append_bucketed(df, path, ["k"], "seq", buckets=20)) == 20
    few = spark.createDataFrame([(3, "new", 1), (1000, "b", 2), (1000, "a", 1), (None, "x", 1)], "k long, v string, seq long")
    rows = few.withColumn(tables.BUCKET, tables.bucket_of(["k"], 20))
    numbers = sorted({r[tables.BUCKET] for r in rows.collect()})
    read = tables.touched(spark, path, rows.drop("seq"), numbers)
    assert 0 < read.count() < 400 * 4 / 20 and "PartitionFilters: [isnotnull(_bucket" in (plan := read._jdf.queryExecution().toString()) or "PartitionFilters: [_bucket" in plan
    assert tables.append_bucketed(few, path, ["k"], "seq", buckets=20) == numbers
    assert tables.append_bucketed(few, path, ["k"], "seq", buckets=20) == numbers  # once more changes nothing
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == spark.read.parquet(path).count() == 402 and (got[3], got[1000], got[None]) == ("old", "a", "x")


def test_a_reload_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).select(F.col("id").alias("k"))
    tables.reload_version(df, path)
    tables.reload_version(df.where("k < 4"), path)
    broken = df.repartition(4).select(F.when(F.col("k") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("k")).alias("k"))
    with pytest.raises(Exception, match="broken"):
        tables.reload_version(broken, path)
    assert tables.current(spark, path).count() == 4 and tables.current(spark, path, 0).count() == 10 and len(tables.versions(spark, path)) == 2
    tables.reload_version(df.where("k < 2"), path)
    tables.drop_versions(spark, path, keep=1)
    assert tables.current(spark, path).count() == 2 and len(tables.versions(spark, path)) == 1


def test_rules_are_counted_in_the_scan_that_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0), (3, None), (-4, -1.0)], "k int, v double")
    found = tables.write_checked(df, str(tmp_path / "t"), {"key": F.col("k") < 0, "value": F.col("v") <= 0})
    assert found == {"rows": 4, "key": 1, "value": 2}
    out = tables.checked_rows(spark, str(tmp_path / "t"))
    assert {r["k"]: r["good"] for r in out.collect()} == {1: True, 2: False, 3: True, -4: False}
