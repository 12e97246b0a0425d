"""Folds fitted together against a fit a fold; a stream with late rows against its rule."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from grainloom.plans import bands, folds, learn
from grainloom.streaming import landing


def table(spark, n=330):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (n, 3)) * [1, 100, 0.01] + [0, 50, 3]
    y = (x[:, 0] + (x[:, 1] - 50) / 80 + rng.normal(0, 1, n) > 0).astype(int)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i), *map(float, v), 7.0, int(t)) for i, (v, t) in enumerate(zip(x, y))]
    rows.append((dt.date(2019, 1, 1), None, 1.0, 1.0, 7.0, 1))
    return spark.createDataFrame(rows, "date date, a double, b double, c double, same double, up int").repartition(4)


def test_folds_together_equal_a_fit_a_fold(spark):
    df, names = table(spark), ["a", "b", "c", "same"]
    got = folds.walk_forward_logistic(df, names, "up", first=150, step=60)
    assert {(r["fold"], r["count"]) for r in got.groupBy("fold").count().collect()} == {(0, 60), (1, 60), (2, 60)}
    rows = learn.numbered(df.dropna())
    stages = [VectorAssembler(inputCols=["a", "b", "c"], outputCol="v"), StandardScaler(inputCol="v", outputCol="s", withMean=True), LogisticRegression(labelCol="up", featuresCol="s", regParam=folds.RIDGE, tol=1e-12, maxIter=300, standardization=False)]
    for f in (0, 2):
        model = Pipeline(stages=stages).fit(rows.where(F.col("row_no") < 150 + 60 * f))
        want = model.transform(rows.where(F.col("row_no").between(150 + 60 * f, 209 + 60 * f))).select("row_no", vector_to_array("probability")[1].alias("p"))
        for r in got.where(F.col("fold") == f).join(want, "row_no").collect():
            assert r["probability_up"] == pytest.approx(r["p"], abs=1e-5)


def test_folds_of_short_tables(spark):
    df = table(spark, 40)
    out = folds.walk_forward_logistic(df, ["a"], "up", first=150, step=60)
    assert out.count() == 0 and {"fold", "probability_up"} <= set(out.columns)
    assert folds.walk_forward_logistic(df.limit(0), ["a"], "up").count() == 0


def test_late_rows_of_a_stream(spark, tmp_path):
    hour = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(hour(1), "a", 1.0), (hour(6), "a", 1.0)], [(hour(1, 30), "a", 9.0), (hour(5), "a", 2.0), (hour(9), "b", 1.0)], [(hour(5, 59), "a", 9.0), (hour(20), "a", 0.0)]]
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp, k string, v double").write.mode("append").parquet(str(tmp_path / "in"))
        stream = landing.file_stream(spark, str(tmp_path / "in"), "ts timestamp, k string, v double")
        landing.windowed_counts_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), "ts", "k", "v").awaitTermination()
    got = sorted((r["start"].hour, r["k"], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # the watermark stood at 4 before the second batch, which drops 1:30, and at 7 before the third, which drops 5:59
    assert got == [(1, "a", 1, 1.0), (5, "a", 1, 2.0), (6, "a", 1, 1.0), (9, "b", 1, 1.0)]


def test_bands_are_recentred(spark):
    rng = np.random.default_rng(4)
    actual = 100 + np.cumsum(rng.normal(0, 1, 300))
    p50 = actual - 5 + rng.normal(0, 1, 300)
    df = spark.createDataFrame([("a", i, float(p - 1), float(p), float(p + 1), float(x)) for i, (p, x) in enumerate(zip(p50, actual))], "series string, time_idx long, p10 double, p50 double, p90 double, actual double")
    cal, test = F.col("time_idx") < 150, F.col("time_idx") >= 150
    got = {r["band"]: r for r in bands.compare_bands(df, cal, test, ["series"]).collect()}
    moved = p50 + (actual - p50)[:150].mean()
    q = np.quantile(np.abs(actual - p50)[:150], 0.85)
    e = np.abs(actual - moved)[150:]
    assert got["raw"]["mae"] == pytest.approx(np.abs(actual - p50)[150:].mean()) and got["fixed"]["mae"] == pytest.approx(e.mean())
    assert got["fixed"]["half_width"] == pytest.approx(q) and got["fixed"]["coverage"] == pytest.approx((e < q).mean() * 100)
    assert got["scaled"]["half_width"] == pytest.approx(q * actual[150:].std(ddof=1) / actual[:150].std(ddof=1))
    rolling = [np.quantile(np.abs(actual - moved)[i - 60 : i], 0.85) for i in range(150, 300)]
    assert got["rolling"]["half_width"] == pytest.approx(np.mean(rolling))
    need = bands.least_alpha(df, cal, test, ["series"]).first()
    assert need["need"] == pytest.approx(np.sort(e)[int(np.ceil(len(e) * 0.8)) - 1])
    rank = bands.half_width_rank(df, cal, test, ["series"]).first()
    assert rank["rank_pct"] == pytest.approx((np.abs(actual - p50)[150:] <= q).mean() * 100)
