import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainloom.operators import align, profile, rolling
from grainloom.plans import features

D0 = dt.date(2020, 1, 1)


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, D0 + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], "series string, date date, v double")


def col(df, c):
    return [r[0] for r in df.orderBy("date").select(c).collect()]


def test_windows_equal_pandas(spark):
    rng = np.random.default_rng(1)
    v = [None if x < 0.1 else float(round(y, 2)) for x, y in zip(rng.random(320), rng.normal(50, 9, 320))]
    df, p = series(spark, v), pd.Series(v, dtype=float)
    w, c = rolling.ordered("series"), F.col("v")
    for got, want in [
        (rolling.moving_avg(c, 7, w), p.rolling(7, min_periods=1).mean()),
        (rolling.moving_std(c, 14, w, 5), p.rolling(14, min_periods=5).std()),
        (rolling.trailing_avg(c, 5, w), p.shift(1).rolling(5).mean()),
        (rolling.percentile_rank(c, 252, w), p.rolling(252, min_periods=30).apply(lambda x: x.rank().iloc[-1] / len(x), raw=False)),
        (rolling.forward_fill(c, w), p.ffill()),
    ]:
        assert np.allclose(np.array(col(df, got.alias("y")), dtype=float), want.to_numpy(), equal_nan=True)


def test_zero_and_gaps(spark):
    df, w = series(spark, [0, 2, None, 4]), rolling.ordered("series")
    assert col(df, rolling.pct_change(F.col("v"), 1, w).alias("y")) == [None, None, None, None]
    assert col(df, rolling.above_long_average(F.col("v"), 3, w).alias("y")) == [0, 0, 0, 0]


def test_alignments(spark):
    backbone = series(spark, range(6)).select("series", "date")
    release = spark.createDataFrame([("a", D0 - dt.timedelta(2), 1.0), ("a", D0 + dt.timedelta(2), 2.0)], "series string, date date, x double")
    assert col(align.align_exact_ffill(release, backbone, ["series"]), "x") == [None, None, 2.0, 2.0, 2.0, 2.0]
    assert col(align.align_asof(release, backbone, ["series"]), "x") == [1.0, 1.0, 2.0, 2.0, 2.0, 2.0]


def test_lookup_must_be_unique(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        align.lookup(spark.createDataFrame([(1,)], "k int"), t, ["k"])


def test_no_look_ahead(spark):
    rng = np.random.default_rng(2)
    v = [float(x) for x in rng.normal(100, 5, 120)]
    a = series(spark, v).withColumnRenamed("v", "price_close")
    b = series(spark, v[:80] + [x * 3 for x in v[80:]]).withColumnRenamed("v", "price_close")
    cut = D0 + dt.timedelta(79)
    tables = [features.build_master(x).where(F.col("date") <= F.lit(cut)) for x in (a, b)]
    cols = [c for c in tables[0].columns if not c.startswith("target_")]
    x, y = (t.select(*cols).orderBy("date").collect() for t in tables)
    assert x == y


def test_as_of_cut_hides_the_future(spark):
    px = series(spark, range(10, 70)).withColumnRenamed("v", "price_close")
    cut = D0 + dt.timedelta(40)
    late = features.build_master(px, as_of=cut).orderBy(F.desc("date")).first()
    assert late["date"] == cut and late["target_price_t7"] is None
    assert features.build_master(px, as_of=cut, labels_before_cut=True).orderBy(F.desc("date")).first()["target_price_t7"] is not None


def test_select_features_warns(spark):
    with pytest.warns(UserWarning):
        out = features.select_features(features.label_block(series(spark, range(50)).withColumnRenamed("v", "price_close")), ["price_close", "absent"], "target_updown_t7")
    assert out.columns == ["series", "date", "price_close", "target_updown_t7"]


def test_stock_to_use(spark, rows):
    df = spark.createDataFrame([(1, 10.0, 5.0), (2, None, 5.0), (3, 10.0, 0.0), (4, 1.0, None)], "k int, ending double, domestic double")
    assert [r[-1] for r in rows(profile.stock_to_use(df, ["k"]))] == [2.0, 0.0, None, None]


def test_quality_rules(spark):
    df = spark.createDataFrame([(D0, 1.0, 2.0, 1.0, 1.5), (D0, 1.0, 1.0, 2.0, 1.5), (D0, 0.0, 2.0, 1.0, 1.0)], "date date, open double, high double, low double, close double")
    good, bad = profile.quarantine(df)
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(ValueError):
        profile.quarantine(df, "fail")
    with pytest.raises(ValueError):
        profile.validate_ohlcv(df)
    with pytest.raises(ValueError):
        profile.validate_ohlcv(df.drop("low"))


def test_unit_root_separates(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 1, 300)
    df = series(spark, noise, "stationary").union(series(spark, np.cumsum(noise), "walk")).union(series(spark, range(5), "short"))
    got = {r["series"]: r["stationary"] for r in profile.unit_root(df, "v", "series").collect()}
    assert got == {"stationary": True, "walk": False, "short": None}
