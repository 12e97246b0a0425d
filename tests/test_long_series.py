"""Sliding order statistics, series in ranges and quantiles of large groups against pandas and plain windows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from grainloom.operators import align, chunks, quantiles, rolling, sliding


def series(seed=1, n=400, names=("a", None)):
    rng = np.random.default_rng(seed)
    return [(s, i, None if rng.random() < 0.1 else float(rng.integers(0, 40))) for s in names for i in range(n)]


def test_sorted_windows_equal_pandas():
    values = [v for _, _, v in series(names=("a",))]
    p = pd.Series(values, dtype=float)
    for n, shift, least in ((20, 1, 20), (7, 0, 1), (15, 4, 3)):
        got = sliding.quantiles(values, (0.0, 0.31, 1.0), n, shift, least)
        for k, q in enumerate((0.0, 0.31, 1.0)):
            want = p.shift(shift).rolling(n, min_periods=least).quantile(q)
            assert all((g is None and math.isnan(w)) or abs(g[k] - w) < 1e-9 for g, w in zip(got, want))
    want = p.rolling(30, min_periods=10).apply(lambda x: x.rank().iloc[-1] / len(x), raw=False)
    want = [None if v is None or sum(x is not None for x in values[max(0, i - 29) : i + 1]) < 10 else w for i, (v, w) in enumerate(zip(values, want))]
    assert sliding.ranks(values, 30, 10) == pytest.approx(want)
    assert sliding.quantiles([], (0.5,), 3, 0, 1) == [] and sliding.ranks([None], 3, 1) == [None]


def test_long_quantiles_equal_plain_ones(spark):
    df = spark.createDataFrame(series(), "series string, at int, v double")
    plain = sliding.rolling_quantiles(df, "v", [0.2, 0.8], 25, ["series"], "at", "q", embargo=3, least=None)
    for rows in (10, 40, 1000):
        cut = sliding.rolling_quantiles_long(df, "v", [0.2, 0.8], 25, ["series"], ["at"], "q", embargo=3, rows=rows)
        assert sorted(map(repr, cut.collect())) == sorted(map(repr, plain.select(cut.columns).collect()))


def test_windows_in_ranges_equal_plain_windows_and_span_tasks(spark):
    df = spark.createDataFrame(series(2, 500, ("a", None, "b")) + [("c", 0, 1.0)], "series string, at int, v double").repartition(7)
    columns = lambda w: {"lag": F.lag("v", 9).over(w), "lead": F.lead("v", 4).over(w), "low": F.min("v").over(w.rowsBetween(-9, 4))}
    plain = df.withColumns(columns(rolling.ordered("series", "at")))
    cut = chunks.windows_in_ranges(df, ["series"], ["at"], columns, before=9, after=4, rows=50)
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, plain.collect()))
    ranges = chunks.in_ranges(df.where("series = 'a'"), ["series"], ["at"], lambda x, by, at: x.withColumn("by", F.concat_ws("/", *by)), 9, 4, 50)
    assert ranges.select("by").distinct().count() == 10
    assert chunks.windows_in_ranges(df.limit(0), ["series"], ["at"], columns, 9, 4).count() == 0


def test_positions(spark):
    rows = series(3, 300, ("a", None, "b")) + [("c", 0, None)]
    got = chunks.positions(spark.createDataFrame(rows, "series string, at int, v double").repartition(5), ["series"], ["at"]).collect()
    assert len(got) == len(rows) and all(r["_pos"] == r["at"] for r in got)


def test_values_carried_over_ranges_equal_plain_fills(spark):
    rows = [(s, i, float(i) if i in (3, 4, 250) and s != "z" else None, i * 1.5 if i % 90 == 0 else None) for s in ("a", None, "z") for i in range(300)]
    df = spark.createDataFrame(rows, "series string, at int, v double, u double").repartition(6)
    w = rolling.ordered("series", "at")
    plain = df.withColumns({c: rolling.forward_fill(F.col(c), w) for c in ("v", "u")})
    for n in (7, 100, 10_000):
        assert sorted(map(repr, chunks.carry_last(df, ["v", "u"], ["series"], ["at"], n).collect())) == sorted(map(repr, plain.collect()))
    before = F.avg("u").over(w.rowsBetween(Window.unboundedPreceding, -1))
    assert sorted(map(repr, chunks.mean_before(df, "u", "m", ["series"], ["at"], 20).collect())) == sorted(map(repr, df.withColumn("m", before).collect()))


def test_long_asof_equals_the_plain_one(spark):
    release = spark.createDataFrame([("k", i * 40, float(i), None if i % 3 else i) for i in range(1, 9)], "key string, date int, x double, y int")
    base = spark.createDataFrame([("k", i // 2, i) for i in range(600)] + [("other", 5, 0)], "key string, date int, row int")
    plain, cut = align.align_asof(release, base, ["key"]), chunks.align_asof_long(release, base, ["key"], rows=25)
    assert cut.columns == plain.columns and sorted(map(repr, cut.collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("most", [5, 100_000])
def test_quantiles_of_large_groups_equal_percentile(spark, most):
    rng = np.random.default_rng(most)
    rows = [("normal", float(x)) for x in rng.normal(0, 1, 700)] + [("ties", float(x)) for x in rng.integers(0, 3, 700)] + [("wide", float(x)) for x in 10.0 ** rng.integers(-300, 300, 300)]
    rows += [(None, 3.0), ("none", None), ("nan", float("nan")), ("nan", 2.0), ("one value", 7.0)] + [("one value", 7.0)] * 300 + [("signs", x) for x in (-float("inf"), -1.0, -0.0, 0.0, float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = (0.0, 0.05, 0.5, 0.85, 1.0)
    got = {r["g"]: r["q"] for r in quantiles.exact_quantiles(df, "v", probs, ["g"], most=most).collect()}
    want = {r["g"]: r["q"] for r in df.where("NOT isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect() if r["q"] is not None}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want if g != "signs")
    assert got["signs"][0] == -float("inf") and got["signs"][2] == 0.0 and got["signs"][4] == float("inf")
    assert quantiles.exact_quantiles(df.limit(0), "v", probs, ["g"]).count() == 0
