"""Forecast bands: quantiles, bias, fixed, scaled and rolling conformal bands, and their evaluation.

Tables: forecasts (series, time_idx, date, p10, p50, p90, actual, ...). p10 and p90 hold the 0.05 and 0.95 quantiles.
A bias is mean(actual - p50) and is added once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.align import value_ahead
from ..operators.rolling import diff_n, lag_n, ordered
from ..operators.sliding import horizon_quantiles, rolling_quantiles

LEVELS = (0.05, 0.5, 0.95)
HORIZONS = range(1, 29)
ALPHA, TARGET, WINDOW = 0.85, 80.0, 60
GRID = (0.80, 0.85, 0.90, 0.92)


def quantile_forecast(df: DataFrame, value: str, horizons: range = HORIZONS, window: int = 250, series: str = "series", date: str = "date") -> DataFrame:
    """(series, date, value, horizon, p10, p50, p90): quantiles of the last `window` h-row returns already realised, times the
    current value; all horizons from one pass over a series."""
    out = horizon_quantiles(df, value, horizons, LEVELS, window, series, date)
    return out.select(series, date, value, "horizon", *[(F.col(value) * (1 + F.col("q")[i])).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def return_to_price(df: DataFrame, level: str = "level", series: str = "series", index: str | None = None, ahead: int = 7) -> DataFrame:
    """Quantiles of returns as prices. With an index also `actual`: the level `ahead` index steps on, null if that row is missing."""
    out = df.withColumns({q: F.col(level) * (1 + F.col(q)) for q in ("p10", "p50", "p90")})
    return value_ahead(out, level, [series], index, ahead, "actual") if index else out


def horizon_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("p10", "p50", "p90", "actual")])


def sorted_quantiles(df: DataFrame) -> DataFrame:
    """lo and hi: smallest and largest of the three quantiles."""
    return df.withColumns({"lo": F.least("p10", "p50", "p90"), "hi": F.greatest("p10", "p50", "p90")})


def bias(df: DataFrame, inside: Column, keys: list[str]) -> DataFrame:
    """(keys, bias): mean(actual - p50) where inside; null without rows."""
    return df.groupBy(*keys).agg(F.avg(F.when(inside, F.col("actual") - F.col("p50"))).alias("bias"))


def bias_with_fallback(df: DataFrame, windows: list[Column], keys: list[str]) -> DataFrame:
    """The bias of the first window that has rows."""
    return df.groupBy(*keys).agg(F.coalesce(*[F.avg(F.when(w, F.col("actual") - F.col("p50"))) for w in windows]).alias("bias"))


def correct(df: DataFrame, biases: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles moved by the bias; unchanged where it is null."""
    b = F.coalesce("bias", F.lit(0.0))
    return df.join(biases, keys, "left").withColumns({q: F.col(q) + b for q in ("p10", "p50", "p90")}).drop("bias")


def half_width(df: DataFrame, inside: Column, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """(keys, q): exact quantile of absolute residuals where inside."""
    r = F.abs(F.col("actual") - F.col("p50"))
    return df.groupBy(*keys).agg(F.percentile(F.when(inside, r), F.lit(alpha)).alias("q"))


def scaled_half_width(df: DataFrame, calibration: Column, test: Column, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """As half_width, times the ratio of the actuals' deviations in test and calibration; ratio 1 where it can't be had."""
    r = F.abs(F.col("actual") - F.col("p50"))
    s = [F.stddev_samp(F.when(x, F.col("actual"))) for x in (test, calibration)]
    scale = F.coalesce(F.nullif(F.try_divide(*s), F.lit(0.0)), F.lit(1.0))
    return df.groupBy(*keys).agg((F.percentile(F.when(calibration, r), F.lit(alpha)) * scale).alias("q"))


def least_alpha(df: DataFrame, calibration: Column, test: Column, keys: list[str], target: float = TARGET) -> DataFrame:
    """(keys, need, alpha): the half-width that covers the target share of test rows, whose medians are moved by the calibration
    rows' bias, and the smallest quantile level of calibration residuals that reaches it: the inverse of the interpolated
    quantile; null if none does."""
    moved = correct(df.withColumns({"_c": calibration, "_t": test, "_r": F.abs(F.col("actual") - F.col("p50"))}), bias(df, calibration, keys), keys)
    rows = moved.select(*keys, F.col("_r").alias("_cal"), F.abs(F.col("actual") - F.col("p50")).alias("_r"), "_c", "_t").where("_r IS NOT NULL AND (_c OR _t)")
    ranked = rows.where("_t").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_r")))
    sizes = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("_t"), 1)) * target / 100)).cast("int").alias("_n"))
    need = sizes.join(ranked, [*keys, "_n"], "left").select(*keys, F.col("_r").alias("need"))
    lower = F.col("_cal") < F.col("need")
    sums = [F.count(F.lit(1)).alias("n"), F.count(F.when(lower, 1)).alias("below"), F.max(F.when(lower, F.col("_cal"))).alias("a"), F.min(F.when(~lower, F.col("_cal"))).alias("b")]
    got = need.join(rows.where("_c").join(need, keys).groupBy(*keys).agg(*sums), keys, "left").na.fill(0, ["n", "below"])
    n, below = F.col("n"), F.col("below")
    alpha = F.when((below >= n) | F.col("need").isNull(), None).when(below == 0, 0.0).otherwise((below - 1 + F.try_divide(F.col("need") - F.col("a"), F.col("b") - F.col("a"))) / (n - 1))
    return got.select(*keys, "need", alpha.alias("alpha"))


def rolling_conformal(df: DataFrame, alpha: float = ALPHA, window: int = WINDOW, embargo: int = 0, series: str = "series", order: str = "time_idx") -> DataFrame:
    """q, lo and hi: the quantile of the last `window` absolute residuals before each row.

    embargo: so many of the latest residuals are not known yet when a row is forecast; 7 for a target seven rows ahead.
    """
    r = df.withColumn("_r", F.abs(F.col("actual") - F.col("p50")))
    q = rolling_quantiles(r, "_r", alpha, window, [series], order, "q", embargo).drop("_r")
    return q.withColumns({"lo": F.col("p50") - F.col("q"), "hi": F.col("p50") + F.col("q")})


def coverage(lo: Column, hi: Column, actual: Column) -> Column:
    """Percent of actuals strictly inside."""
    return F.avg(F.when(lo.isNotNull() & hi.isNotNull() & actual.isNotNull(), ((actual > lo) & (actual < hi)).cast("double"))) * 100


def evaluate_bands(df: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE, coverage and mean half-width of a band lo, hi."""
    e = F.col("actual") - F.col("p50")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), coverage(F.col("lo"), F.col("hi"), F.col("actual")).alias("coverage"), F.avg((F.col("hi") - F.col("lo")) / 2).alias("half_width"))


def compare_bands(df: DataFrame, calibration: Column, test: Column, keys: list[str], alpha: float = ALPHA, window: int = WINDOW, order: str = "time_idx") -> DataFrame:
    """(keys, band, n, mae, rmse, coverage, half_width) of the test rows for each band: raw (between the outer quantiles, median
    as forecast), and around the median moved by the calibration rows' bias fixed (the calibration residuals' quantile), scaled
    (that times the ratio of deviations) and rolling (the last `window` residuals of the moved median; null at the start)."""
    q = half_width(df, calibration, keys, alpha).withColumnRenamed("q", "_fixed").join(scaled_half_width(df, calibration, test, keys, alpha).withColumnRenamed("q", "_scaled"), keys)
    moved = correct(df.withColumns({"_t": test, "_p50": F.col("p50"), "_p10": F.col("p10"), "_p90": F.col("p90")}), bias(df, calibration, keys), keys)
    moved = moved.withColumn("_r", F.abs(F.col("actual") - F.col("p50")))
    rows = rolling_quantiles(moved, "_r", alpha, window, keys, order, "_rolling").where("_t").join(q, keys)
    around = lambda name: F.struct(F.lit(name).alias("band"), F.col("p50"), (F.col("p50") - F.col(f"_{name}")).alias("lo"), (F.col("p50") + F.col(f"_{name}")).alias("hi"))
    raw = F.struct(F.lit("raw").alias("band"), F.col("_p50").alias("p50"), F.least("_p10", "_p90").alias("lo"), F.greatest("_p10", "_p90").alias("hi"))
    each = rows.select(*keys, "actual", F.explode(F.array(raw, *map(around, ("fixed", "scaled", "rolling")))).alias("x")).select(*keys, "actual", "x.*")
    return evaluate_bands(each, [*keys, "band"])


def alpha_grid(df: DataFrame, grid: tuple[float, ...] = GRID, window: int = WINDOW, series: str = "series", order: str = "time_idx") -> DataFrame:
    """(series, alpha, coverage, half_width) of rolling bands; all levels from one pass over the frames."""
    r = df.withColumn("_r", F.abs(F.col("actual") - F.col("p50")))
    q = rolling_quantiles(r.select(series, order, "p50", "actual", "_r"), "_r", list(grid), window, [series], order, "_q").where(F.col("_q").isNotNull())
    rows = q.select(series, "p50", "actual", F.posexplode("_q").alias("_i", "q")).withColumn("alpha", F.element_at(F.array(*map(F.lit, grid)), F.col("_i") + 1))
    return rows.groupBy(series, "alpha").agg(coverage(F.col("p50") - F.col("q"), F.col("p50") + F.col("q"), F.col("actual")).alias("coverage"), F.avg("q").alias("half_width"))


def best_alpha(grid: DataFrame, series: str = "series", target: float = TARGET) -> DataFrame:
    """Per series the level closest to the target coverage, the narrowest of several."""
    return grid.groupBy(series).agg(F.min_by("alpha", F.struct(F.abs(F.col("coverage") - target), F.col("half_width"), F.col("alpha"))).alias("alpha"))


def better_version(biases: DataFrame, keys: list[str]) -> DataFrame:
    """The version with the smaller absolute bias. biases: (keys, version, bias)."""
    return biases.groupBy(*keys).agg(F.min_by("version", F.struct(F.abs("bias"), F.col("version"))).alias("version"))


def compare_versions(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both versions' medians on common keys, with the mean of their actuals."""
    left = a.select(*keys, F.col("p50").alias("p50_a"), F.col("actual").alias("_x"))
    right = b.select(*keys, F.col("p50").alias("p50_b"), F.col("actual").alias("_y"))
    return left.join(right, keys).withColumn("actual", (F.col("_x") + F.col("_y")) / 2).drop("_x", "_y")


def diagnostics(df: DataFrame, ranges: dict[str, Column], series: str = "series", order: str = "time_idx") -> DataFrame:
    """Volatility and mean move of the actuals, and residual statistics, by range."""
    rows = df.withColumn("_m", F.abs(diff_n(F.col("actual"), 1, ordered(series, order)))).withColumn("_e", F.col("actual") - F.col("p50"))
    aggs = []
    for name, inside in ranges.items():
        pick = {c: F.when(inside, F.col(c)) for c in ("actual", "_m", "_e")}
        aggs += [F.stddev_samp(pick["actual"]).alias(f"{name}_volatility"), F.avg(pick["_m"]).alias(f"{name}_move"), F.avg(pick["_e"]).alias(f"{name}_mean_error"), F.stddev_samp(pick["_e"]).alias(f"{name}_std_error"), F.percentile(F.abs(pick["_e"]), F.lit(0.8)).alias(f"{name}_q80")]
    return rows.groupBy(series).agg(*aggs)


def half_width_rank(df: DataFrame, calibration: Column, test: Column, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """(keys, q, rank_pct): a half-width from calibration residuals, and the percentage of test residuals that it reaches."""
    r = F.abs(F.col("actual") - F.col("p50"))
    rows = df.select(*keys, F.when(test, r).alias("_r")).join(half_width(df, calibration, keys, alpha), keys)
    return rows.groupBy(*keys).agg(F.first("q").alias("q"), (100 * F.avg((F.col("_r") <= F.col("q")).cast("double"))).alias("rank_pct"))


def naive_baseline(df: DataFrame, inside: Column, series: str = "series", order: str = "time_idx") -> DataFrame:
    """(series, mae) of the previous actual as forecast."""
    rows = df.withColumn("_e", F.abs(F.col("actual") - lag_n(F.col("actual"), 1, ordered(series, order)))).where(inside)
    return rows.groupBy(series).agg(F.avg("_e").alias("mae"))
