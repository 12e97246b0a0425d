"""Window operators over ordered series. w: the window of a series in date order, without a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(series: str | list[str], date: str = "date") -> WindowSpec:
    return Window.partitionBy(*([series] if isinstance(series, str) else series)).orderBy(date)


def _past(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def lag_n(c: Column, n: int, w: WindowSpec) -> Column:
    return F.lag(c, n).over(w)


def lead_n(c: Column, n: int, w: WindowSpec) -> Column:
    return F.lead(c, n).over(w)


def pct_change(c: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(c, F.lag(c, n).over(w)) - 1


def diff_n(c: Column, n: int, w: WindowSpec) -> Column:
    return c - F.lag(c, n).over(w)


def moving_avg(c: Column, n: int, w: WindowSpec, least: int = 1) -> Column:
    """Mean of the last n rows, null with fewer than `least` values."""
    f = _past(w, n)
    return F.when(F.count(c).over(f) >= least, F.avg(c).over(f))


def moving_std(c: Column, n: int, w: WindowSpec, least: int = 2) -> Column:
    """Sample standard deviation of the last n rows, null with fewer than `least` values (two at least)."""
    f = _past(w, n)
    return F.when(F.count(c).over(f) >= max(2, least), F.stddev_samp(c).over(f))


def trailing_avg(c: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the n rows before the current one, null unless all have values."""
    f = w.rowsBetween(-n, -1)
    return F.when(F.count(c).over(f) == n, F.avg(c).over(f))


def percentile_rank(c: Column, n: int, w: WindowSpec, least: int = 30) -> Column:
    """Average rank of the current value among those of the last n rows, divided by all rows in the frame, nulls too."""
    f = _past(w, n)
    seen = F.collect_list(c).over(f)
    below, equal = F.size(F.filter(seen, lambda x: x < c)), F.size(F.filter(seen, lambda x: x == c))
    return F.when(c.isNotNull() & (F.size(seen) >= least), (below + (equal + 1) / 2) / F.count(F.lit(1)).over(f))


def seasonal_mean(c: Column, series: list[str], season: str, date: str) -> Column:
    """Mean over all earlier rows of the same season."""
    return F.avg(c).over(Window.partitionBy(*series, season).orderBy(date).rowsBetween(Window.unboundedPreceding, -1))


def forward_fill(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def above_long_average(c: Column, n: int, w: WindowSpec) -> Column:
    """1 if above the mean of the last n rows, of which all must have values; else 0."""
    return F.coalesce(c > moving_avg(c, n, w, n), F.lit(False)).cast("int")


def time_index(df: DataFrame, date: str = "date", name: str = "time_idx") -> DataFrame:
    """Index of each distinct date, from 0. Only the calendar is numbered in one task."""
    calendar = df.select(date).where(F.col(date).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(date)) - 1)
    return df.join(calendar, date)


def naive_error(df: DataFrame, value: str, series: str, date: str = "date") -> DataFrame:
    """(series, mae): mean absolute error of the previous value as forecast."""
    return df.select(series, F.abs(diff_n(F.col(value), 1, ordered(series, date))).alias("e")).groupBy(series).agg(F.avg("e").alias("mae"))


def tail_nulls(df: DataFrame, value: str, series: str, n: int = 28, date: str = "date") -> DataFrame:
    """(series, nulls) among the last n rows."""
    late = df.withColumn("_r", F.row_number().over(Window.partitionBy(series).orderBy(F.desc(date)))).where(F.col("_r") <= n)
    return late.groupBy(series).agg(F.count(F.when(F.col(value).isNull(), 1)).alias("nulls"))


def sequence_samples(df: DataFrame, cols: list[str], series: str, date: str = "date", past: int = 112, least: int = 56, future: int = 28) -> DataFrame:
    """One training sample per row with enough neighbours: `encoder` (up to past rows, the current last) and `decoder`."""
    w = ordered(series, date)
    row = F.struct(date, *cols)
    out = df.select(series, date, F.collect_list(row).over(_past(w, past)).alias("encoder"), F.collect_list(row).over(w.rowsBetween(1, future)).alias("decoder"))
    return out.where((F.size("encoder") >= least) & (F.size("decoder") == future))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
