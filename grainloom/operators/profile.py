"""Profiles of tables and data-quality rules."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import ordered


def conditional_sums(df: DataFrame, keys: list[str], value: str, metrics: dict[str, Column]) -> DataFrame:
    """Sum of value where each metric's condition holds, by key; keys without any metric go."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.when(cond, F.col(value))).alias(m) for m, cond in metrics.items()])
    return sums.where(F.coalesce(*metrics).isNotNull())


def stock_to_use(df: DataFrame, keys: list[str], stocks: str = "ending", use: str = "domestic") -> DataFrame:
    """stocks / use; null when use is 0 or absent, 0 when only stocks are absent."""
    return df.withColumn("stock_to_use", F.try_divide(F.coalesce(F.col(stocks), F.lit(0.0)), F.nullif(F.col(use), F.lit(0.0))))


def arg_max(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_value(df: DataFrame, keys: list[str], seq: str, metrics: dict[str, tuple[Column, str]]) -> DataFrame:
    """For each metric the value of the latest row for which its condition holds."""
    return df.groupBy(*keys).agg(*[F.max_by(F.when(cond, F.col(v)), F.when(cond & F.col(v).isNotNull(), F.col(seq))).alias(m) for m, (cond, v) in metrics.items()])


def summary(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    c = F.col(col)
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg((c < 0).cast("int")).alias("negative_share"))


def null_rates(df: DataFrame, cols: list[str], top: int | None = None) -> DataFrame:
    """(name, null_rate), highest first; one pass over the table."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    out = one.unpivot([], cols, "name", "null_rate").orderBy(F.desc("null_rate"), "name")
    return out.limit(top) if top else out


def label_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def table_summary(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).select(F.lit(name).alias("table_name"), "*")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) of each pair of columns over the rows that have both; one pass."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(x)) for x in (a, b))).alias(f"{a}|{b}") for a, b in pairs])
    out = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return out.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "corr")


def autocorrelation(df: DataFrame, value: str, series: str, lags: int, date: str = "date") -> DataFrame:
    """(series, lag, acf) up to so many lags, about the series' mean."""
    w = ordered(series, date)
    mean = F.avg(value).over(Window.partitionBy(series))
    dev = df.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - mean)
    prods = dev.select(series, "_d", *[(F.col("_d") * F.lag("_d", k).over(w)).alias(str(k)) for k in range(1, lags + 1)])
    sums = prods.groupBy(series).agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(str(k)).alias(str(k)) for k in range(1, lags + 1)])
    long = sums.unpivot([series, "_v"], [str(k) for k in range(1, lags + 1)], "lag", "_s")
    return long.select(series, F.col("lag").cast("int").alias("lag"), F.try_divide("_s", "_v").alias("acf"))


def partial_autocorrelation(acf: DataFrame, series: str) -> DataFrame:
    """(series, lag, pacf) from autocorrelations by the Durbin-Levinson recursion, some forty numbers a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("lag")["acf"].to_numpy()
        phi, out = np.zeros(0), []
        for k in range(len(r)):
            last = (r[k] - phi @ r[:k][::-1]) / (1 - phi @ r[:k]) if k else r[0]
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return pd.DataFrame({series: pdf[series].iloc[0], "lag": np.arange(1, len(r) + 1, dtype=np.int32), "pacf": out})

    return acf.groupBy(series).applyInPandas(run, f"{series} {acf.schema[series].dataType.simpleString()}, lag int, pacf double")


def unit_root(df: DataFrame, value: str, series: str, lags: int = 1, date: str = "date", critical: float = -2.86, least: int = 20) -> DataFrame:
    """(series, n, statistic, stationary): t statistic of the level in a regression of differences on level, constant and
    `lags` lagged differences. The sums of squares are Spark aggregates; a small system per series is solved in pandas.
    """
    w = ordered(series, date)
    d = df.where(F.col(value).isNotNull()).withColumn("_y", F.col(value) - F.lag(value).over(w)).withColumn("_x1", F.lag(value).over(w))
    d = d.withColumns({f"_x{i + 1}": F.lag("_y", i).over(w) for i in range(1, lags + 1)})
    xs = ["1"] + [f"_x{i + 1}" for i in range(lags + 1)]
    full = d.dropna(subset=["_y", *xs[1:]])
    term = {x: F.lit(1.0) if x == "1" else F.col(x) for x in xs} | {"_y": F.col("_y")}
    names = [*xs, "_y"]
    sums = full.groupBy(series).agg(*[F.sum(term[a] * term[b]).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])
    k = len(xs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                m = np.zeros((k + 1, k + 1))
                for i in range(k + 1):
                    for j in range(i, k + 1):
                        m[i, j] = m[j, i] = getattr(row, f"s{i}_{j}")
                n, stat = int(m[0, 0]), None
                if n >= max(least, k + 1):
                    try:
                        inv = np.linalg.inv(m[:k, :k])
                        beta = inv @ m[:k, k]
                        var = (m[k, k] - beta @ m[:k, k]) / (n - k)
                        stat = float(beta[1] / np.sqrt(var * inv[1, 1])) if var > 0 else None
                    except np.linalg.LinAlgError:
                        stat = None
                rows.append((getattr(row, series), n, stat, None if stat is None else stat < critical))
            yield pd.DataFrame(rows, columns=[series, "n", "statistic", "stationary"])

    return sums.mapInPandas(solve, f"{series} {df.schema[series].dataType.simpleString()}, n int, statistic double, stationary boolean")


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bins from 1, 0 below and bins + 1 from high on."""
    return df.where(F.col(col).isNotNull()).groupBy(F.width_bucket(F.col(col), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def group_null_share(rates: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(grp, null_share): mean null rate of columns by prefix."""
    group = F.lit("other")
    for g, prefixes in reversed(groups.items()):
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | F.col("name").startswith(p)
        group = F.when(cond, g).otherwise(group)
    return rates.groupBy(group.alias("grp")).agg(F.avg("null_rate").alias("null_share"))


def complete_rows(df: DataFrame, cols: list[str], without: list[str]) -> DataFrame:
    """Rows complete in all of cols, and in those not listed in without."""
    def full(names: list[str]) -> Column:
        ok = F.lit(True)
        for n in names:
            ok = ok & F.col(n).isNotNull()
        return F.count(F.when(ok, 1))

    return df.agg(F.count(F.lit(1)).alias("n"), full(cols).alias("complete"), full([c for c in cols if c not in without]).alias("complete_without"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(shared, share): names among the first k of both rankings (name, rank)."""
    both = a.where(F.col("rank") <= k).join(b.where(F.col("rank") <= k), "name", "left_semi")
    return both.agg(F.count(F.lit(1)).alias("shared"), (F.count(F.lit(1)) / k).alias("share"))


# ---- quality rules


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def ohlcv_rules() -> dict[str, Column]:
    """What is wrong with a row: no date, high below low, a price that is not positive."""
    return {"no_date": F.col("date").isNull(), "high_below_low": F.col("high") < F.col("low"), "not_positive": F.least("open", "high", "low", "close") <= 0}


def ohlcv_counts(df: DataFrame) -> DataFrame:
    """One row: how many rows break each rule."""
    require_columns(df, ["date", "open", "high", "low", "close"])
    return df.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in ohlcv_rules().items()])


def ohlcv_violations(df: DataFrame) -> dict[str, int]:
    """Rows that break each rule."""
    return ohlcv_counts(df).first().asDict()


def validate_ohlcv(df: DataFrame) -> DataFrame:
    """df, or an error that names the violated rules."""
    found = {k: n for k, n in ohlcv_violations(df).items() if n and k != "not_positive"}
    if found:
        raise ValueError(f"rejected batch: {found}")
    return df


def quarantine(df: DataFrame, policy: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Good and bad rows by the rules high >= low and positive prices; policy "fail" raises if there are bad ones."""
    ok = F.coalesce((F.col("high") >= F.col("low")) & (F.least("open", "high", "low", "close") > 0), F.lit(False))
    good, bad = df.where(ok), df.where(~ok)
    if policy == "fail" and bad.limit(1).count():
        raise ValueError("rows with high below low or without positive prices")
    return good, bad


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid scenario requests and rejected ones with their reasons; context: there is no price."""
    rules = {
        "context": F.col("current_price_cbot").isNotNull() & F.col("decision_date").isNotNull(),
        "stock": F.col("current_inventory_ton").isNotNull() & F.col("open_po_ton").isNotNull() & F.col("safety_stock_ton").isNotNull(),
        "quantity": F.col("quantity_ton") > 0,
        "consumption": F.col("monthly_consumption_ton") > 0,
        "quantile order": (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90")),
        "unit": F.col("forecast_unit").isin("cbot", "usd_per_ton"),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(name) for name, ok in rules.items()]))
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)
