"""Feature blocks, the daily master table, panels. Every block works on any number of series at once."""

from __future__ import annotations

import warnings
from datetime import date as Date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import event_features, season_features
from ..functions.clean import USD_PER_TON, clean_inf, crush_spread, ratio, to_usd_per_ton
from ..operators.align import align_asof_all, align_exact_ffill, inner_join, join_backbone
from ..operators.profile import arg_max
from ..operators.rolling import above_long_average, diff_n, lag_n, lead_n, moving_avg, moving_std, ordered, pct_change, percentile_rank, seasonal_mean, time_index, trailing_avg

KEYS = ["series", "date"]
# Sample weights of periods of unrest, index and date splits of the panels.
WEIGHTS = ((Date(2022, 2, 1), Date(2022, 8, 31), 3.0), (Date(2021, 1, 1), Date(2021, 12, 31), 2.5), (Date(2025, 1, 1), None, 2.0))
TRAIN_END, VALID_END, TEST_START = Date(2024, 12, 31), Date(2025, 9, 30), Date(2025, 10, 1)
CALIBRATION_ROWS, TEST_ROWS = 90, 30
LABELS = {7: 0.02, 28: 0.03}


def price_block(df: DataFrame, value: str = "price_close") -> DataFrame:
    """Lags, averages, ratios, returns and volatilities of a close. All windows share one shuffle and sort."""
    w, c = ordered("series"), F.col(value)
    out = df.withColumns({f"price_lag_{n}": lag_n(c, n, w) for n in (1, 3, 7, 14, 30)} | {f"price_ma_{n}": moving_avg(c, n, w) for n in (7, 14, 30)} | {f"return_{n}d": pct_change(c, n, w) for n in (1, 3, 7, 14)})
    out = out.withColumns({f"price_to_ma{n}_ratio": ratio(c, F.col(f"price_ma_{n}")) for n in (7, 14, 30)})
    return out.withColumns({f"volatility_{n}d": moving_std(F.col("return_1d"), n, w, m) for n, m in ((5, 2), (10, 3), (20, 5))})


def market_block(df: DataFrame, value: str, name: str, lag: bool = True, ret: int | None = 7, vol: tuple[int, int] | None = (14, 5)) -> DataFrame:
    """(series, date, value, lag 1, return, volatility) of another market on its own dates."""
    w, c = ordered("series"), F.col(value)
    cols = {}
    if lag:
        cols[f"{name}_lag_1"] = lag_n(c, 1, w)
    if ret:
        cols[f"{name}_return_{ret}d"] = pct_change(c, ret, w)
    out = df.withColumns(cols)
    if vol:
        out = out.withColumn("_r", pct_change(c, 1, w)).withColumn(f"{name}_volatility_{vol[0]}d", moving_std(F.col("_r"), vol[0], w, vol[1])).drop("_r")
    return out


def crush_block(oil: DataFrame, meal: DataFrame, beans: DataFrame) -> DataFrame:
    """Crush spread per ton on the dates that all three have, its 7-row average and lag. Inputs: series, date, zl/zm/zs_close."""
    return crush_of_legs(inner_join([oil, meal, beans], KEYS))


def crush_of_legs(legs: DataFrame) -> DataFrame:
    """crush_block of one table with zl_close, zm_close and zs_close; rows without all three go."""
    legs = legs.dropna(subset=["zl_close", "zm_close", "zs_close"])
    spread = crush_spread(to_usd_per_ton(F.col("zl_close"), "soyoil"), to_usd_per_ton(F.col("zm_close"), "soymeal"), to_usd_per_ton(F.col("zs_close"), "soybean"))
    w = ordered("series")
    return legs.withColumn("crush_spread", spread).withColumns({"crush_spread_ma7": moving_avg(F.col("crush_spread"), 7, w), "crush_spread_lag_1": lag_n(F.col("crush_spread"), 1, w)})


def positioning_block(df: DataFrame) -> DataFrame:
    """Net position on release dates with its change and the ratio of longs to shorts."""
    w = ordered("series")
    return df.select(*KEYS, "cftc_noncomm_net", diff_n(F.col("cftc_noncomm_net"), 1, w).alias("cftc_noncomm_net_chg_1w"), ratio(F.col("long"), F.col("short")).alias("cftc_long_short_ratio"))


def supply_block(df: DataFrame, year_key: Column) -> DataFrame:
    """One row per release: that of the latest marketing year."""
    return arg_max(df.withColumn("_k", year_key), KEYS, F.desc("_k")).drop("_k")


def level_block(df: DataFrame, value: str, pct: tuple[int, ...] = (), diffs: tuple[int, ...] = (), unit: str = "m") -> DataFrame:
    """A slow level with relative and absolute changes over its own rows, before alignment."""
    w, c = ordered("series"), F.col(value)
    return df.withColumns({f"{value}_chg_{n}{unit}": pct_change(c, n, w) for n in pct} | {f"{value}_chg_{n}{unit}": diff_n(c, n, w) for n in diffs})


def spot_block(df: DataFrame, value: str = "spot_price_usd") -> DataFrame:
    """A monthly spot price as a release: the mean of each month's quotes, known from the month's first day."""
    return df.groupBy("series", F.trunc("date", "MM").alias("date")).agg(F.avg(value).alias(value))


def return_after(df: DataFrame, value: str, n: int = 30) -> DataFrame:
    """The return of an aligned release over the backbone's own rows: for series that report rarely."""
    return df.withColumn(f"{value.removesuffix('_close')}_return_{n}d", pct_change(F.col(value), n, ordered("series")))


def volatility_index_block(df: DataFrame) -> DataFrame:
    return market_block(df, "vix_close", "vix", vol=None).withColumn("vix_regime", F.when(F.col("vix_close").isNotNull(), (F.col("vix_close") > 25).cast("int")))


def derived_block(df: DataFrame) -> DataFrame:
    """Market average, spreads, prices per ton, acceleration, percentile, seasonal adjustment and regime."""
    w, pc = ordered("series"), F.col("price_close")
    have = set(df.columns)

    def opt(name: str) -> Column:
        return F.col(name).cast("double") if name in have else F.lit(None).cast("double")

    out = df.withColumn("market_avg_price_30d", trailing_avg(pc, 30, w))
    palm = F.coalesce(opt("palm_oil_close"), opt("palm_close"))
    out = out.withColumns(
        {
            "price_vs_market_avg": ratio(pc, F.col("market_avg_price_30d")) - 1, "palm_soyoil_spread": pc - opt("palm_close"), "basis": pc - opt("spot_price_usd"), "soyoil_usd_per_ton": to_usd_per_ton(pc, "soyoil"),
            "wti_usd_per_ton": to_usd_per_ton(opt("wti_close"), "wti"), "soybean_usd_per_ton": to_usd_per_ton(opt("zs_close"), "soybean"), "soymeal_usd_per_ton": to_usd_per_ton(opt("zm_close"), "soymeal"),
            "canola_usd_per_ton": to_usd_per_ton(opt("canola_close"), "canola"), "palm_oil_close": palm, "palm_usd_per_ton": palm, "momentum_accel_7d": F.col("return_7d") - F.col("return_14d"),
            "cftc_percentile_52w": percentile_rank(opt("cftc_noncomm_net"), 252, w), "price_above_200d_ma": above_long_average(pc, 200, w),
        }
    )
    return out.withColumn("seasonal_adj_return_7d", F.col("return_7d") - seasonal_mean(F.col("return_7d"), ["series"], "week_of_year", "date"))


def label_block(df: DataFrame) -> DataFrame:
    """Future prices, returns, directions and thresholds; null where the future is unknown."""
    w, pc = ordered("series"), F.col("price_close")
    out = df.withColumns({f"target_price_t{n}": lead_n(pc, n, w) for n in (1, 7, 28)})
    out = out.withColumns({f"target_return_t{n}": ratio(F.col(f"target_price_t{n}"), pc) - 1 for n in LABELS})
    r = {n: F.col(f"target_return_t{n}") for n in LABELS}
    known = {f"target_updown_t{n}": F.when(r[n].isNotNull(), (r[n] > 0).cast("int")) for n in LABELS}
    return out.withColumns(known | {f"target_thresh_t{n}": F.when(r[n].isNotNull(), (r[n] > t).cast("int")) for n, t in LABELS.items()})


def calendar_block(df: DataFrame) -> DataFrame:
    d = F.col("date")
    return df.withColumns(season_features(d) | event_features(d))


def build_master(
    price: DataFrame, same_day: list[DataFrame] = (), releases: list[DataFrame] = (), version: str = "v1", as_of: Date | None = None, mode: str = "asof", labels_before_cut: bool = False, after: tuple[str, ...] = ()
) -> DataFrame:
    """The wide daily table of every series.

    price: (series, date, price_close), whose dates are the backbone. same_day: blocks joined on equal dates. releases:
    blocks whose values hold until the next one, aligned as of their date (mode "exact": only releases on a backbone
    date count). after: aligned columns that get a 30-row return then. as_of cuts the backbone before labels are computed, unless labels_before_cut.
    """
    if as_of and not labels_before_cut:
        price = price.where(F.col("date") <= F.lit(as_of))
    base = price_block(price)
    base = join_backbone(base, list(same_day), KEYS)
    if mode not in ("asof", "exact"):
        raise KeyError(mode)
    if mode == "asof":
        base = align_asof_all(list(releases), base, ["series"])
    else:
        for r in releases:
            base = align_exact_ffill(r, base, ["series"])
    for value in after:
        base = return_after(base, value)
    out = label_block(derived_block(calendar_block(base))).withColumn("feature_version", F.lit(version))
    if as_of and labels_before_cut:
        out = out.where(F.col("date") <= F.lit(as_of))
    return clean_inf(out)


def select_features(df: DataFrame, columns: list[str], label: str, keep: tuple[str, ...] = ("series", "date")) -> DataFrame:
    """The named features that the table has, and the label; absent ones are warned of, labels among them removed."""
    wanted = [c for c in columns if not c.startswith("target_") and c != "feature_version"]
    absent = [c for c in wanted if c not in df.columns]
    if absent:
        warnings.warn(f"absent features: {absent}", stacklevel=2)
    return df.select(*keep, *[c for c in wanted if c in df.columns and c not in keep], label)


def complete_sets(df: DataFrame, sets: dict[str, list[str]], label: str) -> DataFrame:
    """(series, date, label, complete): bit i is 1 if the row has the label and all columns of the i-th set (at most 31),
    NaN counting as null. Each column is looked at once, in however many sets it is."""
    together: dict[int, list[str]] = {}
    for c in dict.fromkeys(c for names in sets.values() for c in names):
        together.setdefault(sum(1 << i for i, names in enumerate(sets.values()) if c in names), []).append(c)
    kinds, every = dict(df.dtypes), (1 << len(sets)) - 1

    def lacks(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()

    complete = F.when(lacks(label), 0).otherwise(every)
    for bits, names in together.items():
        complete = complete.bitwiseAND(F.when(reduce(Column.__or__, map(lacks, names)), every & ~bits).otherwise(every))
    return df.select(*KEYS, label, complete.alias("complete"))


def count_sets(complete: DataFrame, sets: dict[str, list[str]], label: str) -> DataFrame:
    """(version, n_features, complete, up): complete rows of each set and the sum of their labels, from complete_sets in one pass."""
    has = {v: F.col("complete").bitwiseAND(F.lit(1 << i)) != 0 for i, v in enumerate(sets)}
    one = complete.agg(*[F.struct(F.lit(v).alias("version"), F.lit(len(names)).alias("n_features"), F.count(F.when(has[v], 1)).alias("complete"), F.sum(F.when(has[v], F.col(label))).alias("up")).alias(f"_{i}") for i, (v, names) in enumerate(sets.items())])
    return one.select(F.inline(F.array(*one.columns)))


def complete_cases(df: DataFrame, label: str) -> DataFrame:
    """Rows without nulls; labels other than 0 and 1 are an error."""
    out = df.dropna()
    if out.where(~F.col(label).isin(0, 1)).limit(1).count():
        raise ValueError(f"{label} must be 0 or 1")
    return out


def aligned_closes(closes: dict[str, DataFrame]) -> DataFrame:
    """(date, commodity, price_close) in USD per ton of (date, close) tables by commodity."""
    out = None
    for name, df in closes.items():
        one = df.select("date", F.lit(name).alias("commodity"), (F.col("close") * USD_PER_TON[name]).alias("price_close"))
        out = one if out is None else out.unionByName(one)
    return out


def wide_to_panel(wide: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Long panel (date, commodity, price_close) of the rows on which all price columns have values."""
    full = wide.dropna(subset=list(columns)).withColumnsRenamed(columns)
    return full.select("date", *columns.values()).unpivot("date", list(columns.values()), "commodity", "price_close")


def enrich_panel(panel: DataFrame, master: DataFrame, date: str = "date") -> DataFrame:
    """The long panel with the master's columns of its dates; those that the panel has are its own. The master has a row a date."""
    return panel.join(master.select(date, *[c for c in master.columns if c not in panel.columns]), date)


def panel_features(panel: DataFrame) -> DataFrame:
    """Panel of complete cases with lags, return, volatility, ratio, time index and split."""
    w, c = ordered("commodity"), F.col("price_close")
    out = panel.withColumns({"lag_1": lag_n(c, 1, w), "lag_7": lag_n(c, 7, w), "return_7d": pct_change(c, 7, w), "_r": pct_change(c, 1, w), "_m": moving_avg(c, 30, w, 15)})
    out = out.withColumns({"volatility_20d": moving_std(F.col("_r"), 20, w, 5), "ma30_ratio": ratio(c, F.col("_m"))}).drop("_r", "_m").dropna()
    split = F.when(F.col("date") <= F.lit(TRAIN_END), "train").when(F.col("date") <= F.lit(VALID_END), "valid").otherwise("test")
    return time_index(out, "date").withColumn("split", split)


def return_panel(panel: DataFrame, n: int = 7) -> DataFrame:
    """Forward n-row return as target with past features, complete cases."""
    w, c = ordered("commodity"), F.col("price_close")
    out = panel_features(panel).withColumn("target_return", ratio(lead_n(c, n, w), c) - 1)
    return out.dropna()


def sample_weight(date: Column, return_7d: Column) -> Column:
    """Weight of a period, times 1.5 after a move of over 5 %."""
    out = F.lit(1.0)
    for a, b, weight in reversed(WEIGHTS):
        inside = date >= F.lit(a) if b is None else date.between(F.lit(a), F.lit(b))
        out = F.when(inside, weight).otherwise(out)
    return out * F.when(F.abs(return_7d) > 0.05, 1.5).otherwise(1.0)


def index_split(df: DataFrame, index: str = "time_idx") -> DataFrame:
    """`part`: the last 30 indexes are test, the 90 before calibration, the others train."""
    last = df.agg(F.max(index)).first()[0]
    if last is None:
        return df.withColumn("part", F.lit(None).cast("string"))
    test = F.col(index) > last - TEST_ROWS
    return df.withColumn("part", F.when(test, "test").when(F.col(index) > last - TEST_ROWS - CALIBRATION_ROWS, "calibration").otherwise("train"))
