"""Registered queries of the master table with every block, of feature sets, models by exported weights, stored sequences and
records of unknown shape."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar as cal
from .functions import clean
from .operators import align, chunks, profile, rolling, sequences
from .plans import features, learn, versions
from .queries import LAGS, MODEL, PART, PX, TUESDAYS, frame, price, query, r, table, training
from .round_trips import csv, folder
from .sources import readers

# ---- the master with all blocks
# Stand-ins: other markets are a series' own close times a factor, with some days of the month missing; releases are a series' months on the 10th.

#: Block: (factor, gap: days of the month that this divides are missing).
MARKETS = {"usd_brl": (0.5, 7), "wti": (0.9, 6), "palm": (30.0, 5), "dxy": (0.8, 4), "canola": (1.7, 7), "sunflower": (2.3, 6), "vix": (0.03, 5), "zl": (1.0, 6), "zm": (2.0, 7), "zs": (3.0, 8)}
AS_OF = Date(2000, 6, 30)
CLOSES = [*versions.LEVEL, "usd_brl_close", "usd_brl_lag_1", "wti_close", "wti_lag_1", "palm_close", "palm_lag_1", "palm_soyoil_spread", "palm_oil_close", "palm_usd_per_ton", *versions.CRUSH, "dxy_close", "dxy_lag_1", "canola_close", "canola_lag_1", "sunflower_close", "vix_close", "vix_lag_1", "spot_price_usd", "basis", "market_avg_price_30d", "soyoil_usd_per_ton", "wti_usd_per_ton", "soybean_usd_per_ton", "soymeal_usd_per_ton", "canola_usd_per_ton", *versions.POSITIONS, "wasde_world_production", "biodiesel_production_kbbl", "fed_rate", "fed_rate_chg_1m", "fed_rate_chg_3m", "target_price_t1", "target_price_t7", "target_price_t28"]
RATIOS = [*versions.PRICE, "usd_brl_return_7d", "usd_brl_volatility_14d", "wti_return_7d", "wti_volatility_14d", "palm_return_7d", "dxy_return_7d", "dxy_volatility_14d", "canola_return_7d", "sunflower_return_30d", "vix_return_7d", "wasde_soyoil_stock_to_use", "wasde_soy_prod_brazil", "biodiesel_chg_4w", "price_vs_market_avg", "momentum_accel_7d", "cftc_percentile_52w", "seasonal_adj_return_7d", "target_return_t7", "target_return_t28"]
FLAGS = ["is_interpolated", "vix_regime", "price_above_200d_ma", *versions.SEASON, *versions.EVENTS, "target_updown_t7", "target_updown_t28", "target_thresh_t7", "target_thresh_t28", "feature_version"]
MASTER_DIGITS = dict.fromkeys(CLOSES, 3) | dict.fromkeys(RATIOS, 6)


def market_sql(name: str, vol: bool = True, lag: bool = True) -> str:
    factor, gap = MARKETS[name]
    more = (f", lag(v) OVER w AS {name}_lag_1, v / lag(v, 7) OVER w - 1 AS {name}_return_7d" if lag else "") + (f", CASE WHEN count(g) OVER {frame(14)} >= 5 THEN stddev_samp(g) OVER {frame(14)} END AS {name}_volatility_14d" if vol else "")
    return f"{name} AS (SELECT series, date, v AS {name}_close{more} FROM (SELECT *, v / lag(v) OVER {PART}) - 1 AS g FROM (SELECT series, date, c * {factor}::DOUBLE AS v FROM px WHERE day(date) % {gap} <> 0)) WINDOW w AS {PART}))"


EXCHANGE_SQL = f"""ends AS (SELECT series, min(date) AS a, max(date) AS b FROM px WHERE day(date) % 7 <> 0 GROUP BY 1), fxd AS (SELECT series, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM ends),
 fx0 AS (SELECT d.series, d.date, last_value(c * 0.5::DOUBLE IGNORE NULLS) OVER (PARTITION BY d.series ORDER BY d.date) AS v, (c IS NULL)::INTEGER AS is_interpolated FROM fxd d LEFT JOIN (SELECT * FROM px WHERE day(date) % 7 <> 0) p ON d.series = p.series AND d.date = p.date),
 usd_brl AS (SELECT series, date, is_interpolated, v AS usd_brl_close, lag(v) OVER w AS usd_brl_lag_1, v / lag(v, 7) OVER w - 1 AS usd_brl_return_7d, CASE WHEN count(g) OVER {frame(14)} >= 5 THEN stddev_samp(g) OVER {frame(14)} END AS usd_brl_volatility_14d
  FROM (SELECT *, v / lag(v) OVER {PART}) - 1 AS g FROM fx0) WINDOW w AS {PART}))"""
RELEASES_SQL = f"""mon AS (SELECT series, date_trunc('month', date)::DATE + 9 AS date, sum(c) AS t, count(*)::DOUBLE AS n, max(c) AS hi, min(c) AS lo FROM px GROUP BY 1, 2),
 rel AS (SELECT series, date, t AS cftc_noncomm_net, t - lag(t) OVER w AS cftc_noncomm_net_chg_1w, t / n AS cftc_long_short_ratio, n / hi AS wasde_soyoil_stock_to_use, hi / lo AS wasde_soy_prod_brazil, lo / n AS wasde_world_production,
  n AS biodiesel_production_kbbl, n / lag(n, 4) OVER w - 1 AS biodiesel_chg_4w, hi AS fed_rate, hi - lag(hi) OVER w AS fed_rate_chg_1m, hi - lag(hi, 3) OVER w AS fed_rate_chg_3m FROM mon WINDOW w AS {PART})),
 spot AS (SELECT series, date_trunc('month', date)::DATE AS date, avg(c) * 1.1::DOUBLE AS spot_price_usd FROM px GROUP BY 1, 2)"""
CRUSH_SQL = f"""cr0 AS (SELECT zl.series, zl.date, zm_close, zs_close, zl_close * 22.0462::DOUBLE * 0.179::DOUBLE + zm_close * 1.10231::DOUBLE * 0.765::DOUBLE - zs_close * (36.744::DOUBLE / 100.0::DOUBLE) AS crush_spread FROM zl JOIN zm USING (series, date) JOIN zs USING (series, date)),
 crush AS (SELECT *, avg(crush_spread) OVER {frame(7)} AS crush_spread_ma7, lag(crush_spread) OVER {PART}) AS crush_spread_lag_1 FROM cr0)"""
#: Released blocks with the columns that each brings.
RELEASED = {
    "dxy": versions.DOLLAR, "canola": ("canola_close", "canola_lag_1", "canola_return_7d"), "sunflower": ("sunflower_close",), "vixr": versions.FEAR,
    "rel": (*versions.POSITIONS, *versions.SUPPLY, "biodiesel_production_kbbl", "biodiesel_chg_4w", *versions.RATE), "spot": ("spot_price_usd",),
}


def master_sql(exact: bool) -> str:
    """Full form: as-of alignment, the cut before labels. Exact form: releases on trading days only, the cut after labels, without palm, canola and spot."""
    absent = ("palm", "canola", "spot") if exact else ()
    blocks = ["px AS (SELECT * FROM px0)", EXCHANGE_SQL, *[market_sql(m) for m in ("wti", "dxy")], *[market_sql(m, vol=False) for m in ("palm", "canola", "vix")], *[market_sql(m, vol=False, lag=False) for m in ("sunflower", "zl", "zm", "zs")]]
    blocks += ["vixr AS (SELECT *, (vix_close > 25)::INTEGER AS vix_regime FROM vix)", CRUSH_SQL, RELEASES_SQL]
    base = "base AS (SELECT * FROM px" + ("" if exact else f" WHERE date <= DATE '{AS_OF}'") + ")"
    same = {"usd_brl": ("usd_brl_close", "is_interpolated", *versions.EXCHANGE), "wti": ("wti_close", *versions.CRUDE), "palm": ("palm_close", "palm_lag_1", "palm_return_7d"), "crush": ("zm_close", "zs_close", *versions.CRUSH)}
    cols = ["b.series", "b.date", "b.c"]
    joins = ""
    for n, names in same.items():
        cols += [f"NULL::DOUBLE AS {c}" if n in absent else f"{n}.{c}" for c in names]
        joins += "" if n in absent else f" LEFT JOIN {n} ON b.series = {n}.series AND b.date = {n}.date"
    for n, names in RELEASED.items():
        cols += [f"NULL::DOUBLE AS {c}" if n in absent else (f"last_value({n}.{c} IGNORE NULLS) OVER (PARTITION BY b.series ORDER BY b.date) AS {c}" if exact else f"{n}.{c}") for c in names]
        joins += "" if n in absent else (f" LEFT JOIN {n} ON b.series = {n}.series AND b.date = {n}.date" if exact else f" ASOF LEFT JOIN {n} ON b.series = {n}.series AND b.date >= {n}.date")
    joined = f"j AS (SELECT {', '.join(cols)} FROM base b{joins})"
    lags = ", ".join(f"lag(c, {n}) OVER w AS price_lag_{n}" for n in (1, 3, 7, 14, 30)) + ", " + ", ".join(f"avg(c) OVER {frame(n)} AS price_ma_{n}" for n in (7, 14, 30)) + ", " + ", ".join(f"c / lag(c, {n}) OVER w - 1 AS return_{n}d" for n in (1, 3, 7, 14))
    d1 = f"""d1 AS (SELECT *, c AS price_close, {lags}, CASE WHEN count(c) OVER {frame(30, 1)} = 30 THEN avg(c) OVER {frame(30, 1)} END AS market_avg_price_30d, list(cftc_noncomm_net) OVER {frame(252)} AS l, count(*) OVER {frame(252)} AS nf,
  coalesce(CASE WHEN count(c) OVER {frame(200)} = 200 THEN c > avg(c) OVER {frame(200)} END, false)::INTEGER AS price_above_200d_ma, sunflower_close / lag(sunflower_close, 30) OVER w - 1 AS sunflower_return_30d,
  {', '.join(f'lead(c, {n}) OVER w AS target_price_t{n}' for n in (1, 7, 28))}, weekofyear(date)::INTEGER AS week_of_year FROM j WINDOW w AS {PART}))"""
    d2 = f"""d2 AS (SELECT *, {', '.join(f'c / price_ma_{n} AS price_to_ma{n}_ratio' for n in (7, 14, 30))}, {', '.join(f'CASE WHEN count(return_1d) OVER {frame(n)} >= {m} THEN stddev_samp(return_1d) OVER {frame(n)} END AS volatility_{n}d' for n, m in ((5, 2), (10, 3), (20, 5)))},
  c / market_avg_price_30d - 1 AS price_vs_market_avg, c - palm_close AS palm_soyoil_spread, palm_close AS palm_oil_close, palm_close AS palm_usd_per_ton, c - spot_price_usd AS basis, c * 22.0462::DOUBLE AS soyoil_usd_per_ton, wti_close * 6.2898::DOUBLE AS wti_usd_per_ton,
  zs_close * (36.744::DOUBLE / 100.0::DOUBLE) AS soybean_usd_per_ton, zm_close * 1.10231::DOUBLE AS soymeal_usd_per_ton, canola_close * (0.7285::DOUBLE * 1.10231::DOUBLE) AS canola_usd_per_ton, return_7d - return_14d AS momentum_accel_7d,
  CASE WHEN cftc_noncomm_net IS NOT NULL AND len(list_filter(l, lambda x: x IS NOT NULL)) >= 30 THEN (len(list_filter(l, lambda x: x < cftc_noncomm_net)) + (len(list_filter(l, lambda x: x = cftc_noncomm_net)) + 1) / 2) / nf END AS cftc_percentile_52w,
  return_7d - avg(return_7d) OVER (PARTITION BY series, week_of_year ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seasonal_adj_return_7d, {', '.join(f'target_price_t{n} / c - 1 AS target_return_t{n}' for n in (7, 28))},
  {', '.join(f'(target_price_t{n} / c - 1 > {t})::INTEGER AS target_{k}_t{n}' for n, h in ((7, 0.02), (28, 0.03)) for k, t in (('updown', 0), ('thresh', h)))},
  month(date)::INTEGER AS month, quarter(date)::INTEGER AS quarter, (month(date) IN (9,10,11))::INTEGER AS is_planting_season, (month(date) IN (1,2))::INTEGER AS is_flowering_season, (month(date) IN (3,4,5))::INTEGER AS is_harvest_season,
  (CASE WHEN date <= make_date(year(date), 3, 1) THEN make_date(year(date), 3, 1) ELSE make_date(year(date) + 1, 3, 1) END - date)::INTEGER AS days_to_next_harvest, (isodow(date) = 5)::INTEGER AS is_cftc_release_day, ((12 - isodow(date)) % 7)::INTEGER AS days_to_cftc, 'v1' AS feature_version FROM d1)"""
    events = f"""{TUESDAYS}, wd AS (SELECT x, sum((isodow(x) <= 5)::INTEGER) OVER (ORDER BY x) AS n FROM days), e AS (SELECT date, (SELECT min(x) FROM t WHERE x >= date) AS nx, (SELECT max(x) FROM t WHERE x <= date) AS pv FROM (SELECT DISTINCT date FROM px)),
 ev AS (SELECT e.date AS day, (EXISTS (SELECT 1 FROM t WHERE date_trunc('week', x) = date_trunc('week', e.date)))::INTEGER AS is_wasde_week, (nx = e.date)::INTEGER AS wasde_release_day, least(30, p.n - q.n)::INTEGER AS days_to_wasde, least(30, q.n - s.n)::INTEGER AS days_since_wasde
  FROM e JOIN wd p ON p.x = nx JOIN wd q ON q.x = e.date JOIN wd s ON s.x = pv)"""
    px0 = PX.replace("px AS (", "px0 AS MATERIALIZED (", 1)
    return "WITH " + ", ".join([px0, *blocks, base, joined, d1, d2, events, f"m AS (SELECT * FROM d2 JOIN ev ON d2.date = ev.day{f' WHERE date <= DATE {chr(39)}{AS_OF}{chr(39)}' if exact else ''})"])


MASTER_COLUMNS = "series, date, " + ", ".join([*[f"round({c}, {n}) AS {c}" for c, n in MASTER_DIGITS.items()], *FLAGS])


def market(px: DataFrame, name: str) -> DataFrame:
    factor, gap = MARKETS[name]
    return px.where(F.day("date") % gap != 0).select("series", "date", (F.col("price_close") * factor).alias(f"{name}_close"))


def full_master(spark: SparkSession, d: str, exact: bool = False) -> DataFrame:
    """The prices are written once: some fifteen blocks read them, not the line items."""
    px = chunks.kept(price(spark, d))
    exchange = features.market_block(cal.calendar_expand(market(px, "usd_brl"), ["series"], "date", ["usd_brl_close"]), "usd_brl_close", "usd_brl")
    palm = features.market_block(market(px, "palm"), "palm_close", "palm", vol=None)
    crush = features.crush_block(*(market(px, n) for n in ("zl", "zm", "zs"))).drop("zl_close")
    months = px.groupBy("series", F.date_add(F.trunc("date", "MM"), 9).alias("date")).agg(F.sum("price_close").alias("t"), F.count(F.lit(1)).cast("double").alias("n"), F.max("price_close").alias("hi"), F.min("price_close").alias("lo"))
    positions = features.positioning_block(months.select(*features.KEYS, F.col("t").alias("cftc_noncomm_net"), F.col("t").alias("long"), F.col("n").alias("short")))
    supply = months.select(*features.KEYS, (F.col("n") / F.col("hi")).alias("wasde_soyoil_stock_to_use"), (F.col("hi") / F.col("lo")).alias("wasde_soy_prod_brazil"), (F.col("lo") / F.col("n")).alias("wasde_world_production"))
    biodiesel = features.level_block(months.select(*features.KEYS, F.col("n").alias("biodiesel_production_kbbl")), "biodiesel_production_kbbl", (4,), unit="w").withColumnRenamed("biodiesel_production_kbbl_chg_4w", "biodiesel_chg_4w")
    rate = features.level_block(months.select(*features.KEYS, F.col("hi").alias("fed_rate")), "fed_rate", (), (1, 3))
    releases = [features.market_block(market(px, "dxy"), "dxy_close", "dxy"), market(px, "sunflower"), features.volatility_index_block(market(px, "vix")), positions, supply, biodiesel, rate]
    same_day = [exchange, features.market_block(market(px, "wti"), "wti_close", "wti"), crush]
    if exact:
        return features.build_master(px, same_day, releases, as_of=AS_OF, mode="exact", labels_before_cut=True, after=("sunflower_close",))
    releases += [features.market_block(market(px, "canola"), "canola_close", "canola", vol=None), features.spot_block(px.select(*features.KEYS, (F.col("price_close") * 1.1).alias("spot_price_usd")))]
    return features.build_master(px, [*same_day, palm], releases, as_of=AS_OF, after=("sunflower_close",))


def shown(df: DataFrame) -> DataFrame:
    """All columns of the master; those of absent blocks are null."""
    return df.select(*features.KEYS, *[(r(c, n) if c in df.columns else F.lit(None).cast("double")).alias(c) for c, n in MASTER_DIGITS.items()], *FLAGS)


@query("b19_master_full", f"{master_sql(False)} SELECT {MASTER_COLUMNS} FROM m")
def b19_full(spark, d):
    """Every block, aligned as of its release; the as-of cut hides later prices from the labels."""
    return shown(full_master(spark, d))


@query("b19_master_exact", f"{master_sql(True)} SELECT {MASTER_COLUMNS} FROM m")
def b19_exact(spark, d):
    """Releases on trading days only, labels before the as-of cut, null columns for the blocks that are absent."""
    return shown(full_master(spark, d, exact=True))


SETS = {v: [c for c in versions.VERSIONS[v] if not c.startswith("target_")] for v in versions.VERSIONS if versions.VERSIONS[v]}


@query("p3_all_sets", f"{master_sql(False)}, x AS (" + " UNION ALL ".join(f"SELECT '{v}' AS version, {len(c)}::INTEGER AS n_features, count(*) AS complete, sum(target_updown_t28)::BIGINT AS up FROM m WHERE target_updown_t28 IS NOT NULL AND " + " AND ".join(f"{x} IS NOT NULL" for x in c) for v, c in SETS.items()) + ") SELECT * FROM x")
def p3_sets(spark, d):
    """Complete training rows of every named set. Which sets a row of the master is complete in is written once, all are counted in one pass."""
    master, label = full_master(spark, d), "target_updown_t28"
    sets = {v: [c for c in features.select_features(master, versions.columns(v), label).columns if c not in (*features.KEYS, label)] for v in SETS}
    return features.count_sets(chunks.kept(features.complete_sets(master, sets, label)), sets, label)


# ---- sequences, profiles, parsing

W17_SQL = f"""WITH {PX}, l AS (SELECT series, date, c, count(*) OVER {frame(112)} AS past, count(*) OVER {PART} ROWS BETWEEN 1 FOLLOWING AND 28 FOLLOWING) AS future, first_value(c) OVER {frame(112)} AS a, sum(c) OVER {frame(112)} AS s,
 last_value(c) OVER {PART} ROWS BETWEEN 1 FOLLOWING AND 28 FOLLOWING) AS b, sum(c) OVER {PART} ROWS BETWEEN 1 FOLLOWING AND 28 FOLLOWING) AS f FROM px)
 SELECT series, date, past::INTEGER AS past, round(a, 4) AS first_past, round(c, 4) AS last_past, round(s, 2) AS sum_past, round(b, 4) AS last_future, round(f, 2) AS sum_future FROM l WHERE past >= 56 AND future = 28"""


@query("w17_stored_sequences", W17_SQL)
def w17_stored(spark, d):
    """The samples of w17_sequences, read out of chunks in which each row is stored about once."""
    store = chunks.kept(sequences.sequence_store(price(spark, d), ["price_close"], ["series"]))
    x = sequences.read_samples(store, ["series"])

    def total(c: str):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v["price_close"])

    return x.select("series", "date", F.size("encoder").alias("past"), r(F.col("encoder")[0]["price_close"], 4).alias("first_past"), r(F.element_at("encoder", -1)["price_close"], 4).alias("last_past"), r(total("encoder"), 2).alias("sum_past"), r(F.element_at("decoder", -1)["price_close"], 4).alias("last_future"), r(total("decoder"), 2).alias("sum_future"))


@query("a12_partial_40", f"""WITH RECURSIVE {PX}, v AS (SELECT series, date, c - avg(c) OVER (PARTITION BY series) AS x FROM px), l AS (SELECT series, x, {', '.join(f'lag(x, {k}) OVER w AS x{k}' for k in LAGS)} FROM v WINDOW w AS {PART})),
 g AS (SELECT series, [{', '.join(f'sum(x * x{k}) / sum(x * x)' for k in LAGS)}] AS a FROM l GROUP BY 1),
 p AS (SELECT series, a, 1 AS lag, a[1] AS t, [a[1]] AS phi FROM g UNION ALL SELECT series, a, lag + 1, t, list_concat(list_transform(range(1, lag + 1), lambda i: phi[i] - t * phi[lag + 1 - i]), [t])
  FROM (SELECT series, a, lag, phi, (a[lag + 1] - list_sum(list_transform(range(1, lag + 1), lambda i: phi[i] * a[lag + 1 - i]))) / (1 - list_sum(list_transform(range(1, lag + 1), lambda i: phi[i] * a[i]))) AS t FROM p WHERE lag < {len(LAGS)}))
 SELECT series, lag::INTEGER AS lag, round(t, 6) AS pacf FROM p""")
def a12_partial(spark, d):
    """Partial autocorrelations of all 40 lags."""
    acf = profile.autocorrelation(price(spark, d), "price_close", "series", len(LAGS))
    return profile.partial_autocorrelation(acf, "series").withColumn("pacf", r("pacf"))


@query("a13_unit_root_lagged", f"""WITH {PX}, l0 AS (SELECT series, date, c - lag(c) OVER w AS y, lag(c) OVER w AS x FROM px WINDOW w AS {PART})), l AS (SELECT *, lag(y) OVER {PART}) AS z FROM l0),
 g AS (SELECT series, count(*) AS n, regr_sxx(y, x) AS xx, regr_sxx(y, z) AS zz, regr_syy(y, x) AS yy, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy, regr_sxy(x, z) AS xz FROM l WHERE y IS NOT NULL AND z IS NOT NULL GROUP BY 1),
 q AS (SELECT series, n, xx - xz * xz / zz AS qxx, xy - xz * zy / zz AS qxy, yy - zy * zy / zz AS qyy FROM g), s AS (SELECT series, n, qxy / qxx / sqrt((qyy - qxy * qxy / qxx) / (n - 3) / qxx) AS t FROM q)
 SELECT series, n::INTEGER AS n, round(t, 4) AS statistic, t < -2.86 AS stationary FROM s""")
def a13_lagged(spark, d):
    """The test at its default of one lagged difference; the SQL regresses what the lag leaves."""
    return profile.unit_root(price(spark, d), "price_close", "series").withColumn("statistic", r("statistic", 4))


@query("f2_f3_units", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN round(round(o_totalprice / 1000, 1) * 1000, 1) WHEN 1 THEN round(round(o_totalprice / 1000000, 3) * 1000000, 1) ELSE round(round(o_totalprice / 1000000, 4) * 1000000000, 1) END AS volume,
 CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE o_orderdate::DATE END AS day_first FROM orders""")
def f2_f3(spark, d):
    """Volumes in K, M and B; dates with the day first, of which those that also fit month first are read so."""
    x, k = F.col("o_totalprice"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.format_string("%.1f", F.round(x / 1000, 1)), F.lit("K"))).when(k == 1, F.concat(F.format_string("%.3f", F.round(x / 1e6, 3)), F.lit(" m"))).otherwise(F.concat(F.format_string("%.4f", F.round(x / 1e6, 4)), F.lit("B")))
    o = table(spark, d, "orders")
    return o.select("o_orderkey", r(clean.parse_volume(text), 1).alias("volume"), clean.parse_date_two_pass(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day_first"))


@query("q3_absent_file", "SELECT o_orderdate::DATE AS date, o_orderkey::DOUBLE AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) = 1")
def q3(spark, d):
    """A present file and an absent one, which gives no rows."""
    first = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.min("o_orderkey").alias("v"))
    path, schema = csv(first.select(F.date_format("date", "yyyy-MM-dd"), "v"), header=False), "date date, v double"
    out = spark.createDataFrame([], schema)
    for p in (path, f"{path}/absent.csv"):
        out = out.unionByName(readers.read_or_empty(lambda x: readers.read_two_column_csv(spark, x, "v"), p, schema, spark))
    profile.require_columns(out, ["date", "v"])
    return out


@query("s11_mixed_records", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE s_acctbal END AS amount, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 1 THEN 2 ELSE 0 END AS n_tags FROM supplier""")
def s11_mixed(spark, d):
    """Records of three shapes in one file: flat numbers, nested with numbers as text and tags, text that is no number."""
    k, name, amount = F.col("s_suppkey"), F.col("s_name"), F.col("s_acctbal")
    flat = F.to_json(F.struct(k.alias("id"), amount.alias("amount")))
    nested = F.to_json(F.struct(k.cast("string").alias("id"), F.struct(amount.cast("string").alias("value"), F.lit("usd").alias("unit")).alias("amount"), F.struct(name.alias("name")).alias("party"), F.array(F.lit("a"), F.lit("b")).alias("tags")))
    bad = F.to_json(F.struct(k.alias("id"), F.lit("n/a").alias("amount"), name.alias("name")))
    rows = table(spark, d, "supplier").select((k % 4).alias("g"), F.when(k % 3 == 0, flat).when(k % 3 == 1, nested).otherwise(bad).alias("x"))
    lists = rows.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("x"), ","), F.lit("]")).alias("x"))
    path = folder(spark)
    lists.select(F.when(F.col("g") == 0, F.col("x")).otherwise(F.concat(F.lit('{"n": 1, "ReCords": '), "x", F.lit("}"))).alias("value")).repartition(4, "value").write.option("maxRecordsPerFile", 1).text(path)
    records = readers.read_records(spark, path)
    out = readers.record_fields(records, {"id": ("bigint", "$.id"), "amount": ("double", "$.amount", "$.amount.value"), "name": ("string", "$.name", "$.party.name"), "tags": ("array<string>", "$.tags")})
    return out.select("id", "amount", "name", F.coalesce(F.size("tags"), F.lit(0)).alias("n_tags")).withColumn("n_tags", F.greatest("n_tags", F.lit(0)))


# ---- models

#: Weights of a fixed linear score, which SQL can follow.
WEIGHTS = {"": 0.28, "return_1d": 2.0, "return_3d": -1.5, "return_7d": 3.0, "return_14d": -2.5, "volatility_5d": 4.0, "price_to_ma7_ratio": -0.3}
TRAIN_SQL = f"""{PX}, g AS (SELECT series, date, c, {', '.join(f'c / lag(c, {n}) OVER w - 1 AS return_{n}d' for n in (1, 3, 7, 14))}, c / avg(c) OVER {frame(7)} AS price_to_ma7_ratio, lead(c, 7) OVER w AS f FROM px WINDOW w AS {PART})),
 tr AS (SELECT * FROM (SELECT *, CASE WHEN count(return_1d) OVER {frame(5)} >= 2 THEN stddev_samp(return_1d) OVER {frame(5)} END AS volatility_5d FROM g) WHERE return_14d IS NOT NULL AND f IS NOT NULL AND volatility_5d IS NOT NULL)"""


def score_sql(value) -> str:
    return "1 / (1 + exp(-(" + " + ".join([f"{WEIGHTS['']}::DOUBLE", *[f"{value(f)} * {w}::DOUBLE" for f, w in WEIGHTS.items() if f]]) + ")))"


LATE_SQL = f"{TRAIN_SQL}, late AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) = 1)"
PAIRS = [(a, b, x, y) for i, a in enumerate(MODEL) for b in MODEL[i + 1 :] for x in (1.1, 0.9) for y in (1.1, 0.9)]


def scored(df: DataFrame) -> DataFrame:
    return learn.weighted_probability(df, WEIGHTS)


def late_rows(spark, d):
    return align.latest_asof(training(spark, d), "series")


@query("m9_what_if_weights", f"WITH {LATE_SQL}, v AS (" + " UNION ALL ".join(f"SELECT series, '{f}' AS feature, {x}::DOUBLE AS factor, {score_sql(lambda c: c)} AS base, {score_sql(lambda c: f'({c} * {x}::DOUBLE)' if c == f else c)} AS new FROM late" for f in MODEL for x in (1.1, 0.9)) + ") SELECT series, feature, factor, round(base, 8) AS base, round(new, 8) AS new, round(new - base, 8) AS change, (new >= 0.5) <> (base >= 0.5) AS flipped FROM v")
def m9_weights(spark, d):
    """Each feature scaled alone, under a score that SQL can follow."""
    out = learn.what_if(late_rows(spark, d), MODEL, scored, ["series"])
    return out.select("series", "feature", "factor", *[r(c, 8).alias(c) for c in ("base", "new", "change")], "flipped")


@query("m9_pairs_weights", f"WITH {TRAIN_SQL}, v AS (" + " UNION ALL ".join(f"SELECT series, date, {i} AS n, '{a}' AS a, '{b}' AS b, {x}::DOUBLE AS fa, {y}::DOUBLE AS fb, {score_sql(lambda c: c)} AS base, {score_sql(lambda c: f'({c} * {x}::DOUBLE)' if c == a else f'({c} * {y}::DOUBLE)' if c == b else c)} AS new FROM tr" for i, (a, b, x, y) in enumerate(PAIRS)) + "), k AS (SELECT *, row_number() OVER (PARTITION BY series, date ORDER BY n)::INTEGER AS rank FROM v WHERE (new >= 0.5) <> (base >= 0.5)) SELECT series, date, rank, a, b, fa, fb, round(base, 8) AS base, round(new, 8) AS new FROM k WHERE rank <= 5")
def m9_pairs(spark, d):
    """For each training row the first five pairs of features whose joint change flips the direction."""
    out = learn.what_if_pairs(training(spark, d), MODEL, scored, ["series", "date"])
    return out.select("series", "date", "rank", "a", "b", "fa", "fb", r("base", 8).alias("base"), r("new", 8).alias("new"))


@query("m10_contributions_weights", f"WITH {TRAIN_SQL}, a AS (SELECT {', '.join(f'avg({f}) AS m_{f}' for f in MODEL)} FROM tr), c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(abs({score_sql(lambda c: c)} - {score_sql(lambda c: f'm_{c}' if c == f else c)})) AS importance FROM tr, a" for f in MODEL) + ") SELECT feature, round(importance, 8) AS importance, row_number() OVER (ORDER BY importance DESC, feature)::INTEGER AS rank FROM c")
def m10_weights(spark, d):
    """Mean absolute contributions over all training rows."""
    x = training(spark, d)
    out = learn.importance(learn.contributions(x, MODEL, scored, ["series", "date"]))
    return out.select("feature", r("importance", 8).alias("importance"), "rank")


@query("m5_saved_ensemble", f"WITH {TRAIN_SQL} SELECT series, date, true AS alike, true AS exported FROM tr WHERE date >= DATE '2000-01-01'")
def m5(spark, d):
    """An ensemble is saved and loaded: each row's probability stays, and exported weights give that of its logistic part."""
    train, test = learn.time_split(chunks.kept(training(spark, d)), Date(2000, 1, 1))
    models, path = learn.fit_all(learn.ensemble(MODEL, "target_updown_t7", {"maxIter": 10}), train), folder(spark)
    learn.save_ensemble(models, MODEL, path)
    loaded, order = learn.load_ensemble(spark, path, MODEL)
    x = learn.probability(models, test, order, "fitted")
    x = learn.probability(loaded, x, order, "loaded")
    x = learn.probability(loaded[2:], x, order, "logistic")
    x = learn.weighted_probability(x, learn.exported_logistic(loaded[2], order), "by_weights")
    near = F.abs(F.col("logistic") - F.col("by_weights")) < 1e-9
    return x.select("series", "date", (F.abs(F.col("fitted") - F.col("loaded")) < 1e-12).alias("alike"), near.alias("exported"))


RANKS_SQL = ", ".join(f"{n} AS (SELECT p_brand AS feature, {e} AS importance, row_number() OVER (ORDER BY {e} DESC, p_brand)::INTEGER AS rank FROM part GROUP BY 1 QUALIFY rank <= 15)" for n, e in (("t1", "sum(p_retailprice::DECIMAL(18,2))::DOUBLE"), ("t2", "count(*)::DOUBLE * 1000"), ("t3", "max(p_size)::DOUBLE * 1000 + count(*)")))
NEW = ["Brand#1", "Brand#2", "Brand#3", "no such brand"]


@query("m11_verdicts", f"""WITH {RANKS_SQL}, f AS (SELECT min(feature) AS f FROM t1 WHERE rank = 1), s AS (SELECT (SELECT max(importance) FROM t1 WHERE feature = 'Brand#1') AS a, (SELECT max(importance) FROM t2 WHERE feature = 'Brand#2') AS b)
 SELECT 'stronger' AS question, 'Brand#2' AS subject, CASE WHEN b > a THEN 'confirmed' ELSE 'not confirmed' END AS verdict FROM s
 UNION ALL SELECT 'new', n, CASE WHEN (SELECT min(rank) FROM t2 WHERE feature = n) <= 10 THEN 'keep' ELSE 'review' END FROM (SELECT unnest({NEW!r}) AS n)
 UNION ALL SELECT 'horizons', (SELECT count(*) FROM t2 a JOIN t3 b USING (feature) WHERE a.rank <= 5 AND b.rank <= 5)::VARCHAR, CASE WHEN (SELECT list(feature ORDER BY rank) FROM t2 WHERE rank <= 5) = (SELECT list(feature ORDER BY rank) FROM t3 WHERE rank <= 5) THEN 'equal' ELSE 'differ' END""")
def m11(spark, d):
    """Verdicts on three rankings; brands stand in for features."""
    p = table(spark, d, "part")

    def ranking(e) -> DataFrame:
        return learn.importance(p.groupBy(F.col("p_brand").alias("feature"), F.lit(1).alias("one")).agg(e.alias("contribution")), 15)

    n = F.count(F.lit(1)).cast("double")
    rankings = {"t1": ranking(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double")), "t2": ranking(n * 1000), "t3": ranking(F.max("p_size").cast("double") * 1000 + n)}
    return learn.version_verdicts(rankings, (("t1", "Brand#1"), ("t2", "Brand#2")), ("t2", NEW), ("t2", "t3"))
