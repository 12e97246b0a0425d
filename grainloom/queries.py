"""Registered queries of the library's operators over the given tables, each with the SQL that checks it.

Stand-ins: every brand's daily unit price, per ton, is a commodity's closing price; daily average order totals are an exchange
rate with gaps; monthly orders are releases on the 10th; document texts are news titles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar as cal
from .functions import clean
from .operators import align, chunks, profile, quantiles, rolling, sliding
from .plans import bands, decide, features, learn, news
from .sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---- stand-ins

PX = """px AS (SELECT p_brand AS series, l_shipdate::DATE AS date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE * 1.10231::DOUBLE AS c
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
FX = "fx AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) * 1.10231::DOUBLE AS x FROM orders GROUP BY 1)"
MONTHLY = """rel AS (SELECT date_trunc('month', o_orderdate)::DATE + 9 AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(*)::DOUBLE AS orders FROM orders GROUP BY 1)"""
PRED = f"""{PX}, i AS (SELECT series, date, c, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS time_idx, lag(c) OVER w AS p50,
 stddev_samp(c) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS s FROM px WINDOW w AS (PARTITION BY series ORDER BY date)),
pred AS (SELECT series, date, time_idx, p50, p50 - s AS p10, p50 + s AS p90, c AS actual FROM i WHERE p50 IS NOT NULL AND s IS NOT NULL)"""


def price(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    money = [F.sum(F.col(c).cast("decimal(18,2)")).cast("double") for c in ("l_extendedprice", "l_quantity")]
    return rows.groupBy(F.col("p_brand").alias("series"), F.col("l_shipdate").cast("date").alias("date")).agg(clean.to_usd_per_ton(money[0] / money[1], "soymeal").alias("price_close"))


def exchange(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return table(spark, d, "orders").groupBy(F.lit("fx").alias("series"), F.col("o_orderdate").cast("date").alias("date")).agg(clean.to_usd_per_ton(total / F.count(F.lit(1)), "soymeal").alias("usd_brl_close"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    when = F.date_add(F.trunc("o_orderdate", "MM"), 9)
    return table(spark, d, "orders").groupBy(when.alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("orders"))


def per_series(release: DataFrame, base: DataFrame) -> DataFrame:
    """A release table repeated for each series of a backbone; both factors are small."""
    return base.select("series").distinct().join(F.broadcast(release))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    w = rolling.ordered("series")
    c = F.col("price_close")
    rows = price(spark, d).withColumns({"time_idx": (F.row_number().over(w) - 1).cast("long"), "m": F.lag(c).over(w), "s": F.stddev_samp(c).over(w.rowsBetween(-20, -1))})
    rows = rows.where("m IS NOT NULL AND s IS NOT NULL")
    return rows.select("series", "date", "time_idx", F.col("m").alias("p50"), (F.col("m") - F.col("s")).alias("p10"), (F.col("m") + F.col("s")).alias("p90"), c.alias("actual"))


# ---- scans and keyed writes


@query("s1_read_series", "SELECT l_shipdate::DATE AS date, l_extendedprice AS value FROM lineitem WHERE l_returnflag = 'A'")
def s1(spark, d):
    rows = table(spark, d, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return readers.read_series(rows, "l_extendedprice", "A", "l_returnflag", "day").toDF("date", "value")


@query("s2_series_fallback", "SELECT o_orderdate::DATE AS date, o_totalprice AS value FROM orders")
def s2(spark, d):
    rows = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return readers.read_series(rows, "o_totalprice", "no such status", "o_orderstatus", "day", fallback=True).toDF("date", "value")


@query("s14_aligned_closes", f"WITH {PX} SELECT date, CASE series WHEN 'Brand#1' THEN 'soyoil' ELSE 'wti' END AS commodity, round(c * CASE series WHEN 'Brand#1' THEN 22.0462 ELSE 6.2898 END, 4) AS price FROM px WHERE series IN ('Brand#1', 'Brand#2')")
def s14(spark, d):
    px = price(spark, d).select("date", "series", F.col("price_close").alias("close"))
    out = features.aligned_closes({"soyoil": px.where("series = 'Brand#1'"), "wti": px.where("series = 'Brand#2'")})
    return out.select("date", "commodity", r("price_close", 4).alias("price"))


@query("k1_first_wins", "WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) SELECT * FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def k1(spark, d):
    """Urgent orders are the landed rows, all others the new ones."""
    o, cols = table(spark, d, "orders"), ("o_custkey", "o_orderkey", "o_totalprice")
    return writers.new_rows(o.where("o_orderpriority <> '1-URGENT'").select(*cols), o.where("o_orderpriority = '1-URGENT'").select(*cols), ["o_custkey"], "o_orderkey")


@query("k3_keep_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def k3(spark, d):
    return writers.dedupe_keep_last(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("k7_record_actual", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Buy' END AS actual_action, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS quantity_actual_ton FROM orders")
def k7(spark, d):
    o = table(spark, d, "orders")
    log = o.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("actual_action"), F.lit(None).cast("double").alias("quantity_actual_ton"), F.lit(None).cast("string").alias("reason_override"))
    done = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("Buy").alias("actual_action"), F.col("o_totalprice").alias("quantity_actual_ton"), F.lit(None).cast("string").alias("reason_override"))
    return writers.with_actuals(log, done).drop("reason_override")


@query("k8_rekey_supply", "SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'legacy' ELSE o_orderpriority END AS marketing_year, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def k8(spark, d):
    year = F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")))
    return writers.rekey_supply(table(spark, d, "orders").select("o_custkey", year.alias("marketing_year"), "o_orderkey"), release="o_custkey", seq="o_orderkey")


# ---- cleaning


@query("f1_f3_parse", """SELECT o_orderkey, round(o_totalprice, 2) AS price, round(round(o_totalprice / 1000, 1) * 1000, 2) AS volume, o_orderdate::DATE AS month_first,
 date_trunc('month', o_orderdate)::DATE AS month_code, NULL::DOUBLE AS missing FROM orders""")
def f1(spark, d):
    o = table(spark, d, "orders")
    text = o.select(
        "o_orderkey", F.concat(F.lit('"'), F.format_number("o_totalprice", 2), F.lit('"')).alias("p"), F.concat(F.format_string("%.1f", F.round(F.col("o_totalprice") / 1000, 1)), F.lit("K")).alias("v"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("m"), F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("M"), F.date_format("o_orderdate", "MM")).alias("y"), F.lit("-").alias("n"),
    )
    return text.select("o_orderkey", clean.parse_price(F.col("p")).alias("price"), r(clean.parse_volume(F.col("v")), 2).alias("volume"), clean.parse_date_two_pass(F.col("m")).alias("month_first"), clean.parse_month_code(F.col("y")).alias("month_code"), clean.parse_price(F.col("n")).alias("missing"))


@query("f6_f9_keys", """SELECT o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN 'spot' WHEN o_orderpriority = '2-HIGH' THEN 'forward' ELSE 'other' END AS contract, year(o_orderdate)::DOUBLE AS year_key, count(*) AS n
 FROM orders GROUP BY ALL""")
def f6(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", " 현물 ").when(F.col("o_orderpriority") == "2-HIGH", "Futures").otherwise("swap")
    year = F.concat(F.year("o_orderdate"), F.lit("/"), F.year("o_orderdate") + 1)
    return o.groupBy("o_orderpriority", clean.normalise_contract_type(raw).alias("contract"), clean.marketing_year_key(year).alias("year_key")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_infer_release", """WITH known AS (SELECT o_orderdate::DATE AS d FROM orders WHERE day(o_orderdate) BETWEEN 5 AND 8 GROUP BY 1 HAVING 2 * count(*) FILTER (o_orderstatus = 'F') > count(*)), f AS (SELECT year(d) AS y, month(d) AS m, min(d) AS first FROM known GROUP BY 1, 2),
 k AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m FROM orders) SELECT k.y, k.m, coalesce(first, make_date(k.y, k.m, 12)) AS release_date FROM k LEFT JOIN f ON f.y = k.y AND f.m = k.m""")
def f11(spark, d):
    """A day from the 5th to the 8th of a month is a release if most of its orders are finished."""
    o = table(spark, d, "orders")
    days = o.where(F.day("o_orderdate").between(5, 8)).groupBy(F.col("o_orderdate").cast("date").alias("release_date"))
    known = days.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done")).where("2 * done > n").select("release_date")
    return clean.infer_release(o.select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct(), known, "y", "m")


@query("f13_f14_ratios", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 0.179 + l_extendedprice * 0.765 - l_tax, 6) AS spread, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity / l_discount, 6) END AS ratio FROM lineitem")
def f13(spark, d):
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", r(clean.crush_spread(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"))).alias("spread"), r(clean.ratio(F.col("l_quantity"), F.col("l_discount"))).alias("ratio"))


# ---- calendar

DAYS = "d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)"
TUESDAYS = "days AS (SELECT unnest(generate_series(DATE '1994-11-01', DATE '2002-12-31', INTERVAL 1 DAY))::DATE AS x), t AS (SELECT x FROM days WHERE isodow(x) = 2 AND day(x) BETWEEN 8 AND 14)"


@query("c1_c3_season", f"""WITH {DAYS} SELECT date, month(date)::INTEGER AS month, quarter(date)::INTEGER AS quarter, weekofyear(date)::INTEGER AS week_of_year, (month(date) IN (9,10,11))::INTEGER AS is_planting_season, (month(date) IN (1,2))::INTEGER AS is_flowering_season,
 (month(date) IN (3,4,5))::INTEGER AS is_harvest_season, (CASE WHEN date <= make_date(year(date), 3, 1) THEN make_date(year(date), 3, 1) ELSE make_date(year(date) + 1, 3, 1) END - date)::INTEGER AS days_to_next_harvest FROM d""")
def c1(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct().withColumns(cal.season_features(F.col("date")))


@query("c4_c7_events", f"""WITH {DAYS}, {TUESDAYS}, wd AS (SELECT x, sum((isodow(x) <= 5)::INTEGER) OVER (ORDER BY x) AS n FROM days),
 e AS (SELECT date, (SELECT min(x) FROM t WHERE x >= date) AS nx, (SELECT max(x) FROM t WHERE x <= date) AS pv FROM d)
 SELECT date, (EXISTS (SELECT 1 FROM t WHERE date_trunc('week', x) = date_trunc('week', date)))::INTEGER AS is_wasde_week, (nx = date)::INTEGER AS wasde_release_day, least(30, a.n - b.n)::INTEGER AS days_to_wasde,
 least(30, b.n - c.n)::INTEGER AS days_since_wasde, (isodow(date) = 5)::INTEGER AS is_cftc_release_day, ((12 - isodow(date)) % 7)::INTEGER AS days_to_cftc
 FROM e JOIN wd a ON a.x = nx JOIN wd b ON b.x = date JOIN wd c ON c.x = pv""")
def c4(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct().withColumns(cal.event_features(F.col("date")))


@query("c8_calendar_fill", f"""WITH {FX}, days AS (SELECT unnest(generate_series((SELECT min(date) FROM fx), (SELECT max(date) FROM fx), INTERVAL 1 DAY))::DATE AS date)
 SELECT date, round(last_value(x IGNORE NULLS) OVER (ORDER BY date), 4) AS usd_brl_close, (x IS NULL)::INTEGER AS is_interpolated FROM days LEFT JOIN fx USING (date)""")
def c8(spark, d):
    out = cal.calendar_expand(exchange(spark, d), ["series"], "date", ["usd_brl_close"])
    return out.select("date", r("usd_brl_close", 4).alias("usd_brl_close"), "is_interpolated")


@query("c9_month_gaps", """WITH s AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS month FROM orders), e AS (SELECT o_custkey, min(month) AS a, max(month) AS b FROM s GROUP BY 1),
 x AS (SELECT o_custkey, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS month FROM e) SELECT * FROM x ANTI JOIN s USING (o_custkey, month)""")
def c9(spark, d):
    return cal.month_gaps(table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day")), ["o_custkey"], "day")


@query("c10_busdays_all", """WITH x AS (SELECT o_orderkey, l_linenumber, l_partkey, o_orderdate::DATE - DATE '1970-01-04' AS a, l_shipdate::DATE - DATE '1970-01-04' AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT o_orderkey, l_linenumber, l_partkey, greatest(0, 5 * (b // 7) + least(b % 7, 5) - 5 * (a // 7) - least(a % 7, 5))::INTEGER AS busdays FROM x""")
def c10_all(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select("o_orderkey", "l_linenumber", "l_partkey", cal.busdays_between(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("busdays"))


query("c10_busdays", ORACLES["c10_busdays_all"])(c10_all)


# ---- windows


def windowed(spark: SparkSession, d: str, cols: dict[str, Column], n: int = 6) -> DataFrame:
    return price(spark, d).select("series", "date", *[r(c, n).alias(k) for k, c in cols.items()])


PART = "(PARTITION BY series ORDER BY date"


def frame(n: int, m: int = 0) -> str:
    """SQL frame of the n rows up to m rows before the current one."""
    return f"{PART} ROWS BETWEEN {n - 1 + m} PRECEDING AND {f'{m} PRECEDING' if m else 'CURRENT ROW'})"


@query("w1_w2_lag_lead", f"WITH {PX} SELECT series, date, round(lag(c, 1) OVER w, 4) AS lag_1, round(lag(c, 30) OVER w, 4) AS lag_30, round(lead(c, 7) OVER w, 4) AS lead_7 FROM px WINDOW w AS {PART})")
def w1(spark, d):
    w, c = rolling.ordered("series"), F.col("price_close")
    return windowed(spark, d, {"lag_1": rolling.lag_n(c, 1, w), "lag_30": rolling.lag_n(c, 30, w), "lead_7": rolling.lead_n(c, 7, w)}, 4)


@query("w3_w4_changes", f"WITH {PX} SELECT series, date, round(c / lag(c, 7) OVER w - 1, 6) AS pct_7, round(c - lag(c, 3) OVER w, 4) AS diff_3 FROM px WINDOW w AS {PART})")
def w3(spark, d):
    w, c = rolling.ordered("series"), F.col("price_close")
    return price(spark, d).select("series", "date", r(rolling.pct_change(c, 7, w)).alias("pct_7"), r(rolling.diff_n(c, 3, w), 4).alias("diff_3"))


@query("w5_w7_moments", f"""WITH {PX} SELECT series, date, round(avg(c) OVER {frame(7)}, 4) AS ma_7, CASE WHEN count(c) OVER {frame(30)} >= 15 THEN round(avg(c) OVER {frame(30)}, 4) END AS ma_30,
 CASE WHEN count(c) OVER {frame(14)} >= 5 THEN round(stddev_samp(c) OVER {frame(14)}, 4) END AS std_14, CASE WHEN count(c) OVER {frame(30, 1)} = 30 THEN round(avg(c) OVER {frame(30, 1)}, 4) END AS trailing_30 FROM px""")
def w5(spark, d):
    w, c = rolling.ordered("series"), F.col("price_close")
    return windowed(spark, d, {"ma_7": rolling.moving_avg(c, 7, w), "ma_30": rolling.moving_avg(c, 30, w, 15), "std_14": rolling.moving_std(c, 14, w, 5), "trailing_30": rolling.trailing_avg(c, 30, w)}, 4)


@query("w8_percentile_rank", f"""WITH {PX}, l AS (SELECT series, date, c, list(c) OVER {frame(252)} AS a FROM px)
 SELECT series, date, CASE WHEN len(a) >= 30 THEN round((len(list_filter(a, lambda x: x < c)) + (len(list_filter(a, lambda x: x = c)) + 1) / 2) / len(a), 6) END AS percentile FROM l""")
def w8(spark, d):
    out = sliding.percentile_ranks(price(spark, d), "price_close", 252, ["series"], "date", "percentile")
    return rounded(out, ["series", "date"], {"percentile": 6})


@query("w9_seasonal_mean", f"WITH {PX} SELECT series, date, round(avg(c) OVER (PARTITION BY series, weekofyear(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS seasonal FROM px")
def w9(spark, d):
    x = price(spark, d).withColumn("week", F.weekofyear("date"))
    return x.select("series", "date", r(rolling.seasonal_mean(F.col("price_close"), ["series"], "week", "date"), 4).alias("seasonal"))


@query("w11_regime", f"WITH {PX} SELECT series, date, coalesce(CASE WHEN count(c) OVER {frame(200)} = 200 THEN c > avg(c) OVER {frame(200)} END, false)::INTEGER AS above FROM px")
def w11(spark, d):
    return price(spark, d).select("series", "date", rolling.above_long_average(F.col("price_close"), 200, rolling.ordered("series")).alias("above"))


@query("w12_rolling_quantile", f"WITH {PX} SELECT series, date, CASE WHEN count(c) OVER {frame(60, 1)} = 60 THEN round(quantile_cont(c, 0.85) OVER {frame(60, 1)}, 4) END AS q FROM px")
def w12(spark, d):
    out = sliding.rolling_quantiles(price(spark, d), "price_close", 0.85, 60, ["series"], "date", "q")
    return rounded(out, ["series", "date"], {"q": 4})


#: All line items as one series, whose ranges hold so many rows.
PLACE = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
LONG, SPAN = f"(ORDER BY {', '.join(PLACE)}", 5000


def long_series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.lit("all").alias("series"), *PLACE, F.col("l_extendedprice").alias("v"))


@query("w5_moments_long", f"""SELECT l_orderkey, l_linenumber, round(avg(l_extendedprice) OVER {LONG} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS ma_30, round(stddev_samp(l_extendedprice) OVER {LONG} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 4) AS std_14,
 lag(l_extendedprice, 14) OVER {LONG}) AS lag_14, lead(l_extendedprice, 7) OVER {LONG}) AS lead_7 FROM lineitem""")
def w5_long(spark, d):
    """One series in several tasks."""
    def columns(w):
        v = F.col("v")
        return {"ma_30": r(rolling.moving_avg(v, 30, w), 4), "std_14": r(rolling.moving_std(v, 14, w), 4), "lag_14": rolling.lag_n(v, 14, w), "lead_7": rolling.lead_n(v, 7, w)}

    return chunks.windows_in_ranges(long_series(spark, d), ["series"], PLACE, columns, 30, 7, SPAN).drop("series", "v", "l_extendedprice", "l_quantity")


@query("w12_quantile_long", f"SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER {LONG} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) = 60 THEN round(quantile_cont(l_extendedprice, 0.85) OVER {LONG} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 4) END AS q FROM lineitem")
def w12_long(spark, d):
    out = sliding.rolling_quantiles_long(long_series(spark, d), "v", 0.85, 60, ["series"], PLACE, "q", rows=SPAN)
    return rounded(out, ["l_orderkey", "l_linenumber"], {"q": 4})


@query("w10_fill_long", f"SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_quantity > 49 THEN l_extendedprice END IGNORE NULLS) OVER {LONG} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM lineitem")
def w10_long(spark, d):
    """The last price of a large item, carried on over ranges that have none."""
    x = table(spark, d, "lineitem").select(F.lit("all").alias("series"), *PLACE, F.when(F.col("l_quantity") > 49, F.col("l_extendedprice")).alias("v"))
    return chunks.carry_last(x, ["v"], ["series"], PLACE, SPAN).select("l_orderkey", "l_linenumber", "v")


@query("w9_mean_long", "SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice::DECIMAL(18,2)) OVER w::DOUBLE / count(*) OVER w, 4) AS mean_before FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w9_long(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", *PLACE, F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    out = chunks.mean_before(x, "v", "mean_before", ["l_returnflag"], PLACE, SPAN)
    return rounded(out, ["l_orderkey", "l_linenumber"], {"mean_before": 4})


@query("j4_asof_long", """WITH rel AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
 SELECT l_orderkey, l_linenumber, round(total, 2) AS total FROM lineitem ASOF LEFT JOIN rel ON l_shipdate::DATE >= rel.date""")
def j4_long(spark, d):
    """One key holds all line items."""
    when = F.col("o_orderdate").cast("date")
    rel = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(when.alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    items = table(spark, d, "lineitem").select(F.lit("all").alias("key"), F.col("l_shipdate").cast("date").alias("date"), "l_orderkey", "l_linenumber")
    out = chunks.align_asof_long(rel.withColumn("key", F.lit("all")), items, ["key"], "date", SPAN)
    return rounded(out, ["l_orderkey", "l_linenumber"], {"total": 2})


@query("a6_quantiles_large", """WITH x AS (SELECT l_linestatus AS k, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'all', l_extendedprice FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem)
 SELECT k, round(quantile_cont(v, 0.05), 4) AS p10, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p90, round(quantile_cont(v, 0.8517), 4) AS p85 FROM x GROUP BY k""")
def a6_large(spark, d):
    """Groups that no task holds: at most 2,000 rows are sorted for a rank."""
    x = table(spark, d, "lineitem")
    groups = [(F.col("l_linestatus"), "l_extendedprice"), (F.lit("all"), "l_extendedprice"), (F.lit("quantity"), "l_quantity")]
    x = x.select(F.explode(F.array(*[F.struct(k.alias("k"), F.col(v).alias("v")) for k, v in groups])).alias("x")).select("x.k", "x.v")
    out = quantiles.exact_quantiles(x, "v", (0.05, 0.5, 0.95, 0.8517), ["k"], most=2000)
    return out.select("k", *[r(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90", "p85"))])


@query("w13_time_index", f"WITH {PX} SELECT series, date, (dense_rank() OVER (ORDER BY date) - 1)::INTEGER AS time_idx FROM px")
def w13(spark, d):
    return rolling.time_index(price(spark, d)).select("series", "date", F.col("time_idx").cast("int").alias("time_idx"))


@query("w14_naive_error", f"WITH {PX}, e AS (SELECT series, abs(c - lag(c) OVER {PART})) AS e FROM px) SELECT series, round(avg(e), 4) AS mae FROM e GROUP BY 1")
def w14(spark, d):
    return rolling.naive_error(price(spark, d), "price_close", "series").select("series", r("mae", 4).alias("mae"))


@query("w16_tail_nulls", f"WITH {PX}, l AS (SELECT series, date, lead(c, 7) OVER {PART}) AS y, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS n FROM px) SELECT series, count(*) FILTER (y IS NULL) AS nulls FROM l WHERE n <= 28 GROUP BY 1")
def w16(spark, d):
    x = price(spark, d).withColumn("y", rolling.lead_n(F.col("price_close"), 7, rolling.ordered("series")))
    return rolling.tail_nulls(x, "y", "series")


@query("w17_sequences", f"""WITH {PX}, l AS (SELECT series, date, count(*) OVER {frame(112)} AS past, count(*) OVER {PART} ROWS BETWEEN 1 FOLLOWING AND 28 FOLLOWING) AS future, first_value(c) OVER {frame(112)} AS a,
 last_value(c) OVER {PART} ROWS BETWEEN 1 FOLLOWING AND 28 FOLLOWING) AS b FROM px) SELECT series, date, past::INTEGER AS past, round(a, 4) AS first_past, round(b, 4) AS last_future FROM l WHERE past >= 56 AND future = 28""")
def w17(spark, d):
    x = rolling.sequence_samples(price(spark, d), ["price_close"], "series")
    return x.select("series", "date", F.size("encoder").alias("past"), r(F.col("encoder")[0]["price_close"], 4).alias("first_past"), r(F.element_at("decoder", -1)["price_close"], 4).alias("last_future"))


# ---- joins


@query("j2_inner", f"WITH {PX} SELECT a.date, round(a.c, 4) AS a, round(b.c, 4) AS b, round(x.c, 4) AS x FROM px a JOIN px b ON a.date = b.date AND b.series = 'Brand#2' JOIN px x ON a.date = x.date AND x.series = 'Brand#3' WHERE a.series = 'Brand#1'")
def j2(spark, d):
    px = price(spark, d)
    legs = [px.where(F.col("series") == f"Brand#{i + 1}").select("date", r("price_close", 4).alias(n)) for i, n in enumerate("abx")]
    return align.inner_join(legs, ["date"])


@query("j3_exact_ffill", f"WITH {PX}, {MONTHLY} SELECT series, date, round(last_value(total IGNORE NULLS) OVER {PART}), 2) AS total FROM px LEFT JOIN rel USING (date)")
def j3(spark, d):
    px = price(spark, d)
    out = align.align_exact_ffill(per_series(monthly(spark, d), px).drop("orders"), px.select("series", "date"), ["series"])
    return out.select("series", "date", r("total", 2).alias("total"))


@query("j4_asof", f"WITH {PX}, {MONTHLY} SELECT series, px.date, round(total, 2) AS total, orders FROM px ASOF LEFT JOIN rel ON px.date >= rel.date")
def j4(spark, d):
    px = price(spark, d)
    out = align.align_asof(per_series(monthly(spark, d), px), px.select("series", "date"), ["series"])
    return out.select("series", "date", r("total", 2).alias("total"), "orders")


@query("j5_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j5(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return align.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"]).select("c_custkey", "n_name")


@query("j6_value_ahead", f"WITH {PX}, i AS (SELECT *, dense_rank() OVER (ORDER BY date) - 1 AS k FROM px) SELECT a.series, a.date, round(b.c, 4) AS later FROM i a LEFT JOIN i b ON a.series = b.series AND b.k = a.k + 7")
def j6(spark, d):
    x = align.value_ahead(rolling.time_index(price(spark, d)), "price_close", ["series"], "time_idx", 7, "later")
    return x.select("series", "date", r("later", 4).alias("later"))


@query("j8_merge_metrics", """SELECT l_shipdate::DATE AS day, max(q) AS returned, max(n) AS open FROM (
 SELECT l_shipdate, sum(l_quantity) AS q, NULL AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT l_shipdate, NULL, sum(l_quantity) FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) GROUP BY 1""")
def j8(spark, d):
    x = table(spark, d, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    a = x.where("l_returnflag = 'R'").groupBy("day").agg(F.sum("l_quantity").alias("returned"))
    b = x.where("l_linestatus = 'O'").groupBy("day").agg(F.sum("l_quantity").alias("open"))
    return align.merge_metrics({"returned": a, "open": b}, ["day"])


@query("j9_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j9(spark, d):
    return writers.anti_join(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("j11_latest_asof", f"WITH {PX} SELECT series, max(date) AS date, round(arg_max(c, date), 4) AS price_close FROM px WHERE date <= DATE '2000-06-30' GROUP BY 1")
def j11(spark, d):
    return align.latest_asof(price(spark, d), "series", F.lit("2000-06-30").cast("date")).select("series", "date", r("price_close", 4).alias("price_close"))


# ---- aggregates and profiles

SUPPLY = "SELECT year(l_shipdate)::INTEGER AS y, month(l_shipdate)::INTEGER AS m, l_returnflag, l_linestatus, l_quantity FROM lineitem"


@query("a1_conditional_sums", f"""WITH s AS ({SUPPLY}), g AS (SELECT y, m, sum(l_quantity) FILTER (l_returnflag = 'R') AS production, sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS ending, sum(l_quantity) FILTER (l_returnflag = 'A') AS domestic
 FROM s GROUP BY 1, 2) SELECT y, m, production, ending, domestic, round(coalesce(ending, 0) / nullif(domestic, 0), 6) AS stock_to_use FROM g WHERE coalesce(production, ending, domestic) IS NOT NULL""")
def a1(spark, d):
    x = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), "l_returnflag", "l_linestatus", "l_quantity")
    flag = F.col("l_returnflag")
    sums = profile.conditional_sums(x, ["y", "m"], "l_quantity", {"production": flag == "R", "ending": (flag == "N") & (F.col("l_linestatus") == "O"), "domestic": flag == "A"})
    return profile.stock_to_use(sums, ["y", "m"]).withColumn("stock_to_use", r("stock_to_use"))


@query("a2_arg_max", "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) = 1")
def a2(spark, d):
    return profile.arg_max(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], F.desc("o_orderpriority"), F.asc("o_orderkey"))


@query("a3_last_value", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS filled, arg_max(o_totalprice, o_orderkey) FILTER (o_orderpriority LIKE '%HIGH%') AS high FROM orders GROUP BY 1")
def a3(spark, d):
    return profile.last_value(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", {"filled": (F.col("o_orderstatus") == "F", "o_totalprice"), "high": (F.col("o_orderpriority").contains("HIGH"), "o_totalprice")})


@query("a7_summary", "SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal::DECIMAL(18,2)), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS low, max(c_acctbal) AS high, round(avg((c_acctbal < 0)::INTEGER), 6) AS negative_share FROM customer GROUP BY 1")
def a7(spark, d):
    return profile.summary(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]).withColumns({"mean": r("mean", 4), "std": r("std", 4), "negative_share": r("negative_share")})


@query("a8_null_rates", f"""WITH {PX}, l AS (SELECT lag(c, 30) OVER w AS lag_30, lag(c, 7) OVER w AS lag_7, c FROM px WINDOW w AS {PART}))
 SELECT 'lag_30' AS name, round(avg((lag_30 IS NULL)::INTEGER), 6) AS null_rate FROM l UNION ALL SELECT 'lag_7', round(avg((lag_7 IS NULL)::INTEGER), 6) FROM l UNION ALL SELECT 'price_close', round(avg((c IS NULL)::INTEGER), 6) FROM l""")
def a8(spark, d):
    w, c = rolling.ordered("series"), F.col("price_close")
    x = price(spark, d).withColumns({"lag_30": rolling.lag_n(c, 30, w), "lag_7": rolling.lag_n(c, 7, w)})
    return profile.null_rates(x, ["lag_30", "lag_7", "price_close"]).withColumn("null_rate", r("null_rate"))


@query("a9_label_balance", f"WITH {PX}, l AS (SELECT lead(c, 7) OVER {PART}) / c - 1 AS y FROM px) SELECT CASE WHEN y IS NULL THEN NULL ELSE (y > 0)::INTEGER END AS target_updown_t7, count(*) AS n FROM l GROUP BY 1")
def a9(spark, d):
    return profile.label_balance(features.label_block(price(spark, d)), "target_updown_t7")


@query("a10_table_summary", "SELECT 'orders' AS table_name, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def a10(spark, d):
    return profile.table_summary(table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), "o_orderdate", "orders")


@query("a11_correlations", "SELECT a, b, round(corr, 6) AS corr FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem)")
def a11(spark, d):
    return profile.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("corr", r("corr"))


LAGS = range(1, 41)


@query("a12_autocorrelation", f"""WITH {PX}, v AS (SELECT series, date, c - avg(c) OVER (PARTITION BY series) AS x FROM px), l AS (SELECT series, x, {', '.join(f'lag(x, {k}) OVER w AS x{k}' for k in LAGS)} FROM v WINDOW w AS {PART})),
 g AS (SELECT series, [{', '.join(f'sum(x * x{k}) / sum(x * x)' for k in LAGS)}] AS a FROM l GROUP BY 1) SELECT series, unnest(range(1, {len(LAGS) + 1}))::INTEGER AS lag, round(unnest(a), 6) AS acf FROM g""")
def a12(spark, d):
    return profile.autocorrelation(price(spark, d), "price_close", "series", len(LAGS)).withColumn("acf", r("acf"))


@query("a12_partial_autocorrelation", f"""WITH {PX}, v AS (SELECT series, date, c - avg(c) OVER (PARTITION BY series) AS x FROM px), l AS (SELECT series, x, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM v WINDOW w AS {PART})),
 g AS (SELECT series, sum(x * x1) / sum(x * x) AS a, sum(x * x2) / sum(x * x) AS b FROM l GROUP BY 1) SELECT series, 1 AS lag, round(a, 6) AS pacf FROM g UNION ALL SELECT series, 2, round((b - a * a) / (1 - a * a), 6) FROM g""")
def a12p(spark, d):
    acf = profile.autocorrelation(price(spark, d), "price_close", "series", 2)
    return profile.partial_autocorrelation(acf, "series").withColumn("pacf", r("pacf"))


@query("a13_unit_root", f"""WITH {PX}, l AS (SELECT series, c - lag(c) OVER w AS y, lag(c) OVER w AS x FROM px WINDOW w AS {PART})), g AS (SELECT series, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM l WHERE y IS NOT NULL GROUP BY 1)
 SELECT series, n::INTEGER AS n, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 4) AS statistic, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) < -2.86 AS stationary FROM g""")
def a13(spark, d):
    return profile.unit_root(price(spark, d), "price_close", "series", lags=0).withColumn("statistic", r("statistic", 4))


@query("a14_histogram", "SELECT CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 51 ELSE floor((c_acctbal + 1000) / 220)::INTEGER + 1 END::INTEGER AS bin, count(*) AS n FROM customer GROUP BY 1")
def a14(spark, d):
    return profile.histogram(table(spark, d, "customer"), "c_acctbal", -1000.0, 10000.0, 50)


@query("a15_complete_rows", f"WITH {PX}, l AS (SELECT c, lag(c, 30) OVER w AS b, lead(c, 28) OVER w AS f FROM px WINDOW w AS {PART})) SELECT count(*) AS n, count(*) FILTER (b IS NOT NULL AND f IS NOT NULL) AS complete, count(*) FILTER (b IS NOT NULL) AS complete_without FROM l")
def a15(spark, d):
    w, c = rolling.ordered("series"), F.col("price_close")
    x = price(spark, d).withColumns({"b": rolling.lag_n(c, 30, w), "f": rolling.lead_n(c, 28, w)})
    return profile.complete_rows(x, ["price_close", "b", "f"], ["f"])


@query("a16_overlap", "WITH a AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY sum(p_retailprice::DECIMAL(18,2)) DESC, p_brand LIMIT 10), b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10) SELECT count(*) AS shared, count(*) / 10 AS share FROM a JOIN b USING (p_brand)")
def a16(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("n"))
    ranked = [rolling.top_per_group(g.withColumn("all", F.lit(1)), ["all"], [F.desc(c), F.asc("name")], 10).select("name", "rank") for c in "sn"]
    return profile.overlap(*ranked, 10)


@query("l3_top_per_group", "SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer QUALIFY rank <= 5")
def l3(spark, d):
    return rolling.top_per_group(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)


@query("u3_unpivot", "WITH s AS (SELECT l_shipdate::DATE AS date, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1) SELECT date, u.commodity, u.price_close FROM (SELECT date, unnest([{'commodity': 'soyoil', 'price_close': a}, {'commodity': 'wti', 'price_close': n}]) AS u FROM s WHERE a IS NOT NULL AND n IS NOT NULL)")
def u3(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(*[F.sum(F.when(F.col("l_returnflag") == k, F.col("l_quantity"))).alias(k.lower()) for k in "AN"])
    return features.wide_to_panel(x, {"a": "soyoil", "n": "wti"})


OHLC = "o AS (SELECT l_partkey, max(l_extendedprice) AS high, min(l_extendedprice) AS low, any_value(1.0::DOUBLE) AS open, min(l_extendedprice) - 40000 AS close FROM lineitem GROUP BY 1)"


@query("q2_quarantine", f"WITH {OHLC} SELECT l_partkey, high, low, close FROM o WHERE high >= low AND least(open, high, low, close) > 0")
def q2(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.lit(1.0).alias("open"), (F.min("l_extendedprice") - 40000).alias("close"))
    return profile.quarantine(g)[0].drop("open")


# ---- feature blocks


def rounded(df: DataFrame, keep: list[str], cols: dict[str, int]) -> DataFrame:
    return df.select(*keep, *[r(c, n).alias(c) for c, n in cols.items()])


B1_SQL = f"""WITH {PX}, a AS (SELECT series, date, c, {', '.join(f'lag(c, {n}) OVER w AS price_lag_{n}' for n in (1, 3, 7, 14, 30))}, {', '.join(f'avg(c) OVER {frame(n)} AS price_ma_{n}' for n in (7, 14, 30))},
 {', '.join(f'c / lag(c, {n}) OVER w - 1 AS return_{n}d' for n in (1, 3, 7, 14))} FROM px WINDOW w AS {PART})),
 b AS (SELECT *, {', '.join(f'CASE WHEN count(return_1d) OVER {frame(n)} >= {m} THEN stddev_samp(return_1d) OVER {frame(n)} END AS volatility_{n}d' for n, m in ((5, 2), (10, 3), (20, 5)))} FROM a)
 SELECT series, date, round(c, 4) AS price_close, {', '.join(f'round(price_lag_{n}, 4) AS price_lag_{n}' for n in (1, 3, 7, 14, 30))}, {', '.join(f'round(price_ma_{n}, 4) AS price_ma_{n}, round(c / price_ma_{n}, 6) AS price_to_ma{n}_ratio' for n in (7, 14, 30))},
 {', '.join(f'round(return_{n}d, 6) AS return_{n}d' for n in (1, 3, 7, 14))}, {', '.join(f'round(volatility_{n}d, 6) AS volatility_{n}d' for n in (5, 10, 20))} FROM b"""


@query("b1_price", B1_SQL)
def b1(spark, d):
    cols = {"price_close": 4} | {f"price_lag_{n}": 4 for n in (1, 3, 7, 14, 30)} | {f"price_ma_{n}": 4 for n in (7, 14, 30)} | {f"price_to_ma{n}_ratio": 6 for n in (7, 14, 30)}
    cols |= {f"return_{n}d": 6 for n in (1, 3, 7, 14)} | {f"volatility_{n}d": 6 for n in (5, 10, 20)}
    return rounded(features.price_block(price(spark, d)), features.KEYS, cols)


@query("b2_exchange", f"""WITH {FX}, days AS (SELECT unnest(generate_series((SELECT min(date) FROM fx), (SELECT max(date) FROM fx), INTERVAL 1 DAY))::DATE AS date),
 f AS (SELECT date, last_value(x IGNORE NULLS) OVER (ORDER BY date) AS v, (x IS NULL)::INTEGER AS is_interpolated FROM days LEFT JOIN fx USING (date)), g AS (SELECT *, v / lag(v) OVER (ORDER BY date) - 1 AS r FROM f)
 SELECT date, is_interpolated, round(v, 4) AS usd_brl_close, round(lag(v) OVER (ORDER BY date), 4) AS usd_brl_lag_1, round(v / lag(v, 7) OVER (ORDER BY date) - 1, 6) AS usd_brl_return_7d,
 CASE WHEN count(r) OVER f14 >= 5 THEN round(stddev_samp(r) OVER f14, 6) END AS usd_brl_volatility_14d FROM g WINDOW f14 AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def b2(spark, d):
    daily = cal.calendar_expand(exchange(spark, d), ["series"], "date", ["usd_brl_close"])
    out = features.market_block(daily, "usd_brl_close", "usd_brl")
    return rounded(out, ["date", "is_interpolated"], {"usd_brl_close": 4, "usd_brl_lag_1": 4, "usd_brl_return_7d": 6, "usd_brl_volatility_14d": 6})


@query("b4_crush", f"""WITH {PX}, s AS (SELECT a.date, a.c * 22.0462 * 0.179 + b.c * 1.10231 * 0.765 - x.c * (36.744 / 100.0) AS v FROM px a JOIN px b ON a.date = b.date AND b.series = 'Brand#2' JOIN px x ON a.date = x.date AND x.series = 'Brand#3' WHERE a.series = 'Brand#1')
 SELECT date, round(v, 3) AS crush_spread, round(avg(v) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 3) AS crush_spread_ma7, round(lag(v) OVER (ORDER BY date), 3) AS crush_spread_lag_1 FROM s""")
def b4(spark, d):
    """The three legs come out of one pass over the prices."""
    brands = {"Brand#1": "zl_close", "Brand#2": "zm_close", "Brand#3": "zs_close"}
    px = price(spark, d).where(F.col("series").isin(*brands))
    legs = px.groupBy(F.lit("crush").alias("series"), "date").agg(*[F.max(F.when(F.col("series") == b, F.col("price_close"))).alias(n) for b, n in brands.items()])
    return rounded(features.crush_of_legs(legs), ["date"], {"crush_spread": 3, "crush_spread_ma7": 3, "crush_spread_lag_1": 3})


@query("b6_positioning", f"WITH {MONTHLY} SELECT date, round(total, 2) AS net, round(total - lag(total) OVER (ORDER BY date), 2) AS chg, total / nullif(orders, 0) AS ratio FROM rel")
def b6(spark, d):
    x = monthly(spark, d).select(F.lit("x").alias("series"), "date", F.col("total").alias("cftc_noncomm_net"), F.col("total").alias("long"), F.col("orders").alias("short"))
    out = features.positioning_block(x)
    return out.select("date", r("cftc_noncomm_net", 2).alias("net"), r("cftc_noncomm_net_chg_1w", 2).alias("chg"), F.col("cftc_long_short_ratio").alias("ratio"))


@query("b7_supply", f"""WITH {PX}, v AS (SELECT date_trunc('month', o_orderdate)::DATE + 9 AS date, o_orderpriority AS p, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), best AS (SELECT date, n FROM v QUALIFY row_number() OVER (PARTITION BY date ORDER BY left(p, 1)::DOUBLE DESC) = 1)
 SELECT series, px.date, n AS stock FROM px ASOF LEFT JOIN best ON px.date >= best.date""")
def b7(spark, d):
    px = price(spark, d)
    v = table(spark, d, "orders").groupBy(F.lit("x").alias("series"), F.date_add(F.trunc("o_orderdate", "MM"), 9).alias("date"), F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("stock"))
    one = features.supply_block(v, clean.marketing_year_key(F.col("p"))).select("date", "stock")
    return align.align_asof(per_series(one, px), px.select("series", "date"), ["series"])


@query("b13_level_changes", f"WITH {MONTHLY} SELECT date, round(total, 2) AS total, round(total / lag(total, 3) OVER w - 1, 6) AS total_chg_3m, round(total - lag(total) OVER w, 2) AS total_chg_1m FROM rel WINDOW w AS (ORDER BY date)")
def b13(spark, d):
    x = features.level_block(monthly(spark, d).drop("orders").withColumn("series", F.lit("x")), "total", (3,), (1,))
    return rounded(x, ["date"], {"total": 2, "total_chg_3m": 6, "total_chg_1m": 2})


@query("b14_volatility_index", f"WITH {FX} SELECT date, round(x / 5000, 4) AS vix_close, round(lag(x / 5000) OVER w, 4) AS vix_lag_1, round((x / 5000) / lag(x / 5000, 7) OVER w - 1, 6) AS vix_return_7d, (x / 5000 > 25)::INTEGER AS vix_regime FROM fx WINDOW w AS (ORDER BY date)")
def b14(spark, d):
    out = features.volatility_index_block(exchange(spark, d).select("series", "date", (F.col("usd_brl_close") / 5000).alias("vix_close")))
    return rounded(out, ["date", "vix_regime"], {"vix_close": 4, "vix_lag_1": 4, "vix_return_7d": 6})


LABEL_SQL = """lead(c, 1) OVER w AS p1, lead(c, 7) OVER w AS p7, lead(c, 28) OVER w AS p28"""


@query("b18_labels", f"""WITH {PX}, l AS (SELECT series, date, c, {LABEL_SQL} FROM px WINDOW w AS {PART})) SELECT series, date, round(p1, 4) AS target_price_t1, round(p7, 4) AS target_price_t7, round(p28, 4) AS target_price_t28,
 round(p7 / c - 1, 6) AS target_return_t7, round(p28 / c - 1, 6) AS target_return_t28, (p7 / c - 1 > 0)::INTEGER AS target_updown_t7, (p28 / c - 1 > 0)::INTEGER AS target_updown_t28,
 (p7 / c - 1 > 0.02)::INTEGER AS target_thresh_t7, (p28 / c - 1 > 0.03)::INTEGER AS target_thresh_t28 FROM l""")
def b18(spark, d):
    flags = [f"target_{k}_t{n}" for k in ("updown", "thresh") for n in (7, 28)]
    cols = {f"target_price_t{n}": 4 for n in (1, 7, 28)} | {f"target_return_t{n}": 6 for n in (7, 28)}
    return rounded(features.label_block(price(spark, d)), [*features.KEYS, *flags], cols)


B17_SQL = f"""WITH {PX}, {MONTHLY}, a AS (SELECT series, px.date, c, total AS cftc_noncomm_net FROM px ASOF LEFT JOIN rel ON px.date >= rel.date),
 b AS (SELECT *, CASE WHEN count(c) OVER {frame(30, 1)} = 30 THEN avg(c) OVER {frame(30, 1)} END AS mavg, c / lag(c, 7) OVER w - 1 AS r7, c / lag(c, 14) OVER w - 1 AS r14, list(cftc_noncomm_net) OVER {frame(252)} AS l, count(*) OVER {frame(252)} AS n,
  coalesce(CASE WHEN count(c) OVER {frame(200)} = 200 THEN c > avg(c) OVER {frame(200)} END, false)::INTEGER AS above FROM a WINDOW w AS {PART}))
 SELECT series, date, round(mavg, 4) AS market_avg_price_30d, round(c / mavg - 1, 6) AS price_vs_market_avg, round(c * 22.0462, 3) AS soyoil_usd_per_ton, round(r7 - r14, 6) AS momentum_accel_7d, above AS price_above_200d_ma,
 round(r7 - avg(r7) OVER (PARTITION BY series, weekofyear(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS seasonal_adj_return_7d,
 CASE WHEN cftc_noncomm_net IS NOT NULL AND len(list_filter(l, lambda x: x IS NOT NULL)) >= 30 THEN round((len(list_filter(l, lambda x: x < cftc_noncomm_net)) + (len(list_filter(l, lambda x: x = cftc_noncomm_net)) + 1) / 2) / n, 6) END AS cftc_percentile_52w FROM b"""


@query("b19_master", B17_SQL)
def b19(spark, d):
    px = price(spark, d)
    release = per_series(monthly(spark, d).select("date", F.col("total").alias("cftc_noncomm_net")), px)
    out = features.build_master(px, releases=[release])
    return rounded(out, [*features.KEYS, "price_above_200d_ma"], {"market_avg_price_30d": 4, "price_vs_market_avg": 6, "soyoil_usd_per_ton": 3, "momentum_accel_7d": 6, "seasonal_adj_return_7d": 6, "cftc_percentile_52w": 6})


@query("b20_panel", f"""WITH {PX}, l AS (SELECT series, date, c, lag(c, 1) OVER w AS a, lag(c, 7) OVER w AS b, c / lag(c, 1) OVER w - 1 AS r, CASE WHEN count(c) OVER {frame(30)} >= 15 THEN c / avg(c) OVER {frame(30)} END AS m FROM px WINDOW w AS {PART})),
 v AS (SELECT *, CASE WHEN count(r) OVER {frame(20)} >= 5 THEN stddev_samp(r) OVER {frame(20)} END AS s FROM l), f AS (SELECT * FROM v WHERE a IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL AND m IS NOT NULL)
 SELECT series AS commodity, date, round(a, 4) AS lag_1, round(b, 4) AS lag_7, round(c / b - 1, 6) AS return_7d, round(s, 6) AS volatility_20d, round(m, 6) AS ma30_ratio, (dense_rank() OVER (ORDER BY date) - 1)::INTEGER AS time_idx, 'train' AS split FROM f""")
def b20(spark, d):
    out = features.panel_features(price(spark, d).withColumnRenamed("series", "commodity"))
    return rounded(out.withColumn("time_idx", F.col("time_idx").cast("int")), ["commodity", "date", "time_idx", "split"], {"lag_1": 4, "lag_7": 4, "return_7d": 6, "volatility_20d": 6, "ma30_ratio": 6})


@query("b22_weights", f"""WITH {PX}, x AS (SELECT series, date, date + 8400 AS shifted, c / lag(c, 7) OVER {PART}) - 1 AS r FROM px) SELECT series, date, (CASE WHEN shifted BETWEEN DATE '2022-02-01' AND DATE '2022-08-31' THEN 3.0 WHEN shifted BETWEEN DATE '2021-01-01' AND DATE '2021-12-31' THEN 2.5
 WHEN shifted >= DATE '2025-01-01' THEN 2.0 ELSE 1.0 END * CASE WHEN abs(r) > 0.05 THEN 1.5 ELSE 1.0 END)::DOUBLE AS weight FROM x""")
def b22(spark, d):
    x = price(spark, d).withColumn("r", rolling.pct_change(F.col("price_close"), 7, rolling.ordered("series")))
    return x.select("series", "date", features.sample_weight(F.date_add("date", 8400), F.col("r")).alias("weight"))


@query("b23_index_split", f"WITH {PX}, i AS (SELECT series, date, dense_rank() OVER (ORDER BY date) - 1 AS k FROM px) SELECT series, date, CASE WHEN k > m - 30 THEN 'test' WHEN k > m - 120 THEN 'calibration' ELSE 'train' END AS part FROM i, (SELECT max(k) AS m FROM i)")
def b23(spark, d):
    return features.index_split(rolling.time_index(price(spark, d))).select("series", "date", "part")


# ---- news

NEWS_WORDS = {"categories": {"weather": ("tion", "qu"), "policy": ("ander",), "crop": ("ing",), "export": ("en",)}, "bullish": {"ou": 0.95, "er": 0.65}, "bearish": {"ed": -0.85, "and": -1.0}, "regions": ((("th", "la"), 2.0), (("zu", "der"), 2.0), (("re",), 1.0))}


def _has_any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query("n6_score_news", f"""WITH d AS (SELECT doc_id, source, lower(text) AS t FROM documents), s AS (SELECT doc_id, source, t, CASE {' '.join(f"WHEN {_has_any(w)} THEN '{k}'" for k, w in NEWS_WORDS['categories'].items())} ELSE 'other' END AS category,
 greatest(-1.0, least(1.0, greatest(0.0, {', '.join(f"CASE WHEN contains(t, '{w}') THEN {x} ELSE 0.0 END" for w, x in NEWS_WORDS['bullish'].items())}) + least(0.0, {', '.join(f"CASE WHEN contains(t, '{w}') THEN {x} ELSE 0.0 END" for w, x in NEWS_WORDS['bearish'].items())})))::DOUBLE AS sentiment_score,
 greatest(1.0, least(5.0, 1.0 + {' + '.join(f"CASE WHEN {_has_any(w)} THEN {x} ELSE 0.0 END" for w, x in NEWS_WORDS['regions'])}))::DOUBLE AS impact_score, 0.4::DOUBLE AS certainty_factor FROM d),
 w AS (SELECT *, (CASE WHEN category = 'weather' AND contains(t, 'th') THEN 1.0 WHEN category = 'policy' THEN 0.9 ELSE 0.5 END)::DOUBLE AS weight FROM s)
 SELECT doc_id, category, round(sentiment_score, 6) AS sentiment_score, impact_score, certainty_factor, weight, round(sentiment_score * impact_score * certainty_factor * weight, 6) AS final_score FROM w""")
def n6_all(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("title"))
    out = news.score_news(x, region="th", **NEWS_WORDS)
    return out.select("doc_id", "category", r("sentiment_score").alias("sentiment_score"), "impact_score", "certainty_factor", "weight", r("final_score").alias("final_score"))


query("n6_score_news_all", ORACLES["n6_score_news"])(n6_all)


# ---- classification

LABELLED = "x AS (SELECT l.doc_id, quality, n_chars, (n_chars > 1500)::INTEGER AS predicted FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality IS NOT NULL)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id").where("quality IS NOT NULL")
    return x.withColumn("predicted", (F.col("n_chars") > 1500).cast("int"))


@query("m2_expanding_folds", f"WITH {PX}, d AS (SELECT DISTINCT date FROM px), n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS m FROM d) SELECT date, i::BIGINT AS row_no, CASE WHEN i >= 500 AND (i - 500) // 60 < (m - 500) // 60 THEN ((i - 500) // 60)::INTEGER END AS fold FROM n")
def m2(spark, d):
    return learn.expanding_folds(learn.numbered(price(spark, d).select("date").distinct())).select("date", "row_no", "fold")


@query("m3_time_cv", f"WITH {PX}, d AS (SELECT DISTINCT date FROM px), n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS m FROM d) SELECT date, CASE WHEN i < m - 5 * (m // 6) THEN 0 ELSE (i - (m - 5 * (m // 6))) // (m // 6) + 1 END::INTEGER AS fold FROM n")
def m3(spark, d):
    return learn.time_cv(learn.numbered(price(spark, d).select("date").distinct())).select("date", "fold")


@query("m7_metrics", f"WITH {LABELLED}, c AS (SELECT count(*) FILTER (predicted = 1 AND quality = 1) AS tp, count(*) FILTER (predicted = 1 AND quality = 0) AS fp, count(*) FILTER (predicted = 0 AND quality = 1) AS fn, count(*) FILTER (predicted = 0 AND quality = 0) AS tn FROM x) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def m7(spark, d):
    out = learn.metrics(labelled(spark, d), "predicted", "quality", [])
    return rounded(out, ["tp", "fp", "fn", "tn"], {"accuracy": 6, "precision": 6, "recall": 6, "f1": 6})


@query("m8_auc", f"WITH {LABELLED} SELECT round(sum(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS auc FROM x p JOIN x n ON p.quality = 1 AND n.quality = 0")
def m8(spark, d):
    return learn.auc(labelled(spark, d), "n_chars", "quality", []).select(r("auc").alias("auc"))


MODEL = ["return_1d", "return_3d", "return_7d", "return_14d", "volatility_5d", "price_to_ma7_ratio"]


def training(spark: SparkSession, d: str) -> DataFrame:
    x = features.label_block(features.price_block(price(spark, d)))
    return features.complete_cases(features.select_features(x, MODEL, "target_updown_t7"), "target_updown_t7")


@query("m4_boosted_trees")
def m4(spark, d):
    import datetime

    train, test = learn.time_split(chunks.kept(training(spark, d)), datetime.date(2000, 1, 1))
    models = learn.fit_all([learn.boosted_trees(MODEL, "target_updown_t7")], learn.fit_table(train, features.KEYS))
    return learn.probability(models, test, MODEL).select("series", "date", r("probability_up", 4).alias("probability_up"))


def files_state(spark: SparkSession, d: str) -> str:
    """Names, sizes and times of the files that the prices come from."""
    parts = [table(spark, d, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time") for t in ("lineitem", "part")]
    return str(parts[0].union(parts[1]).distinct().agg(F.bit_xor(F.xxhash64('file_path', 'file_size', 'file_modification_time')), F.count(F.lit(1))).first())


@lru_cache(maxsize=4)
def fitted(application: str, d: str, state: str) -> tuple[list, DataFrame]:
    """The ensemble of all training rows and the table of them, made once a session and state of the files: what-if tables and
    contributions explain the same models."""
    x = learn.fit_table(training(SparkSession.active(), d), features.KEYS)
    return learn.fit_all(learn.ensemble(MODEL, "target_updown_t7"), x), x


@query("m9_what_if")
def m9(spark, d):
    models, rows = fitted(spark.sparkContext.applicationId, d, files_state(spark, d))
    late = align.latest_asof(rows, "series")
    return learn.what_if(late, MODEL, lambda v: learn.probability(models, v, MODEL), ["series"])


@query("m10_contributions")
def m10(spark, d):
    models, rows = fitted(spark.sparkContext.applicationId, d, files_state(spark, d))
    return learn.importance(learn.contributions(rows, MODEL, lambda v: learn.probability(models, v, MODEL), ["series", "date"]))


# ---- bands


def cal_rows() -> Column:
    return F.col("time_idx").between(200, 599)


def test_rows() -> Column:
    return F.col("time_idx") >= 600


@query("r3_r4_bias", f"WITH {PRED}, b AS (SELECT series, avg(actual - p50) FILTER (time_idx BETWEEN 200 AND 599) AS bias FROM pred GROUP BY 1) SELECT p.series, date, round(p50 + coalesce(bias, 0), 3) AS p50, round(p10 + coalesce(bias, 0), 3) AS p10, round(p90 + coalesce(bias, 0), 3) AS p90 FROM pred p JOIN b ON p.series = b.series")
def r3(spark, d):
    p = predictions(spark, d)
    return rounded(bands.correct(p, bands.bias(p, cal_rows(), ["series"]), ["series"]), ["series", "date"], {"p50": 3, "p10": 3, "p90": 3})


@query("r5_r8_half_widths", f"WITH {PRED} SELECT series, round(quantile_cont(abs(actual - p50), 0.85) FILTER (time_idx BETWEEN 200 AND 599), 3) AS q, round(quantile_cont(abs(actual - p50), 0.85) FILTER (time_idx BETWEEN 200 AND 599) * stddev_samp(actual) FILTER (time_idx >= 600) / stddev_samp(actual) FILTER (time_idx BETWEEN 200 AND 599), 3) AS scaled FROM pred GROUP BY 1")
def r5(spark, d):
    p = predictions(spark, d)
    a = bands.half_width(p, cal_rows(), ["series"]).select("series", r("q", 3).alias("q"))
    return a.join(bands.scaled_half_width(p, cal_rows(), test_rows(), ["series"]).select("series", r("q", 3).alias("scaled")), "series")


#: Forecasts that are too low by 0.3 % of the price, so that recentring matters.
LOW = "biased AS (SELECT series, time_idx, p50 * 0.997::DOUBLE AS p50, p10 * 0.99::DOUBLE AS p10, p90 * 1.01::DOUBLE AS p90, actual FROM pred)"


def biased(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).withColumns({"p50": F.col("p50") * 0.997, "p10": F.col("p10") * 0.99, "p90": F.col("p90") * 1.01})


@query("r7_least_alpha", f"""WITH {PRED}, {LOW}, m AS (SELECT series, avg(actual - p50) FILTER (time_idx BETWEEN 200 AND 599) AS bias FROM biased GROUP BY 1), e AS (SELECT series, time_idx, abs(actual - p50) AS e, abs(actual - (p50 + bias)) AS f FROM biased JOIN m USING (series)),
 g AS (SELECT series, list(e ORDER BY e) FILTER (time_idx BETWEEN 200 AND 599) AS c, list(f ORDER BY f) FILTER (time_idx >= 600) AS t FROM e GROUP BY 1),
 n AS (SELECT series, c, t[ceil(len(t) * 0.8)::BIGINT] AS need FROM g), k AS (SELECT *, len(list_filter(c, lambda x: x < need)) AS k FROM n)
 SELECT series, round(need, 4) AS need, CASE WHEN k >= len(c) THEN NULL WHEN k = 0 THEN 0.0::DOUBLE ELSE round((k - 1 + (need - c[k]) / (c[k + 1] - c[k])) / (len(c) - 1), 5) END AS alpha FROM k""")
def r7(spark, d):
    """Test medians are moved by the calibration rows' bias."""
    out = bands.least_alpha(biased(spark, d), cal_rows(), test_rows(), ["series"])
    return out.select("series", r("need", 4).alias("need"), r("alpha", 5).alias("alpha"))


BANDS = f"""{PRED}, {LOW}, m AS (SELECT series, avg(actual - p50) FILTER (time_idx BETWEEN 200 AND 599) AS bias, quantile_cont(abs(actual - p50), 0.85) FILTER (time_idx BETWEEN 200 AND 599) AS fixed,
  stddev_samp(actual) FILTER (time_idx >= 600) / stddev_samp(actual) FILTER (time_idx BETWEEN 200 AND 599) AS ratio FROM biased GROUP BY 1),
 e AS (SELECT *, p50 + bias AS mid, fixed * ratio AS scaled, abs(actual - (p50 + bias)) AS e FROM biased JOIN m USING (series)),
 o AS (SELECT *, CASE WHEN count(e) OVER f = 60 THEN quantile_cont(e, 0.85) OVER f END AS rolling FROM e WINDOW f AS (PARTITION BY series ORDER BY time_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 b AS (SELECT series, actual, 'raw' AS band, p50, least(p10, p90) AS lo, greatest(p10, p90) AS hi FROM o WHERE time_idx >= 600 {' '.join(f"UNION ALL SELECT series, actual, '{x}', mid, mid - {x}, mid + {x} FROM o WHERE time_idx >= 600" for x in ('fixed', 'scaled', 'rolling'))})"""
MEASURES = "count(*) AS n, round(avg(abs(actual - p50)), 3) AS mae, round(sqrt(avg((actual - p50) ** 2)), 3) AS rmse, round(avg((actual > lo AND actual < hi)::INTEGER) * 100, 4) AS coverage, round(avg((hi - lo) / 2), 3) AS half_width"


@query("r10_all_bands", f"WITH {BANDS} SELECT series, band, {MEASURES} FROM b GROUP BY 1, 2")
def r10_all(spark, d):
    """Raw, fixed, scaled and rolling bands of biased forecasts, recentred."""
    out = bands.compare_bands(biased(spark, d), cal_rows(), test_rows(), ["series"])
    return rounded(out, ["series", "band", "n"], {"mae": 3, "rmse": 3, "coverage": 4, "half_width": 3})


@query("r6_fixed_coverage", f"WITH {BANDS} SELECT band, {MEASURES} FROM b WHERE band = 'fixed' GROUP BY 1")
def r6(spark, d):
    """The recentred fixed band, its half-width from each series, over all series together."""
    x = biased(spark, d)
    q = bands.half_width(x, cal_rows(), ["series"])
    moved = bands.correct(x, bands.bias(x, cal_rows(), ["series"]), ["series"]).where(test_rows()).join(q, "series")
    out = bands.evaluate_bands(moved.withColumns({"band": F.lit("fixed"), "lo": F.col("p50") - F.col("q"), "hi": F.col("p50") + F.col("q")}), ["band"])
    return rounded(out, ["band", "n"], {"mae": 3, "rmse": 3, "coverage": 4, "half_width": 3})


@query("r13_rank_of_q", f"WITH {PRED}, q AS (SELECT series, quantile_cont(abs(actual - p50), 0.85) AS q FROM pred WHERE time_idx BETWEEN 200 AND 599 GROUP BY 1) SELECT series, round(any_value(q), 4) AS q, round(100 * avg((abs(actual - p50) <= q)::INTEGER), 4) AS rank_pct FROM pred JOIN q USING (series) WHERE time_idx >= 600 GROUP BY 1")
def r13_rank(spark, d):
    return rounded(bands.half_width_rank(predictions(spark, d), cal_rows(), test_rows(), ["series"]), ["series"], {"q": 4, "rank_pct": 4})


ROLL = f"{PRED}, e AS (SELECT *, abs(actual - p50) AS e FROM pred), roll AS (SELECT *, CASE WHEN count(e) OVER f = 60 THEN quantile_cont(e, 0.85) OVER f END AS q FROM e WINDOW f AS (PARTITION BY series ORDER BY time_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"


@query("r9_rolling_conformal", f"WITH {ROLL} SELECT series, date, round(q, 4) AS q, round(p50 - q, 4) AS lo, round(p50 + q, 4) AS hi FROM roll")
def r9(spark, d):
    return rounded(bands.rolling_conformal(predictions(spark, d)), ["series", "date"], {"q": 4, "lo": 4, "hi": 4})


@query("r10_evaluation", f"WITH {ROLL} SELECT series, count(*) AS n, round(avg(abs(actual - p50)), 3) AS mae, round(sqrt(avg((actual - p50) ** 2)), 3) AS rmse, round(avg(((actual > p50 - q) AND (actual < p50 + q))::INTEGER) * 100, 4) AS coverage, round(avg(q), 3) AS half_width FROM roll WHERE time_idx >= 600 GROUP BY 1")
def r10(spark, d):
    x = bands.rolling_conformal(predictions(spark, d)).where(test_rows())
    return rounded(bands.evaluate_bands(x, ["series"]), ["series", "n"], {"mae": 3, "rmse": 3, "coverage": 4, "half_width": 3})


@query("r11_alpha_grid", f"""WITH {PRED}, e AS (SELECT *, abs(actual - p50) AS e FROM pred), f AS (SELECT *, count(e) OVER w AS n, {', '.join(f'quantile_cont(e, {a}) OVER w AS q{i}' for i, a in enumerate(bands.GRID))} FROM e WINDOW w AS (PARTITION BY series ORDER BY time_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 u AS ({' UNION ALL '.join(f'SELECT series, p50, actual, {a}::DOUBLE AS alpha, q{i} AS q FROM f WHERE n = 60' for i, a in enumerate(bands.GRID))})
 SELECT series, alpha, round(avg(((actual > p50 - q) AND (actual < p50 + q))::INTEGER) * 100, 4) AS coverage, round(avg(q), 3) AS half_width FROM u GROUP BY 1, 2""")
def r11(spark, d):
    return rounded(bands.alpha_grid(predictions(spark, d)), ["series", "alpha"], {"coverage": 4, "half_width": 3})


@query("r14_naive", f"WITH {PRED}, l AS (SELECT series, time_idx, abs(actual - lag(actual) OVER (PARTITION BY series ORDER BY time_idx)) AS e FROM pred) SELECT series, round(avg(e), 3) AS mae FROM l WHERE time_idx >= 600 GROUP BY 1")
def r14(spark, d):
    return bands.naive_baseline(predictions(spark, d), test_rows()).select("series", r("mae", 3).alias("mae"))


def _diagnosed(name: str, rows: str) -> str:
    values = {"volatility": "stddev_samp(actual)", "move": "avg(m)", "mean_error": "avg(actual - p50)", "std_error": "stddev_samp(actual - p50)", "q80": "quantile_cont(abs(actual - p50), 0.8)"}
    return ", ".join(f"round({v} FILTER ({rows}), 3) AS {name}_{k}" for k, v in values.items())


@query("r13_diagnostics", f"WITH {PRED}, l AS (SELECT *, abs(actual - lag(actual) OVER (PARTITION BY series ORDER BY time_idx)) AS m FROM pred) SELECT series, {_diagnosed('calibration', 'time_idx BETWEEN 200 AND 599')}, {_diagnosed('test', 'time_idx >= 600')} FROM l GROUP BY 1")
def r13(spark, d):
    out = bands.diagnostics(predictions(spark, d), {"calibration": cal_rows(), "test": test_rows()})
    return rounded(out, ["series"], {c: 3 for c in out.columns if c != "series"})


R1_SQL = " UNION ALL ".join(
    f"""SELECT series, date, {h}::INTEGER AS horizon, round(c * (1 + q[1]), 3) AS p10, round(c * (1 + q[2]), 3) AS p50, round(c * (1 + q[3]), 3) AS p90
 FROM (SELECT *, quantile_cont(g, {list(bands.LEVELS)}) OVER {frame(250)} AS q FROM (SELECT series, date, c, c / lag(c, {h}) OVER {PART}) - 1 AS g FROM px)) WHERE q[1] IS NOT NULL"""
    for h in bands.HORIZONS
)


@query("r1_quantile_forecast", f"WITH {PX.replace(' AS (', ' AS MATERIALIZED (', 1)} {R1_SQL}")
def r1(spark, d):
    """All 28 horizons."""
    out = bands.quantile_forecast(price(spark, d), "price_close")
    return rounded(out, ["series", "date", "horizon"], {"p10": 3, "p50": 3, "p90": 3})


# ---- decisions

REQUESTS = f"""{PX}, last AS (SELECT arg_max(c, date) / 30 AS price FROM px WHERE series = 'Brand#1'), q AS (SELECT c_custkey, price, (c_custkey % 7) * 1000.0::DOUBLE AS inv, (c_custkey % 3) * 1000.0::DOUBLE AS po, 3500.0::DOUBLE AS safety, 1000.0::DOUBLE * (c_custkey % 6 + 1) AS q, 1200.0::DOUBLE AS monthly,
 price * (0.9::DOUBLE + (c_custkey % 5) * 0.05::DOUBLE) AS p50 FROM customer, last), t AS (SELECT *, price * 22.0462 AS p, p50 * 22.0462 AS m, (p50 - 2) * 22.0462 AS lo, (p50 + 2) * 22.0462 AS hi, inv + po AS e, inv + po - monthly * (50 / 30.0) AS due FROM q),
 a AS (SELECT *, CASE WHEN e < safety OR m > p * 1.03 THEN 'Buy' WHEN m < p * 0.97 THEN 'Wait' ELSE 'Split' END AS act, q >= 2000 AND e >= safety AND due >= safety AS can_wait FROM t), z AS (SELECT *, CASE WHEN act = 'Wait' AND NOT can_wait THEN 'Split' ELSE act END AS rec FROM a)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    last = price(spark, d).where("series = 'Brand#1'").agg((F.max_by("price_close", "date") / 30).alias("price"))
    k = F.col("c_custkey")
    x = table(spark, d, "customer").select("c_custkey").join(F.broadcast(last))
    return x.select(
        "c_custkey", F.col("price").alias("current_price_cbot"), F.lit(None).cast("double").alias("market_avg_cbot"), F.lit("2002-01-01").cast("date").alias("decision_date"), ((k % 7) * 1000.0).alias("current_inventory_ton"), ((k % 3) * 1000.0).alias("open_po_ton"),
        F.lit(3500.0).alias("safety_stock_ton"), ((k % 6 + 1) * 1000.0).alias("quantity_ton"), F.lit(1200.0).alias("monthly_consumption_ton"), F.lit("cbot").alias("forecast_unit"), (F.col("price") * (F.lit(0.9) + (k % 5) * 0.05)).alias("p50"),
    ).withColumns({"p10": F.col("p50") - 2, "p90": F.col("p50") + 2})


@query("d4_d8_recommendation", f"""WITH {REQUESTS} SELECT c_custkey, rec AS recommendation, e AS effective_inventory_ton, round(due, 4) AS inventory_at_due_ton, round((m - p) / p * 100, 3) AS reward_vs_market_pct,
 round(CASE rec WHEN 'Buy' THEN p * q WHEN 'Wait' THEN m * q ELSE p * (q / 2) + m * (q / 2) END, 2) AS expected_cost_usd, CASE rec WHEN 'Buy' THEN q >= 2000 WHEN 'Split' THEN q / 2 >= 2000 ELSE can_wait END AS feasible,
 CASE WHEN m > p * 1.03 THEN 'up' WHEN m < p * 0.97 THEN 'down' ELSE 'flat' END AS price_direction, (q < 2000)::INTEGER + (q / 2 < 2000)::INTEGER + (NOT can_wait)::INTEGER AS violations FROM z""")
def d4(spark, d):
    out, _ = decide.evaluate_scenarios(requests(spark, d))
    return out.select("c_custkey", "recommendation", "effective_inventory_ton", r("inventory_at_due_ton", 4).alias("inventory_at_due_ton"), r("reward_vs_market_pct", 3).alias("reward_vs_market_pct"), r("expected_cost_usd", 2).alias("expected_cost_usd"), "feasible", "price_direction", F.size("constraint_violations").alias("violations"))


@query("d6_options", f"""WITH {REQUESTS}, o AS (SELECT c_custkey, 'Buy' AS action, (p - m) * q AS reward_usd, q >= 2000 AS feasible, lo, hi, q FROM z UNION ALL SELECT c_custkey, 'Split', (p - m) * q / 2, q / 2 >= 2000, lo, hi, q FROM z UNION ALL SELECT c_custkey, 'Wait', (m - p) * q, can_wait, lo, hi, q FROM z)
 SELECT c_custkey, action, round(reward_usd, 2) AS reward_usd, feasible, round(q * (hi - lo), 2) AS span_usd FROM o""")
def d6(spark, d):
    x = decide.options_long(decide.evaluate_scenarios(requests(spark, d))[0], ["c_custkey"])
    return x.select("c_custkey", "action", r("reward_usd", 2).alias("reward_usd"), "feasible", r("span_usd", 2).alias("span_usd"))


# ---- further operators


@query("p3_feature_set", f"WITH {PX}, l AS (SELECT series, date, c, {', '.join(f'lag(c, {n}) OVER w AS l{n}' for n in (1, 3, 7, 14))}, lead(c, 7) OVER w AS f FROM px WINDOW w AS {PART})) SELECT series, date, round(c / l1 - 1, 6) AS return_1d, round(c / l14 - 1, 6) AS return_14d, (f / c - 1 > 0)::INTEGER AS target_updown_t7 FROM l WHERE l14 IS NOT NULL AND f IS NOT NULL")
def p3(spark, d):
    import warnings

    from .plans import versions

    x = features.label_block(features.price_block(price(spark, d)))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        chosen = features.complete_cases(features.select_features(x, versions.columns("v1_stationary"), "target_updown_t7"), "target_updown_t7")
    return rounded(chosen, ["series", "date", "target_updown_t7"], {"return_1d": 6, "return_14d": 6})


@query("f17_attribute_classes", "SELECT p_type, contains(lower(p_type), 'o') AND NOT contains(lower(p_type), 'oil') AS flag, count(*) AS n FROM part GROUP BY 1, 2")
def f17(spark, d):
    name = F.concat(F.lower("p_type"), F.lit(" production"))
    return table(spark, d, "part").groupBy("p_type", (clean.is_production(name) & F.lower("p_type").contains("o")).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("f18_json", """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS document FROM customer""")
def f18(spark, d):
    return table(spark, d, "customer").select("c_custkey", clean.as_json("c_custkey", "c_mktsegment").alias("document"))


@query("f20_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def f20(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", clean.half_even(F.col("l_quantity") / 2, 0).alias("half"))


@query("q1_violations", f"WITH {OHLC} SELECT count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive FROM o")
def q1(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.lit(1.0).alias("open"), (F.min("l_extendedprice") - 40000).alias("close"))
    return g.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in profile.ohlcv_rules().items() if n != "no_date"])


@query("a4_news_summary", "SELECT source AS category, count(*) AS n, round(avg(n_chars), 4) AS mean_score FROM documents GROUP BY 1")
def a4(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("category"), F.col("n_chars").cast("double").alias("final_score"))
    return news.news_summary(x).withColumn("mean_score", r("mean_score", 4))


@query("l3_strongest_news", "SELECT doc_id, (n_chars - 3000)::DOUBLE AS final_score FROM documents ORDER BY abs(n_chars - 3000) DESC, doc_id LIMIT 5")
def l3n(spark, d):
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") - 3000).cast("double").alias("final_score"))
    return news.strongest(x, 5, "doc_id")


@query("a5_horizon_mean", f"WITH {PRED} SELECT date, round(avg(p50), 3) AS p50, round(avg(p10), 3) AS p10, round(avg(p90), 3) AS p90, round(avg(actual), 3) AS actual FROM pred GROUP BY 1")
def a5(spark, d):
    return rounded(bands.horizon_mean(predictions(spark, d), ["date"]), ["date"], {c: 3 for c in ("p50", "p10", "p90", "actual")})


@query("r2_return_to_price", f"""WITH {PX}, i AS (SELECT series, date, c, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM px), x AS (SELECT *, (k % 9 - 4) / 100.0::DOUBLE AS g FROM i WHERE k % 11 <> 3)
 SELECT x.series, x.date, round(x.c * (1 + (x.g - 0.05::DOUBLE)), 4) AS p10, round(x.c * (1 + x.g), 4) AS p50, round(x.c * (1 + (x.g + 0.07::DOUBLE)), 4) AS p90, round(y.c, 4) AS actual FROM x LEFT JOIN x y ON x.series = y.series AND y.k = x.k + 7""")
def r2(spark, d):
    """Returns that vary from row to row, and the price seven index steps on, where that row is there."""
    k = F.row_number().over(rolling.ordered("series")).cast("long")
    g = (F.col("k") % 9 - 4) / 100.0
    x = price(spark, d).select("series", "date", F.col("price_close").alias("level"), k.alias("k")).where("k % 11 <> 3")
    x = x.withColumns({"p10": g - 0.05, "p50": g, "p90": g + 0.07})
    return rounded(bands.return_to_price(x, index="k"), ["series", "date"], {"p10": 4, "p50": 4, "p90": 4, "actual": 4})


@query("r12_better_version", f"WITH {PRED}, b AS (SELECT series, avg(actual - p50) AS a, avg(actual - p10) AS b FROM pred GROUP BY 1) SELECT series, CASE WHEN abs(a) <= abs(b) THEN 'v3' ELSE 'v4' END AS version FROM b")
def r12(spark, d):
    p = predictions(spark, d)
    every = F.lit(True)
    a = bands.bias(p, every, ["series"]).withColumn("version", F.lit("v3"))
    b = bands.bias(p.withColumn("p50", F.col("p10")), every, ["series"]).withColumn("version", F.lit("v4"))
    return bands.better_version(a.unionByName(b), ["series"])


@query("r15_sorted_quantiles", f"WITH {PRED} SELECT series, date, round(least(p10, p50, p90), 3) AS lo, round(greatest(p10, p50, p90), 3) AS hi FROM pred")
def r15(spark, d):
    swapped = predictions(spark, d).withColumns({"p10": F.col("p90"), "p90": F.col("p10")})
    return rounded(bands.sorted_quantiles(swapped), ["series", "date"], {"lo": 3, "hi": 3})


@query("r16_bias_fallback", f"WITH {PRED} SELECT series, round(coalesce(avg(actual - p50) FILTER (time_idx > 1000000), avg(actual - p50) FILTER (time_idx BETWEEN 200 AND 599)), 3) AS bias FROM pred GROUP BY 1")
def r16(spark, d):
    return bands.bias_with_fallback(predictions(spark, d), [F.col("time_idx") > 1_000_000, cal_rows()], ["series"]).select("series", r("bias", 3).alias("bias"))


@query("j7_compare_versions", f"WITH {PRED} SELECT a.series, a.date, round(a.p50, 3) AS p50_a, round(b.p10, 3) AS p50_b, round(a.actual, 3) AS actual FROM pred a JOIN pred b ON a.series = b.series AND a.date = b.date")
def j7(spark, d):
    p = predictions(spark, d)
    b = p.withColumn("p50", F.col("p10"))
    return rounded(bands.compare_versions(p, b, ["series", "date"]), ["series", "date"], {"p50_a": 3, "p50_b": 3, "actual": 3})


# ---- streaming


@query("t1_stream_landing", "SELECT user_id, event_id, event_type, round(value, 2) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def t1(spark, d):
    """Lands the events of a stream under the key user_id, first writer wins, and reads the table back."""
    from .streaming.landing import land_stream

    work = writers.work_folder(spark)
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").select("user_id", "event_id", "event_type", "value", F.col("event_id").alias("seq"))
    land_stream(stream, f"{work}/landed", ["user_id"], f"{work}/checkpoint", "seq").awaitTermination()
    return spark.read.parquet(f"{work}/landed").select("user_id", "event_id", "event_type", r("value", 2).alias("value"))


def queries() -> dict[str, Query]:
    from . import round_trips, whole_plans  # noqa: F401  register their queries here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import round_trips, whole_plans  # noqa: F401

    return dict(ORACLES)
