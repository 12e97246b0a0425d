"""Registered queries of readers, writers and whole plans: what they write of the given tables is read back and checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import clean
from .operators import align, profile
from .plans import bands, decide, features, folds, learn, news
from .queries import B1_SQL, B17_SQL, FX, MODEL, PX, REQUESTS, exchange, monthly, per_series, price, query, r, requests, rounded, table, training
from .sources import readers, tables, writers
from .streaming import landing


def folder(spark: SparkSession) -> str:
    return writers.work_folder(spark)


def csv(df: DataFrame, header: bool = True) -> str:
    path = folder(df.sparkSession)
    df.write.csv(path, header=header)
    return path


def day(c: str, form: str = "yyyy-MM-dd"):
    return F.date_format(c, form)


# ---- readers


@query("s3_vendor_ohlcv", "SELECT l_shipdate::DATE AS date, l_quantity AS open, l_extendedprice + 1 AS high, l_quantity / 2 AS low, l_extendedprice AS close, l_quantity * 1000 AS volume, 'palm' AS commodity FROM lineitem")
def s3(spark, d):
    """US dates, quoted numbers with separators, volumes in thousands, a close of another name."""
    x = table(spark, d, "lineitem")
    raw = x.select(day("l_shipdate", "MM/dd/yyyy").alias("Trade Date"), F.format_number("l_extendedprice", 2).alias("Adj. Close"), F.col("l_quantity").cast("string").alias("OPEN"), F.format_number(F.col("l_extendedprice") + 1, 2).alias("High"), (F.col("l_quantity") / 2).cast("string").alias(" low"), F.concat(F.col("l_quantity"), F.lit("K")).alias("Vol."))
    out = readers.read_vendor_ohlcv(spark, csv(raw), "palm")
    return out.select("date", *[r(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume")], "commodity")


@query("s4_cot_text", "SELECT o_orderdate::DATE AS report_date, o_orderdate::DATE + 3 AS release_date, o_totalprice AS noncomm_long, o_custkey::DOUBLE AS noncomm_short, round(o_totalprice - o_custkey, 4) AS noncomm_net FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0")
def s4(spark, d):
    x = table(spark, d, "orders")
    fields = [F.concat(F.lit("Soybean Oil - "), "o_orderstatus"), F.lit("x"), day("o_orderdate"), *[F.lit("0")] * 5, F.when(F.col("o_orderkey") % 7 == 0, ".").otherwise(F.col("o_totalprice").cast("string")), F.col("o_custkey").cast("string")]
    out = readers.read_cot_text(spark, csv(x.select(*[f.alias(f"c{i}") for i, f in enumerate(fields)]), header=False), "soybean oil - f")
    return out.withColumn("noncomm_net", r("noncomm_net", 4))


@query("s5_supply_bulk", "SELECT p_type AS commodity_description, p_size AS calendar_year, p_partkey % 12 + 1 AS month, p_retailprice AS value FROM part WHERE p_type <> 'ECONOMY' AND p_size >= 10")
def s5(spark, d):
    x = table(spark, d, "part")
    raw = x.select(F.col("p_type").alias("Commodity_Description"), F.lit("Brazil").alias("COUNTRY_NAME"), F.lit("2020").alias("Market_Year"), F.col("p_size").alias("Calendar_Year"), (F.col("p_partkey") % 12 + 1).alias("Month"), F.lit("Production").alias("Attribute_Description"), F.format_number("p_retailprice", 2).alias("Value"))
    kinds = [k["p_type"] for k in x.where("p_type <> 'ECONOMY'").select("p_type").distinct().collect()]  # as the user names them; commodities are few
    return readers.read_supply_bulk(spark, csv(raw), kinds, first_year=10).select("commodity_description", "calendar_year", F.col("month").cast("long").alias("month"), "value")


@query("s6_supply_flat", "SELECT o_orderdate::DATE AS release_date, o_orderpriority AS marketing_year, NULL::DOUBLE AS world, o_totalprice AS stock, 1::INTEGER AS is_wasde_release_day FROM orders WHERE o_orderkey % 5 <> 0")
def s6(spark, d):
    """A numeric column that the file lacks is null, a flag that it lacks 1; rows without a date go."""
    raw = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, day("o_orderdate")).otherwise("unknown").alias("Release_Date"), F.col("o_orderpriority").alias("Marketing_Year"), F.col("o_totalprice").alias("Ending Stocks"))
    return readers.read_supply_flat(spark, csv(raw), {"stock": ("ending stocks",), "world": ("world stocks",)}).select("release_date", "marketing_year", "world", "stock", "is_wasde_release_day")


@query("s7_two_column", "SELECT o_orderdate::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1")
def s7(spark, d):
    x = monthly_total(spark, d)
    raw = x.select(day("date").alias("DATE"), F.col("total").cast("decimal(18,2)").cast("string").alias("VALUE")).unionByName(x.limit(5).select(day("date").alias("DATE"), F.lit(".").alias("VALUE")))
    return readers.read_two_column_csv(spark, csv(raw), "total", "1996-01-01")


def monthly_total(spark: SparkSession, d: str, day_: str = "o_orderdate") -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col(day_).cast("date").alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


MONTHS = "m AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(*)::DOUBLE AS orders FROM orders GROUP BY 1)"


def months(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d).select(F.trunc("date", "MM").alias("date"), "total", "orders")


@query("s8_month_sheet", f"WITH {MONTHS} SELECT date, orders FROM m")
def s8(spark, d):
    """The date column is found by its values, the number by a part of its name; the row of units goes."""
    m = months(spark, d)
    raw = m.select(F.lit("note").alias("Remark"), F.concat(F.year("date"), F.lit("M"), F.lpad(F.month("date"), 2, "0")).alias("Period"), F.format_number("total", 2).alias("Total value"), F.col("orders").cast("string").alias("Number of orders"))
    units = raw.limit(1).select(F.lit("").alias("Remark"), F.lit("month").alias("Period"), F.lit("USD").alias("Total value"), F.lit("n").alias("Number of orders"))
    return readers.read_month_sheet(spark, csv(raw.unionByName(units)), "orders", "orders")


@query("s9_series_by_id", f"WITH {MONTHS} SELECT date, total FROM m")
def s9(spark, d):
    """The wanted column is the 300th, named in the row above the header."""
    m = months(spark, d)
    pad = ",".join(["0"] * 298)
    body = m.select(F.date_diff("date", F.lit("1990-01-01")).alias("at"), F.concat_ws(",", day("date"), F.lit(pad), F.concat(F.lit('"'), F.format_number("total", 2), F.lit('"'))).alias("value"))
    head = spark.range(1).select(F.posexplode(F.array(*[F.lit(f"{a},{','.join(['x'] * 298)},{b}") for a, b in (("Series ID", "TOT.ALL"), ("Date", "Total"))])).alias("at", "value"))
    path = folder(spark)
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return readers.read_series_by_id(spark, path, "TOT.ALL", "total")


@query("s10_articles", "SELECT o_orderdate::DATE AS date, 'Order ' || o_orderkey AS title, 'http://x/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'x.example' ELSE 'Brazil' END AS source FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 11 <> 0")
def s10(spark, d):
    k = F.col("o_orderkey")
    article = F.struct(
        F.when(F.col("o_orderstatus") == "O", "German").otherwise("ENGLISH").alias("language"), F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" Order "), k)).alias("title"), F.concat(F.lit("http://x/"), k).alias("url"),
        F.when(k % 2 == 0, "x.example").otherwise("").alias("domain"), F.lit("Brazil").alias("sourcecountry"), day("o_orderdate", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
    )
    path = folder(spark)
    table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(50)).alias("g"), article.alias("a")).groupBy("g").agg(F.collect_list("a").alias("articles")).select("articles").repartition(50, "articles").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_articles_json(spark, path)


@query("s11_supply_json", "SELECT s_suppkey AS id, s_acctbal AS amount FROM supplier")
def s11(spark, d):
    """Bare lists, and lists under data, records or results in any case."""
    item = F.to_json(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("amount"))))
    lists = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 4).alias("g")).agg(item.alias("x"))
    name = F.element_at(F.array(*map(F.lit, ("dAtA", "RECORDS", "Results"))), F.greatest(F.lit(1), F.col("g").cast("int")))
    text = F.when(F.col("g") == 0, F.col("x")).otherwise(F.concat(F.lit('{"n": 1, "'), name, F.lit('": '), "x", F.lit("}")))
    path = folder(spark)
    lists.select(text.alias("value")).repartition(4, "value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_supply_json(spark, path, "id bigint, amount double")


@query("s12_internal_export", "SELECT p_partkey::VARCHAR AS item, p_retailprice::VARCHAR AS price FROM part")
def s12(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("품목"), F.col("p_retailprice").cast("string").alias("Unit Price"), F.lit("x").alias("other"))
    return readers.read_internal_export(spark, csv(raw), {"item": ("품목",), "price": ("Unit Price",)}, ["item", "price"])


# ---- writers


@query("k2_append_new", "SELECT o_orderkey, o_totalprice FROM orders")
def k2(spark, d):
    """Overlapping appends; stored keys stay as they are."""
    path, o = folder(spark), table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    writers.append_new_only(o.where("o_orderkey % 3 <> 0"), path, ["o_orderkey"])
    writers.append_new_only(o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).otherwise(-1.0)), path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("k4_reload", "SELECT c_custkey, c_acctbal FROM customer")
def k4(spark, d):
    path, c = folder(spark), table(spark, d, "customer").select("c_custkey", "c_acctbal")
    writers.reload(c.limit(7), path)
    writers.reload(c, path)
    return spark.read.parquet(path)


@query("k2_append_buckets", """WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '1-URGENT', o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM n WHERE k = 1""")
def k2_buckets(spark, d):
    """Urgent orders land first, then all others, then everything again; each customer's first row stays."""
    path, o = folder(spark), table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", F.col("o_orderkey").alias("seq"))
    for rows in (o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority <> '1-URGENT'"), o):
        tables.append_bucketed(rows.drop("o_orderpriority"), path, ["o_custkey"], "seq", buckets=16)
    return spark.read.parquet(path).drop(tables.BUCKET)


@query("k4_reload_versions", "SELECT c_custkey, c_acctbal, 2::BIGINT AS versions FROM customer WHERE c_custkey % 2 = 0")
def k4_versions(spark, d):
    """The second version replaces the first; a third that fails half-way changes nothing."""
    path, c = folder(spark), table(spark, d, "customer").select("c_custkey", "c_acctbal")
    tables.reload_version(c, path)
    tables.reload_version(c.where("c_custkey % 2 = 0"), path)
    try:
        tables.reload_version(c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 == 0, F.raise_error(F.lit("broken row"))).otherwise(F.col("c_acctbal"))), path)
    except Exception as e:
        if "broken row" not in str(e):
            raise
    return tables.current(spark, path).withColumn("versions", F.lit(len(tables.versions(spark, path))).cast("long"))


@query("k5_write_master", f"WITH {PX} SELECT series, strftime(date, '%Y-%m-%d') AS date, round(c, 4) AS price_close FROM px")
def k5(spark, d):
    path = folder(spark)
    writers.write_master(price(spark, d), path)
    return spark.read.schema("price_close double, date string, series string").parquet(path).select("series", "date", r("price_close", 4).alias("price_close"))


@query("k9_write_records", "SELECT n_nationkey::INTEGER AS n_nationkey, n_name, kind FROM nation, (VALUES ('csv'), ('json')) k(kind)")
def k9(spark, d):
    out, n = None, table(spark, d, "nation").select("n_nationkey", "n_name")
    for kind in ("csv", "json"):
        path = folder(spark)
        writers.write_records(n, path, kind)
        one = spark.read.schema("n_nationkey int, n_name string").format(kind).options(header=True).load(path).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


# ---- cleaning


@query("f5_f16_missing", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber NOT IN (1, 2) THEN l_quantity END AS number, nullif(l_discount, 0) AS discount, CASE WHEN l_discount <> 0 THEN round(l_quantity / l_discount, 6) END AS per FROM lineitem")
def f5(spark, d):
    n = F.col("l_linenumber")
    text = F.when(n == 1, " . ").when(n == 2, "NaN").otherwise(F.col("l_quantity").cast("string"))
    inf = F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.try_divide("l_quantity", "l_discount"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clean.parse_cot_number(text).alias("number"), clean.null_if_zero(F.col("l_discount")).alias("discount"), inf.alias("per"))
    return clean.clean_inf(x).withColumn("per", r("per"))


@query("f7_f8_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS due, strftime(o_orderdate, '%Y-%m-%d') AS \"order date\" FROM orders WHERE o_orderkey % 9 <> 0")
def f7(spark, d):
    """Date columns are found by name and by content; rows in which one does not parse go."""
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, day("o_orderdate", "yyyyMMdd")).otherwise(day("o_orderdate", "yyyy/MM/dd")).alias("due"), F.when(k % 9 == 0, "none").otherwise(day("o_orderdate")).alias("order date"), F.col("o_orderpriority").alias("priority"))
    found = clean.detect_date_columns(x)
    return clean.normalise_dates(x, found).select("o_orderkey", *found)


@query("f17_stock_to_use", "SELECT p_partkey, (p_partkey % 4 IN (1, 2)) AS stock_to_use FROM part")
def f17(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("Production", "Stocks-to-Use", "Ending Stock ratio", "Use"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", clean.is_stock_to_use(name).alias("stock_to_use"))


@query("f12_factors", "SELECT p_partkey, round(p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 22.0462::DOUBLE WHEN 1 THEN 1.10231::DOUBLE ELSE 6.2898::DOUBLE END, 9) AS usd FROM part")
def f12(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("soyoil", "soymeal", "wti"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", r(F.col("p_retailprice") * clean.usd_per_ton_factors()[name], 9).alias("usd"))


# ---- joins and limits


@query("j1_backbone", f"WITH {PX}, {FX} SELECT series, px.date, round(c, 4) AS price_close, round(x, 4) AS usd, CASE WHEN series = 'Brand#1' THEN 1::INTEGER END AS flag FROM px LEFT JOIN fx ON px.date = fx.date")
def j1(spark, d):
    px = price(spark, d)
    flag = px.where("series = 'Brand#1'").select("series", "date", F.lit(1).alias("flag"))
    fx = px.select("series", "date").join(exchange(spark, d).select("date", F.col("usd_brl_close").alias("usd")), "date")
    out = align.join_backbone(px, [fx, None, flag], features.KEYS)
    return out.select("series", "date", r("price_close", 4).alias("price_close"), r("usd", 4).alias("usd"), "flag")


@query("j9_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j9(spark, d):
    some = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return writers.anti_join(table(spark, d, "customer").select("c_custkey", "c_name"), some, ["c_custkey"])


@query("j13_enrich_panel", f"WITH {PX}, {FX} SELECT date, series AS commodity, round(c, 4) AS price_close, round(x, 4) AS usd FROM px JOIN fx USING (date)")
def j13(spark, d):
    panel = price(spark, d).withColumnRenamed("series", "commodity")
    master = exchange(spark, d).select("date", F.col("usd_brl_close").alias("usd"), F.lit(0.0).alias("price_close"))
    return features.enrich_panel(panel, master).select("date", "commodity", r("price_close", 4).alias("price_close"), r("usd", 4).alias("usd"))


@query("l1_l2_ends", "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS late, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS early FROM orders) SELECT o_custkey, o_orderkey, 'last' AS place FROM n WHERE late <= 3 UNION ALL SELECT o_custkey, o_orderkey, 'first' FROM n WHERE early <= 2 UNION ALL SELECT * FROM (SELECT o_custkey, o_orderkey, 'table' FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20)")
def l1(spark, d):
    o = table(spark, d, "orders")
    parts = [(align.last_rows(o, 3, ["o_orderdate", "o_orderkey"], ["o_custkey"]), "last"), (align.first_rows(o, 2, ["o_orderdate", "o_orderkey"], ["o_custkey"]), "first"), (align.last_rows(o, 20, ["o_totalprice", "o_orderkey"]), "table")]
    a, b, c = (x.select("o_custkey", "o_orderkey", F.lit(n).alias("place")) for x, n in parts)
    return align.in_order(a.unionByName(b).unionByName(c), "place", "o_custkey", "o_orderkey")


@query("l4_best_alpha", "WITH g AS (SELECT o_custkey AS series, (o_orderkey % 97) / 97.0::DOUBLE AS alpha, o_orderkey % 41 + 60.0::DOUBLE AS coverage, o_totalprice AS half_width FROM orders) SELECT series, alpha FROM g QUALIFY row_number() OVER (PARTITION BY series ORDER BY abs(coverage - 80), half_width, alpha) = 1")
def l4(spark, d):
    k = F.col("o_orderkey")
    grid = table(spark, d, "orders").select(F.col("o_custkey").alias("series"), ((k % 97) / F.lit(97.0)).alias("alpha"), (k % 41 + F.lit(60.0)).alias("coverage"), F.col("o_totalprice").alias("half_width"))
    return bands.best_alpha(grid)


# ---- quality

OHLC = "o AS (SELECT l_partkey, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE max(l_shipdate)::DATE END AS date, max(l_extendedprice) AS high, min(l_extendedprice) + CASE WHEN l_partkey % 7 = 0 THEN 200000 ELSE 0 END AS low, 1.0::DOUBLE AS open, min(l_extendedprice) - 5000 AS close FROM lineitem GROUP BY l_partkey)"


def ohlc(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").cast("date").alias("date"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.lit(1.0).alias("open"), (F.min("l_extendedprice") - 5000).alias("close"))
    return g.withColumns({"date": F.when(k % 10 != 0, F.col("date")), "low": F.col("low") + F.when(k % 7 == 0, 200000).otherwise(0)})


@query("q1_counts_of_a_write", f"""WITH {OHLC}, m AS (SELECT *, high < low AS a, least(open, high, low, close) <= 0 AS b FROM o)
 SELECT (NOT a AND NOT b) AS good, count(*) AS n, (SELECT count(*) FROM m WHERE a) AS high_below_low, (SELECT count(*) FROM m WHERE b) AS not_positive FROM m GROUP BY 1""")
def q1_write(spark, d):
    """Rows written by whether they break a rule; the rules are counted in the same scan."""
    path, rules = folder(spark), profile.ohlcv_rules()
    found = tables.write_checked(ohlc(spark, d), path, {n: rules[n] for n in ("high_below_low", "not_positive")})
    out = tables.checked_rows(spark, path).groupBy("good").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumns({n: F.lit(found[n]).cast("long") for n in ("high_below_low", "not_positive")})


@query("q1_ohlcv_counts", f"WITH {OHLC} SELECT count(*) FILTER (date IS NULL) AS no_date, count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive FROM o")
def q1(spark, d):
    return profile.ohlcv_counts(ohlc(spark, d))


@query("q2_good_and_bad", f"WITH {OHLC} SELECT l_partkey, high >= low AND least(open, high, low, close) > 0 AS good FROM o")
def q2(spark, d):
    good, bad = profile.quarantine(ohlc(spark, d))
    return good.select("l_partkey", F.lit(True).alias("good")).unionByName(bad.select("l_partkey", F.lit(False).alias("good")))


@query("q4_rejects", """SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 13 = 0 THEN 'context' END, CASE WHEN o_orderkey % 17 = 0 THEN 'stock' END, CASE WHEN o_orderkey % 3 = 0 THEN 'quantity' END, CASE WHEN o_orderkey % 5 = 0 THEN 'consumption' END, CASE WHEN o_orderkey % 7 = 0 THEN 'quantile order' END, CASE WHEN o_orderkey % 11 = 0 THEN 'unit' END], lambda x: x IS NOT NULL)::VARCHAR AS reasons
 FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0""")
def q4(spark, d):
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 3 != 0, 5.0).otherwise(0.0).alias("quantity_ton"), F.when(k % 5 != 0, 1.0).alias("monthly_consumption_ton"), F.lit(1.0).alias("p10"), F.lit(2.0).alias("p50"), F.when(k % 7 != 0, 3.0).otherwise(1.5).alias("p90"), F.when(k % 11 != 0, "cbot").otherwise("eur").alias("forecast_unit"),
        F.when(k % 13 != 0, 60.0).alias("current_price_cbot"), F.lit("2000-01-01").cast("date").alias("decision_date"), F.lit(1.0).alias("current_inventory_ton"), F.lit(0.0).alias("open_po_ton"), F.when(k % 17 != 0, 1.0).alias("safety_stock_ton"),
    )
    return profile.split_requests(x)[1].select("o_orderkey", F.concat(F.lit("["), F.array_join("reasons", ", "), F.lit("]")).alias("reasons"))


@query("a15_null_share", """WITH o AS (SELECT count(*)::DOUBLE AS n, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS a, count(CASE WHEN o_orderkey % 5 = 0 THEN 1 END) AS b, count(CASE WHEN o_orderkey % 7 = 0 THEN 1 END) AS f, count(CASE WHEN o_orderkey % 11 = 0 THEN 1 END) AS x FROM orders)
 SELECT 'price' AS grp, round((a / n + b / n) / 2, 9) AS null_share FROM o UNION ALL SELECT 'fx', round(f / n, 9) FROM o UNION ALL SELECT 'other', round(x / n / 2, 9) FROM o""")
def a15(spark, d):
    """Shares by prefixes of columns that have nulls."""
    gaps = {"price_close": 3, "price_lag": 5, "usd_brl_close": 7, "month": 11}
    x = table(spark, d, "orders").select("o_orderkey", *[F.when(F.col("o_orderkey") % n != 0, F.col("o_totalprice")).alias(c) for c, n in gaps.items()])
    return profile.group_null_share(profile.null_rates(x, ["o_orderkey", *gaps]), {"price": ["price_"], "fx": ["usd_", "fx_"]}).select("grp", r("null_share", 9).alias("null_share"))


# ---- plans

MASTER = f"""a AS ({B1_SQL}), z AS ({B17_SQL}), {{fx}}
 SELECT a.series, a.date, a.price_lag_30, a.price_to_ma14_ratio, a.return_14d, a.volatility_20d, z.price_vs_market_avg, z.cftc_percentile_52w, z.seasonal_adj_return_7d, z.price_above_200d_ma,
  round(f.x, 4) AS usd_brl_close, round(f.lag1, 4) AS usd_brl_lag_1, round(f.r7, 6) AS usd_brl_return_7d, round(o.orders, 0) AS orders_close, round(o.orders / lag(o.orders, 30) OVER w - 1, 6) AS orders_return_30d,
  round(lead(a.price_close, 28) OVER w, 4) AS target_price_t28, month(a.date)::INTEGER AS month, (isodow(a.date) = 5)::INTEGER AS is_cftc_release_day, 'v1' AS feature_version
 FROM a JOIN z ON a.series = z.series AND a.date = z.date LEFT JOIN f ON a.date = f.date ASOF LEFT JOIN o ON a.date >= o.date WINDOW w AS (PARTITION BY a.series ORDER BY a.date)"""


@query("b19_master_blocks", "WITH " + MASTER.format(fx=f"{FX}, f AS (SELECT date, x, lag(x) OVER (ORDER BY date) AS lag1, x / lag(x, 7) OVER (ORDER BY date) - 1 AS r7 FROM fx), o AS (SELECT date_trunc('month', o_orderdate)::DATE + 9 AS date, count(*)::DOUBLE AS orders FROM orders GROUP BY 1)"))
def b19(spark, d):
    """The master with a same-day block, two releases, one of them with a return after alignment, labels and calendar."""
    px, m = price(spark, d), monthly(spark, d)
    fx = features.market_block(exchange(spark, d), "usd_brl_close", "usd_brl").drop("series")
    same_day = px.select("series", "date").join(fx, "date")
    releases = [per_series(m.select("date", F.col("total").alias("cftc_noncomm_net")), px), per_series(m.select("date", F.col("orders").alias("orders_close")), px)]
    out = features.build_master(px, [same_day], releases, after=("orders_close",))
    digits = {"price_lag_30": 4, "price_to_ma14_ratio": 6, "return_14d": 6, "volatility_20d": 6, "price_vs_market_avg": 6, "cftc_percentile_52w": 6, "seasonal_adj_return_7d": 6, "usd_brl_close": 4, "usd_brl_lag_1": 4, "usd_brl_return_7d": 6, "orders_close": 0, "orders_return_30d": 6, "target_price_t28": 4}
    return rounded(out, [*features.KEYS, "price_above_200d_ma", "month", "is_cftc_release_day", "feature_version"], digits)


MARKET = f"WITH {PX}, i AS (SELECT *, c / lag(c) OVER w - 1 AS r FROM px WINDOW w AS (PARTITION BY series ORDER BY date)) SELECT series, date, round(c, 4) AS wti_close, round(lag(c) OVER w, 4) AS wti_lag_1, round(c / lag(c, 7) OVER w - 1, 6) AS wti_return_7d, CASE WHEN count(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) >= 5 THEN round(stddev_samp(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) END AS wti_volatility_14d FROM i WINDOW w AS (PARTITION BY series ORDER BY date)"


@query("b3_market", MARKET)
def b3(spark, d):
    """The block of crude, palm, dollar and canola: lag, return and volatility on a market's own dates."""
    out = features.market_block(price(spark, d).withColumnRenamed("price_close", "wti_close"), "wti_close", "wti")
    return rounded(out, features.KEYS, {"wti_close": 4, "wti_lag_1": 4, "wti_return_7d": 6, "wti_volatility_14d": 6})


@query("b8_spot", f"WITH {PX}, s AS (SELECT series, date_trunc('month', date)::DATE AS date, avg(c) * 1.1::DOUBLE AS spot FROM px GROUP BY 1, 2) SELECT px.series, px.date, round(spot, 4) AS spot_price_usd, round(c - spot, 4) AS basis FROM px ASOF LEFT JOIN s ON px.series = s.series AND px.date >= s.date")
def b8(spark, d):
    px = price(spark, d)
    spot = features.spot_block(px.select("series", "date", (F.col("price_close") * 1.1).alias("spot_price_usd")))
    out = features.build_master(px, releases=[spot])
    return rounded(out, features.KEYS, {"spot_price_usd": 4, "basis": 4})


SHIFT = 8766  # days: dates of orders to the years of the splits


@query("b20_splits", f"""WITH {PX}, l AS (SELECT series, date + {SHIFT} AS date, lag(c, 7) OVER w AS b, c / lag(c) OVER w - 1 AS r, count(c) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM px WINDOW w AS (PARTITION BY series ORDER BY date)),
 v AS (SELECT *, count(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS k FROM l)
 SELECT series AS commodity, CASE WHEN date <= DATE '2024-12-31' THEN 'train' WHEN date <= DATE '2025-09-30' THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM v WHERE b IS NOT NULL AND k >= 5 AND n >= 15 GROUP BY 1, 2""")
def b20(spark, d):
    px = price(spark, d).select(F.col("series").alias("commodity"), F.date_add("date", SHIFT).alias("date"), "price_close")
    return features.panel_features(px).groupBy("commodity", "split").agg(F.count(F.lit(1)).alias("n"))


@query("b21_return_panel", f"""WITH {PX}, l AS (SELECT *, lag(c, 7) OVER w AS b, c / lag(c) OVER w - 1 AS r, lead(c, 7) OVER w AS f, count(c) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM px WINDOW w AS (PARTITION BY series ORDER BY date)),
 v AS (SELECT *, count(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS k FROM l) SELECT series AS commodity, date, round(f / c - 1, 6) AS target_return, round(c / b - 1, 6) AS return_7d FROM v WHERE b IS NOT NULL AND f IS NOT NULL AND k >= 5 AND n >= 15""")
def b21(spark, d):
    out = features.return_panel(price(spark, d).withColumnRenamed("series", "commodity"))
    return rounded(out, ["commodity", "date"], {"target_return": 6, "return_7d": 6})


@query("n4_certainty", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS certainty FROM orders")
def n4(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("Reuters UK", "www.FT.com", "The Wall Street Journal", "blog"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", news.certainty(name).alias("certainty"))


@query("m1_time_split", f"WITH {PX} SELECT series, date, date >= DATE '1999-01-01' AS test FROM px")
def m1(spark, d):
    train, test = learn.time_split(price(spark, d), F.lit("1999-01-01").cast("date"))
    return train.select("series", "date", F.lit(False).alias("test")).unionByName(test.select("series", "date", F.lit(True).alias("test")))


CONTEXT = f"{PX}, h AS (SELECT series, date, c, CASE WHEN count(c) OVER w = 30 THEN avg(c) OVER w END AS a FROM px WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)), x AS (SELECT series, max(date) AS as_of_date, arg_max(c, date) AS c, max_by(coalesce(a, -1), date) AS a FROM h WHERE date <= DATE '2000-06-30' GROUP BY 1)"


def master(spark: SparkSession, d: str) -> DataFrame:
    return features.build_master(price(spark, d))


@query("d1_context", f"WITH {CONTEXT} SELECT series, as_of_date, round(c, 4) AS current_price_cbot, round(a, 4) AS market_avg_cbot, round(c * 22.0462, 3) AS current_price, round(a * 22.0462, 3) AS market_avg_price FROM x")
def d1(spark, d):
    out = decide.load_context(master(spark, d), F.lit("2000-06-30").cast("date"))
    return rounded(out, ["series", "as_of_date"], {"current_price_cbot": 4, "market_avg_cbot": 4, "current_price": 3, "market_avg_price": 3})


@query("d9_scenarios", f"""WITH {PX}, h AS (SELECT series, date, c FROM px),
 a AS (SELECT c_custkey, 'Brand#' || (c_custkey % 27 + 1) AS series, DATE '1994-12-01' + (c_custkey * 37 % 2600)::INTEGER AS decision_date, (c_custkey % 7) * 1000.0::DOUBLE + (c_custkey % 3) * 1000.0::DOUBLE AS e, 1000.0::DOUBLE * (c_custkey % 6 + 1) AS qty FROM customer),
 q AS (SELECT a.*, h.date AS as_of_date, c * 22.0462 AS p, (1000 + c_custkey % 5 * 700.0::DOUBLE) * 22.0462 AS m FROM a ASOF LEFT JOIN h ON a.series = h.series AND a.decision_date >= h.date),
 t AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN e < 3500 OR m > p * 1.03 THEN 'Buy' WHEN m < p * 0.97 THEN 'Wait' ELSE 'Split' END AS act, qty >= 2000 AND e >= 3500 AND e - 2000 >= 3500 AS can_wait FROM q)
 SELECT c_custkey, CASE WHEN act = 'Wait' AND NOT can_wait THEN 'Split' ELSE act END AS recommendation, decision_date, as_of_date, round(p, 3) AS current_price, CASE WHEN act IS NULL THEN 'context' END AS reasons FROM t""")
def d9(spark, d):
    """Every request as of its own date; those before their series begins, or of none, are rejected. By way of JSON documents."""
    k = F.col("c_custkey")
    own = requests(spark, d).drop("current_price_cbot", "market_avg_cbot").withColumns({"series": F.concat(F.lit("Brand#"), k % 27 + 1), "decision_date": F.date_add(F.lit("1994-12-01").cast("date"), (k * 37 % 2600).cast("int"))})
    mid = 1000 + (k % 5) * 700.0
    good, bad = decide.evaluate_scenarios(own.withColumns({"p50": mid, "p10": mid - 2, "p90": mid + 2}), master(spark, d))
    read = F.from_json("document", "c_custkey bigint, recommendation string, decision_date date, as_of_date date, current_price double")
    docs = decide.result_json(good).select(read.alias("x")).select("x.*").withColumn("reasons", F.lit(None).cast("string"))
    bad = bad.select("c_custkey", F.lit(None).cast("string").alias("recommendation"), "decision_date", "as_of_date", F.lit(None).cast("double").alias("current_price"), F.array_join("reasons", ",").alias("reasons"))
    return docs.unionByName(bad).withColumn("current_price", r("current_price", 3))


def mixed_requests(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of odd customers in USD a ton, market averages for every third."""
    odd, k = F.col("c_custkey") % 2 == 1, F.col("c_custkey")
    x = requests(spark, d).withColumn("market_avg_cbot", F.when(k % 3 == 0, F.col("current_price_cbot") * 0.98))
    return x.withColumns({q: F.when(odd, F.col(q) * 22.0462).otherwise(F.col(q)) for q in ("p10", "p50", "p90")} | {"forecast_unit": F.when(odd, "usd_per_ton").otherwise("cbot")})


@query("k6_log_decisions", f"""WITH {REQUESTS} SELECT DATE '2002-01-01' AS decision_date, round(p, 4) AS current_price, round(CASE WHEN c_custkey % 3 = 0 THEN price * 0.98::DOUBLE * 22.0462 END, 4) AS market_avg_price, round(lo, 4) AS p10, round(m, 4) AS p50, round(hi, 4) AS p90,
 inv AS current_inventory_ton, safety AS safety_stock_ton, q AS quantity_requested_ton, rec AS recommended_action, NULL::VARCHAR AS actual_action, NULL::DOUBLE AS quantity_actual_ton, NULL::VARCHAR AS reason_override, 2::BIGINT * (SELECT count(*) FROM customer) AS ids FROM z, range(2)""")
def k6(spark, d):
    """Recommendations logged twice, with an id for each, and read back."""
    path = folder(spark)
    for _ in range(2):
        decide.evaluate_scenarios(mixed_requests(spark, d), log=path)
    log = spark.read.parquet(path)
    ids = log.agg(F.countDistinct("id").alias("ids")).first()["ids"]
    money = {c: 4 for c in ("current_price", "market_avg_price", "p10", "p50", "p90")}
    return rounded(log.withColumn("ids", F.lit(ids).cast("long")), [c for c in log.columns if c not in (*money, "id", "created_at")] + ["ids"], money)


@query("f19_texts", f"""WITH {REQUESTS}, u AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN price * 0.98::DOUBLE * 22.0462 END AS avg30, CASE WHEN e < safety THEN 1 WHEN m > p * 1.03 THEN 2 WHEN act = 'Wait' AND NOT can_wait THEN 4 WHEN m < p * 0.97 THEN 3 ELSE 5 END AS code FROM z)
 SELECT c_custkey, 'futures ' || format('{{:,.0f}}', p) || ' USD/t (CBOT ' || format('{{:.2f}}', price) || ' x 22.05), 30-day average ' || coalesce(format('{{:,.0f}}', avg30) || ' USD/t', 'unknown') AS price_summary,
 'P10 ' || format('{{:,.0f}}', lo) || ' / P50 ' || format('{{:,.0f}}', m) || ' / P90 ' || format('{{:,.0f}}', hi) || ' USD/t' AS forecast_summary, 'in the low case (P10) the price may fall to ' || format('{{:,.0f}}', lo) || ' USD/t' AS risk_note,
 CASE WHEN c_custkey % 2 = 1 THEN 'forecast given in USD/t' ELSE 'CBOT quotes times 22.0462 are USD/t' END AS unit_note, 'futures ' || format('{{:,.0f}}', p) || ' USD/t, expected after 50 days (P50) ' || format('{{:,.0f}}', m) || ' USD/t' AS summary,
 CASE code WHEN 1 THEN 'Buy: inventory ' || format('{{:.0f}}', e) || ' t is below safety stock 3500 t' WHEN 2 THEN 'Buy: expected price ' || format('{{:,.0f}}', m) || ' USD/t is ' || format('{{:.2f}}', (m - p) / p * 100) || ' % above ' || format('{{:,.0f}}', p)
  WHEN 3 THEN 'Wait: expected price ' || format('{{:,.0f}}', m) || ' USD/t is ' || format('{{:.2f}}', abs((m - p) / p * 100)) || ' % below ' || format('{{:,.0f}}', p) WHEN 4 THEN 'Split: the price says wait, but stock would fall below safety stock' ELSE 'Split: expected price is within 3 % of the current price' END AS reason,
 'stock ' || format('{{:.0f}}', inv) || ' + open orders ' || format('{{:.0f}}', po) || ' = ' || format('{{:.0f}}', e) || ' t; when due ' || format('{{:.0f}}', due) || ' t; safety 3500 t' AS inventory_status,
 'today ' || format('{{:.0f}}', q / 2) || ' t and after 7 days ' || format('{{:.0f}}', q / 2) || ' t, both due 2002-02-20' AS split_plan, CASE WHEN e + q > 4800 THEN 'stock after delivery ' || format('{{:.0f}}', e + q) || ' t is above warehouse cap 4800 t' ELSE '' END AS warnings FROM u""")
def f19(spark, d):
    """The readable part of each nested result."""
    docs = decide.result_document(decide.evaluate_scenarios(mixed_requests(spark, d))[0], ["c_custkey"])
    names = {"current_price_summary": "price_summary", "forecast_summary": "forecast_summary", "risk_note": "risk_note", "forecast_unit": "unit_note", "summary": "summary", "reason": "reason", "inventory_status": "inventory_status", "split_plan": "split_plan"}
    return docs.select("c_custkey", *[F.col(f"human_readable.{k}").alias(n) for k, n in names.items()], F.array_join("human_readable.constraint_warnings", "; ").alias("warnings"))


@query("t2_news_stream", "SELECT 'u' || o_custkey AS url, min(CASE WHEN o_custkey % 2 = 0 THEN 'policy' ELSE 'weather' END) AS category, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def t2(spark, d):
    """A stream of articles, scored and landed by URL, each once."""
    k, landed, src = F.col("o_custkey"), folder(spark), folder(spark)
    x = table(spark, d, "orders").select(F.concat(F.lit("u"), k).alias("url"), F.when(k % 2 == 0, "Biodiesel mandate").otherwise("Drought in Brazil").alias("title"), F.lit("blog").alias("source"), F.timestamp_seconds(F.lit(1_600_000_000)).alias("seen_at"))
    x.write.parquet(src)
    stream = landing.file_stream(spark, src, "url string, title string, source string, seen_at timestamp")
    landing.land_news(stream, landed, f"{landed}-checkpoint").awaitTermination()
    return spark.read.parquet(landed).groupBy("url", "category").agg(F.count(F.lit(1)).alias("n"))


@query("t3_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t3(spark, d):
    out = landing.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return out.withColumn("total", r("total", 4))


#: Events come in three batches by time; every seventh comes a batch late, every eleventh two.
LATE = """b AS (SELECT event_id, event_type, value, ts, least(3, ntile(3) OVER (ORDER BY ts, event_id) + CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS batch FROM events),
 m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM b GROUP BY batch)"""


@query("t4_late_rows", f"""WITH {LATE} SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM b JOIN m USING (batch)
 WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""")
def t4(spark, d):
    """A stream of three batches with late rows: those behind the watermark are dropped, the others counted; state outlives the runs."""
    x = table(spark, d, "events").select("event_id", "event_type", "value", "ts")
    # thirds by time; only ids and times are numbered in one task here, to make the input
    third = x.select("event_id", F.ntile(3).over(Window.orderBy("ts", "event_id")).alias("third"))
    late = F.when(F.col("event_id") % 11 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    x = x.join(third, "event_id").withColumn("batch", F.least(F.lit(3), F.col("third") + late)).drop("third")
    src, out = folder(spark), folder(spark)
    for i in (1, 2, 3):
        x.where(F.col("batch") == i).drop("batch").write.mode("append").parquet(src)
        stream = landing.file_stream(spark, src, "event_id bigint, event_type string, value double, ts timestamp", files=1_000_000)
        landing.windowed_counts_stream(stream, out, f"{out}-checkpoint", "ts", "event_type", "value", delay="2 days").awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(out).withColumn("total", r("total", 4))


@query("m12_folds", f"""WITH {PX}, w AS (SELECT series, date, c, {', '.join(f'lag(c, {n}) OVER w AS l{n}' for n in (1, 14))}, lead(c, 7) OVER w AS f, stddev_samp(g) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM (SELECT *, c / lag(c) OVER (PARTITION BY series ORDER BY date) - 1 AS g FROM px) WINDOW w AS (PARTITION BY series ORDER BY date)),
 n AS (SELECT count(*) AS n FROM w WHERE l14 IS NOT NULL AND f IS NOT NULL AND v IS NOT NULL) SELECT i::INTEGER AS fold, 6000::BIGINT + 2000 * i AS n_train, 2000::BIGINT AS n_test FROM n, range(0, 100000) x(i) WHERE i < (n - 6000) // 2000""")
def m12(spark, d):
    """Sizes of the expanding folds of the pooled training table, from the scored rows."""
    scored = folds.walk_forward_logistic(training(spark, d), MODEL, "target_updown_t7", 6000, 2000)
    each = scored.where("probability_up > 0 AND probability_up < 1").groupBy("fold").agg(F.min("row_no").alias("n_train"), F.count(F.lit(1)).alias("n_test"))
    return each.select("fold", "n_train", "n_test")


@query("m12_walk_forward")
def m12_auc(spark, d):
    """AUC and accuracy of each fold; all folds are fitted together. The tests hold it against a fit a fold."""
    scored = folds.walk_forward_logistic(training(spark, d), MODEL, "target_updown_t7", 6000, 2000)
    return learn.fold_summary(scored.select("fold", "probability_up", "target_updown_t7"), "target_updown_t7")


@query("m8_auc_whole", "WITH r AS (SELECT (l_discount > 0.05)::INTEGER AS y, row_number() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS o, rank() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_extendedprice) AS t FROM lineitem) SELECT round((sum((k + (t - 1) / 2.0) * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 8) AS auc FROM r")
def m8(spark, d):
    """Ranks over many distinct scores, cut in ranges."""
    x = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_discount") > 0.05).cast("int").alias("y"))
    return learn.auc(x, "l_extendedprice", "y", []).select(r("auc", 8).alias("auc"))



