"""Readers of landed files and table scans. File readers take a path that Spark can read."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import parse_cot_number, parse_date, parse_date_two_pass, parse_month_code, parse_price, parse_volume, release_from_report
from ..operators.profile import require_columns

# Header names of vendors and internal systems, the positions of the positioning report.
OHLCV_NAMES = {"date": ("date", "datetime", "time"), "close": ("close", "price", "last", "adj close", "adj. close"), "open": ("open",), "high": ("high",), "low": ("low",), "volume": ("volume", "vol.", "vol")}
SUPPLY_HEADERS = ("commodity_description", "country_name", "market_year", "calendar_year", "month", "attribute_description", "value")
COT_MARKET, COT_DATE, COT_LONG, COT_SHORT, COT_FIELDS = 0, 2, 8, 9, 10


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _line_order() -> Column:
    """Where a line stands: by file name, part of the file, and place in the part."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))


def read_series(df: DataFrame, value: str, series: str | None = None, by: str = "commodity", date: str = "date", fallback: bool = False) -> DataFrame:
    """(date, value) of one series; with fallback, of all rows if none has that name, which a scan of the names finds first."""
    if series is None:
        return df.select(date, value)
    hit = F.coalesce(F.col(by) == series, F.lit(False))
    if not fallback:
        return df.where(hit).select(date, value)
    found = df.agg(F.coalesce(F.max(hit), F.lit(False)).alias("_any"))
    return df.join(F.broadcast(found)).where(hit | ~F.col("_any")).select(date, value)


def _named(df: DataFrame, aliases: Mapping[str, tuple[str, ...]]) -> dict[str, str]:
    low = {c.strip().strip('"').lower(): c for c in reversed(df.columns)}
    return {name: low[a] for name, names in aliases.items() for a in [next((n for n in names if n in low), None)] if a}


def read_vendor_ohlcv(spark: SparkSession, path: str, commodity: str, multi_line: bool = False) -> DataFrame:
    """Daily prices from a delimited export, headers by alias. The date column has such a name, else holds `date` or ends in `time`,
    else is the first. A missing price column is an error; a missing volume is null. multi_line: for line breaks inside quotes; a file is one task then."""
    raw = spark.read.csv(path, header=True, multiLine=multi_line)
    found = _named(raw, OHLCV_NAMES)
    require = [n for n in ("open", "high", "low", "close") if n not in found]
    if require:
        raise ValueError(f"missing columns: {require}")
    dated = next((c for c in raw.columns if "date" in c.lower() or c.lower().strip().endswith("time")), raw.columns[0])
    date = parse_date_two_pass(_q(found.get("date", dated)))
    prices = [parse_price(_q(found[n])).alias(n) for n in ("open", "high", "low", "close")]
    volume = parse_volume(_q(found["volume"])) if "volume" in found else F.lit(None).cast("double")
    return raw.select(date.alias("date"), *prices, volume.alias("volume"), F.lit(commodity).alias("commodity")).where(F.col("date").isNotNull())


def read_cot_text(spark: SparkSession, path: str, market: str) -> DataFrame:
    """Positions from a headerless report: rows of at least ten fields whose market contains the text, in any case."""
    names = ", ".join(f"c{i} string" for i in range(COT_FIELDS))
    raw = spark.read.csv(path, schema=names, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = raw.where(F.upper(f"c{COT_MARKET}").contains(market.upper()))
    day = parse_date(F.col(f"c{COT_DATE}"), "yyyy-MM-dd", "yyMMdd", "M/d/yyyy")
    long, short = parse_cot_number(F.col(f"c{COT_LONG}")), parse_cot_number(F.col(f"c{COT_SHORT}"))
    out = rows.select(day.alias("report_date"), release_from_report(day).alias("release_date"), long.alias("noncomm_long"), short.alias("noncomm_short"), (long - short).alias("noncomm_net"))
    return out.dropna()


def read_supply_bulk(spark: SparkSession, path: str, commodities: Iterable[str], first_year: int = 2010) -> DataFrame:
    """Long attribute rows of some commodities from a calendar year on; any header case. Splits take the place of chunks."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    require_columns(raw, list(SUPPLY_HEADERS))
    rows = raw.select(*[F.trim(c).alias(c) for c in SUPPLY_HEADERS]).where(F.col("commodity_description").isin(*commodities))
    rows = rows.withColumns({c: F.col(c).try_cast("int") for c in ("calendar_year", "month")} | {"value": parse_price(F.col("value"))})
    return rows.where(F.col("calendar_year") >= first_year)


def read_supply_flat(spark: SparkSession, path: str, aliases: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """One row per release: release_date, aliased optional numbers (null if absent), and the release flag (1 if absent)."""
    raw = spark.read.csv(path, header=True)
    found = _named(raw, {"release_date": ("release_date",), "is_wasde_release_day": ("is_wasde_release_day",), "marketing_year": ("marketing_year",), **aliases})
    if "release_date" not in found:
        raise ValueError("missing columns: ['release_date']")
    numbers = [(parse_price(_q(found[n])) if n in found else F.lit(None).cast("double")).alias(n) for n in aliases]
    flag = F.coalesce(_q(found["is_wasde_release_day"]).try_cast("int"), F.lit(1)) if "is_wasde_release_day" in found else F.lit(1)
    year = _q(found["marketing_year"]) if "marketing_year" in found else F.lit(None).cast("string")
    out = raw.select(parse_date(_q(found["release_date"]), "yyyy-MM-dd", "M/d/yyyy").alias("release_date"), year.alias("marketing_year"), *numbers, flag.alias("is_wasde_release_day"))
    return out.where(F.col("release_date").isNotNull())


def read_two_column_csv(spark: SparkSession, path: str, name: str, start: str = "1900-01-01") -> DataFrame:
    """(date, value) by position; bad rows go; of equal dates the last line stays."""
    raw = spark.read.csv(path, schema="d string, v string").withColumn("_seq", _line_order())
    rows = raw.select(parse_date(F.col("d"), "yyyy-MM-dd", "M/d/yyyy").alias("date"), parse_cot_number(F.col("v")).alias(name), "_seq").dropna().where(F.col("date") >= F.lit(start).cast("date"))
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("_seq")))).where("_n = 1")
    return last.select("date", name)


def read_month_sheet(spark: SparkSession, path: str, column: str, name: str, start: str = "1900-01-01") -> DataFrame:
    """(date, value) of a wide monthly table. The date column is the first that parses in half of its rows; the value column
    has the name, else contains it; rows without a date, such as units, go."""
    raw = spark.read.csv(path, header=True)
    cols = raw.columns
    rates = raw.agg(*[F.avg(parse_month_code(_q(c)).isNotNull().cast("double")).alias(f"r{i}") for i, c in enumerate(cols)]).first()
    dated = next((c for c, r in zip(cols, rates) if r is not None and r >= 0.5), None)
    low = column.strip().lower()
    value = next((c for c in cols if c.strip().lower() == low), None) or next((c for c in cols if low in c.lower()), None)
    if dated is None or value is None:
        raise ValueError(f"no date column or no column {column!r}")
    out = raw.select(parse_month_code(_q(dated)).alias("date"), parse_price(_q(value)).alias(name), _line_order().alias("seq")).dropna(subset=["date", name])
    return out.where(F.col("date") >= F.lit(start).cast("date")).groupBy("date").agg(F.max_by(name, "seq").alias(name))  # of equal dates the last line


def read_series_by_id(spark: SparkSession, path: str, series_id: str, name: str) -> DataFrame:
    """(date, value) of the column that carries an id in the key row; the header is in the row below it."""
    lines = spark.read.text(path).withColumn("_seq", F.monotonically_increasing_id())
    cells = F.regexp_extract_all("value", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    arr = lines.select("_seq", F.transform(cells, lambda x: F.trim(F.regexp_replace(x, '^"|"$', ""))).alias("a"))
    key = arr.where(F.array_contains("a", series_id)).orderBy("_seq").select("_seq", F.array_position("a", series_id).alias("at")).first()
    if key is None:
        raise ValueError(f"no series {series_id!r}")
    rows = arr.where(F.col("_seq") > key["_seq"]).select(parse_month_code(F.element_at("a", 1)).alias("date"), parse_price(F.element_at("a", int(key["at"]))).alias(name))
    return rows.dropna()


def read_articles_json(spark: SparkSession, path: str, language: str = "English") -> DataFrame:
    """(date, title, url, source) of the articles in a language that have a title and a URL."""
    schema = "articles array<struct<language: string, title: string, url: string, domain: string, sourcecountry: string, seendate: string>>"
    a = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("articles").alias("a")).select("a.*")
    rows = a.where((F.lower("language") == language.lower()) & (F.trim("title") != "") & (F.trim("url") != ""))
    source = F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.col("sourcecountry"))
    return rows.select(parse_date(F.substring("seendate", 1, 8), "yyyyMMdd").alias("date"), F.trim("title").alias("title"), F.trim("url").alias("url"), source.alias("source"))


def read_records(spark: SparkSession, path: str, under: Iterable[str] = ("data", "records", "results")) -> DataFrame:
    """(record variant) of JSON files of any shape: records stand bare in a list or under one of the names, in any case.

    A file is parsed once; records of one file may differ in fields and nesting. Files that are no JSON, or that have no such
    list, give no record.
    """
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    fields = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))

    def list_under(name: str) -> Column:
        return F.try_variant_get(F.get(F.filter(fields, lambda x: F.lower(x["key"]) == name), 0)["value"], "$", "array<variant>")

    return text.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *map(list_under, under))).alias("record"))


def record_fields(records: DataFrame, fields: Mapping[str, tuple[str, ...]], record: str = "record") -> DataFrame:
    """Columns out of a variant: name -> (type, path, further paths). The first path that has a value of the type counts;
    what is absent or does not convert is null."""
    return records.select(*[F.coalesce(*[F.try_variant_get(record, p, kind) for p in paths]).alias(name) for name, (kind, *paths) in fields.items()])


def record_schema(records: DataFrame, record: str = "record") -> str:
    """The one type that holds all records, as text; counted over all of them with partial aggregates."""
    return records.agg(F.schema_of_variant_agg(record)).first()[0]


def read_supply_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records that stand bare in a list or under data, records or results, in any case, by the fields of a schema."""
    wanted = spark.createDataFrame([], schema).schema
    return record_fields(read_records(spark, path), {f.name: (f.dataType.simpleString(), f"$['{f.name}']") for f in wanted})


def read_or_empty(read: Callable[[str], DataFrame], path: str, schema: str, spark: SparkSession) -> DataFrame:
    """What read(path) gives, or no rows and a warning if there is no such file."""
    try:
        return read(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no file {path}", stacklevel=2)
        return spark.createDataFrame([], schema)


def read_internal_export(spark: SparkSession, path: str, columns: Mapping[str, Iterable[str]], required: Iterable[str]) -> DataFrame:
    """Export with Korean or English headers under the library's names; missing required ones are an error."""
    raw = spark.read.csv(path, header=True)
    found = _named(raw, {k: (k, *[v.lower() for v in vs]) for k, vs in columns.items()})
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return raw.select(*[_q(c).alias(n) for n, c in found.items()])
