"""Cleaning of landed text and arithmetic that respects missing values. Every function maps columns to a column.

Missing is null, never NaN. Text that does not parse becomes null; a zero divisor makes a quotient null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Factors to USD per metric ton, crush yields, contract type names.
USD_PER_TON = {"soyoil": 22.0462, "soymeal": 1.10231, "soybean": 36.744 / 100.0, "wti": 6.2898, "canola": 0.7285 * 1.10231, "palm": 1.0}
CRUSH_OIL, CRUSH_MEAL = 0.179, 0.765
SPOT_NAMES = ("spot", "현물")
FORWARD_NAMES = ("forward", "fwd", "futures", "선물")


def _bare(c: Column) -> Column:
    return F.translate(c.cast("string"), "\"'\u00a0, \t\n\x0b\f\r", "")


def parse_price(c: Column) -> Column:
    """Double from text with quotes, thousands separators or blanks; dashes and empty text are null."""
    return _number(_bare(c))


def _number(bare: Column) -> Column:
    """Dashes and empty text are no numbers, NaN is replaced; the text is looked at once."""
    return F.nanvl(bare.try_cast("double"), F.lit(None).cast("double"))


def parse_volume(c: Column) -> Column:
    """As parse_price, with K, M and B for thousands, millions and thousand millions."""
    bare = F.upper(_bare(c))
    unit = F.right(bare, F.lit(1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return _number(F.when(unit.isin("K", "M", "B"), F.left(bare, F.length(bare) - 1)).otherwise(bare)) * factor


def parse_date(c: Column, *formats: str) -> Column:
    """Date by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c.cast("string")), F.lit(f)).cast("date") for f in formats or ("yyyy-MM-dd",)])


def parse_date_two_pass(c: Column) -> Column:
    """Month first; what fails, day first; what fails again, ISO."""
    return parse_date(c, "M/d/yyyy", "d/M/yyyy", "yyyy-MM-dd")


def parse_month_code(c: Column) -> Column:
    """First of the month of 1960M01 or of any date."""
    text = F.trim(c.cast("string"))
    year, month = (F.nullif(F.regexp_extract(text, r"^(\d{4})[Mm](\d{1,2})$", i), F.lit("")).try_cast("int") for i in (1, 2))
    coded = F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return F.coalesce(coded, F.trunc(parse_date(text, "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "yyyy-MM"), "MM"))


def parse_cot_number(c: Column) -> Column:
    """Double; a lone point, blanks and NaN are null."""
    bare = F.trim(c.cast("string"))
    return parse_price(F.when(bare == ".", None).otherwise(bare))


def normalise_contract_type(c: Column) -> Column:
    name = F.lower(F.trim(c))
    return F.when(name.isin(*SPOT_NAMES), "spot").when(name.isin(*FORWARD_NAMES), "forward").otherwise("other")


def iso_date(c: Column) -> Column:
    """ISO text of a date in one of the usual forms; empty if there is none."""
    return F.coalesce(F.date_format(parse_date(c, "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "M/d/yyyy"), "yyyy-MM-dd"), F.lit(""))


def normalise_dates(df: DataFrame, cols: list[str]) -> DataFrame:
    """cols as ISO text; rows in which one has no date go."""
    out = df.withColumns({c: iso_date(F.col(c)) for c in cols})
    for c in cols:
        out = out.where(F.length(c) >= 10)
    return out


def detect_date_columns(df: DataFrame, sample: int = 20) -> list[str]:
    """String columns named like a date, or of which at least half (and three) of the first values parse as dates."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    known = [n for n in names if "date" in n.lower() or "일자" in n or "날짜" in n]
    rest = [n for n in names if n not in known]
    if rest:
        head = df.select(*rest).limit(sample)
        row = head.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(iso_date(F.col(n)) != "", 1)).alias(n) for n in rest]).first()
        known += [n for n in rest if row[n] >= max(3, row["n"] / 2)]
    return [n for n in names if n in known]


def marketing_year_key(c: Column) -> Column:
    """Sort key of a marketing year: the number, else its four leading digits, else what stands before a slash."""
    text = F.trim(c.cast("string"))
    lead = F.nullif(F.regexp_extract(text, r"^(\d{4})", 1), F.lit(""))
    return F.coalesce(F.when(text.rlike(r"^\d+$"), text).try_cast("double"), lead.try_cast("double"), F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.lit(-1e9))


def release_from_report(d: Column, days: int = 3) -> Column:
    return F.date_add(d, days)


def infer_release(df: DataFrame, known: DataFrame, year: str, month: str, day: int = 12) -> DataFrame:
    """df with release_date: the first known release in that month, else a fixed day of it. known: (release_date)."""
    first = known.groupBy(F.year("release_date").alias("_y"), F.month("release_date").alias("_m")).agg(F.min("release_date").alias("_first"))
    out = df.join(first, (F.col(year) == F.col("_y")) & (F.col(month) == F.col("_m")), "left")
    return out.withColumn("release_date", F.coalesce("_first", F.make_date(F.col(year), F.col(month), F.lit(day)))).drop("_y", "_m", "_first")


def to_usd_per_ton(c: Column, commodity: str) -> Column:
    return c * F.lit(USD_PER_TON[commodity])


def usd_per_ton_factors() -> Column:
    """Map from commodity to factor, for a column of commodities."""
    return F.create_map(*[F.lit(x) for kv in USD_PER_TON.items() for x in kv])


def crush_spread(oil: Column, meal: Column, beans: Column) -> Column:
    """Value of oil and meal from a ton of beans, less the beans; all in USD per ton."""
    return oil * CRUSH_OIL + meal * CRUSH_MEAL - beans


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def null_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def clean_inf(df: DataFrame) -> DataFrame:
    """Infinite and NaN doubles become null in every column."""
    bad = {f.name: F.when(F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf")), None).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(bad) if bad else df


def is_production(name: Column) -> Column:
    text = F.lower(name)
    return text.contains("production") & ~text.contains("oil") & ~text.contains("meal")


def is_stock_to_use(name: Column) -> Column:
    text = F.lower(name)
    return (text.contains("stock") & text.contains("use")) | (text.contains("ratio") & text.contains("stock"))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def as_json(*cols: Column | str) -> Column:
    return F.to_json(F.struct(*cols))
