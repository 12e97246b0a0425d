"""Calendar features as closed forms of a date column; no loops over calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP = 30


def parts(d: Column) -> dict[str, Column]:
    return {"month": F.month(d), "quarter": F.quarter(d), "week_of_year": F.weekofyear(d)}


def season_flags(d: Column) -> dict[str, Column]:
    m = F.month(d)
    return {"is_planting_season": m.isin(9, 10, 11).cast("int"), "is_flowering_season": m.isin(1, 2).cast("int"), "is_harvest_season": m.isin(3, 4, 5).cast("int")}


def days_to_next_harvest(d: Column) -> Column:
    """Days to the next 1 March, 0 on the day."""
    y = F.year(d)
    this = F.make_date(y, F.lit(3), F.lit(1))
    return F.datediff(F.when(d <= this, this).otherwise(F.make_date(y + 1, F.lit(3), F.lit(1))), d)


def second_tuesday(d: Column) -> Column:
    """Second Tuesday of the month of d."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "MM"), 1), "TU"), 7)


def is_release_day(d: Column) -> Column:
    return (d == second_tuesday(d)).cast("int")


def is_release_week(d: Column) -> Column:
    """Whether the week from Monday to Sunday holds a second Tuesday."""
    tuesday = F.date_add(F.date_trunc("week", d).cast("date"), 1)
    return F.day(tuesday).between(8, 14).cast("int")


def weekdays_until(d: Column) -> Column:
    """Number of Mondays to Fridays from 1970-01-05 to d, d included."""
    days = F.datediff(d, F.lit("1970-01-05").cast("date"))
    return (F.floor(days / 7) * 5 + F.least(F.weekday(d) + 1, F.lit(5))).cast("int")


def busdays_between(a: Column, b: Column) -> Column:
    """Mondays to Fridays in (a, b]; 0 if b is not after a. Holidays count."""
    return F.greatest(F.lit(0), weekdays_until(b) - weekdays_until(a))


def days_to_release(d: Column) -> Column:
    this = second_tuesday(d)
    coming = F.when(d <= this, this).otherwise(second_tuesday(F.add_months(d, 1)))
    return F.least(F.lit(CAP), busdays_between(d, coming))


def days_since_release(d: Column) -> Column:
    this = second_tuesday(d)
    past = F.when(d >= this, this).otherwise(second_tuesday(F.add_months(d, -1)))
    return F.least(F.lit(CAP), busdays_between(past, d))


def weekly_release(d: Column) -> dict[str, Column]:
    """Flag of Fridays and days to the next one."""
    return {"is_cftc_release_day": (F.weekday(d) == 4).cast("int"), "days_to_cftc": F.pmod(F.lit(4) - F.weekday(d), F.lit(7)).cast("int")}


def season_features(d: Column) -> dict[str, Column]:
    return parts(d) | season_flags(d) | {"days_to_next_harvest": days_to_next_harvest(d)}


def event_features(d: Column) -> dict[str, Column]:
    return {"is_wasde_week": is_release_week(d), "wasde_release_day": is_release_day(d), "days_to_wasde": days_to_release(d), "days_since_wasde": days_since_release(d)} | weekly_release(d)


def calendar_expand(df: DataFrame, keys: list[str], date: str, fill: list[str], flag: str = "is_interpolated") -> DataFrame:
    """One row per key and calendar day from the first to the last; fill's columns carried forward, missing days flagged.

    The first of fill decides whether a day is missing. Days before the first value go.
    """
    from ..operators.rolling import forward_fill, ordered

    ends = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(date))
    out = days.join(df, [*keys, date], "left").withColumn(flag, F.col(fill[0]).isNull().cast("int"))
    w = ordered(keys, date)
    return out.withColumns({c: forward_fill(F.col(c), w) for c in fill}).where(F.col(fill[0]).isNotNull())


def month_gaps(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """(keys, month) of the months between first and last that have no row."""
    have = df.select(*keys, F.trunc(date, "MM").alias("month")).distinct()
    ends = have.groupBy(*keys).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    every = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("month"))
    return every.join(have, [*keys, "month"], "left_anti")
