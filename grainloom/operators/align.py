"""Alignment of releases to the trading days of a backbone, and other joins in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import forward_fill, ordered


def align_exact_ffill(release: DataFrame, backbone: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Values joined on exact dates, then each column carried forward; a release on a day that the backbone lacks is lost."""
    cols = [c for c in release.columns if c not in (*keys, date)]
    w = ordered(keys, date)
    return backbone.join(release, [*keys, date], "left").withColumns({c: forward_fill(F.col(c), w) for c in cols})


def asof_events(release: DataFrame, backbone: DataFrame, keys: list[str], date: str) -> tuple[DataFrame, list[str]]:
    """Both tables in one, releases (_side 0) before the backbone's rows (_side 1) of a date; and the columns to carry."""
    cols = [c for c in release.columns if c not in (*keys, date)]
    own = [c for c in backbone.columns if c not in (*keys, date)]
    left = release.select(*keys, date, *cols, *[F.lit(None).cast(backbone.schema[c].dataType).alias(c) for c in own], F.lit(0).alias("_side"))
    right = backbone.select(*keys, date, *[F.lit(None).cast(release.schema[c].dataType).alias(c) for c in cols], *own, F.lit(1).alias("_side"))
    return left.unionByName(right), cols


def align_asof(release: DataFrame, backbone: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """For each backbone row the last value of each column released on or before its date.

    Both sides meet in one shuffle by key and one sort; there is no inequality join.
    """
    return align_asof_all([release], backbone, keys, date)


def align_asof_all(releases: list[DataFrame], backbone: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """align_asof of several releases, whose columns differ: all of them meet the backbone in one shuffle and one sort."""
    if not releases:
        return backbone
    fields = {f.name: f.dataType for df in (backbone, *releases) for f in df.schema if f.name not in (*keys, date)}
    cols = [c for df in releases for c in df.columns if c not in (*keys, date)]

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(*keys, date, *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items()], F.lit(n).alias("_side"))

    events = reduce(DataFrame.unionByName, [*[side(r, 0) for r in releases], side(backbone, 1)])
    w = Window.partitionBy(*keys).orderBy(date, "_side")
    return events.withColumns({c: forward_fill(F.col(c), w) for c in cols}).where("_side = 1").select(*backbone.columns, *cols)


def join_backbone(base: DataFrame, parts: list[DataFrame | None], keys: list[str]) -> DataFrame:
    """Left joins of the parts on the same keys; absent parts are skipped."""
    return reduce(lambda a, b: a.join(b, keys, "left"), [p for p in parts if p is not None], base)


def inner_join(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys), parts)


def lookup(df: DataFrame, table: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Left join to a table that must have one row per key."""
    if check and table.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"several rows for a key of {keys}")
    return df.join(table, keys, "left")


def value_ahead(df: DataFrame, value: str, keys: list[str], index: str, n: int, name: str) -> DataFrame:
    """The value at index + n of the same series, null if that row is missing."""
    later = df.select(*keys, (F.col(index) - n).alias(index), F.col(value).alias(name))
    return df.join(later, [*keys, index], "left")


def merge_metrics(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of one metric per table on keys: one shuffle for all of them."""
    rows = [p.select(*keys, *[(F.col(n) if n == m else F.lit(None).cast("double")).alias(m) for m in parts]) for n, p in parts.items()]
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(*[F.first(m, ignorenulls=True).alias(m) for m in parts])


def last_rows(df: DataFrame, n: int, order: list[str], keys: list[str] = ()) -> DataFrame:
    """The last n rows in an order, of each key or of the table."""
    return _ends(df, n, [F.desc(c) for c in order], keys)


def first_rows(df: DataFrame, n: int, order: list[str], keys: list[str] = ()) -> DataFrame:
    """The first n rows in an order, of each key or of the table."""
    return _ends(df, n, [F.asc(c) for c in order], keys)


def _ends(df: DataFrame, n: int, order: list[Column], keys: list[str]) -> DataFrame:
    if not keys:
        return df.orderBy(*order).limit(n)  # the best n of each task, then of those
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Rows sorted by several columns, for output; no step of the library relies on an order."""
    return df.orderBy(*columns)


def latest_asof(df: DataFrame, series: str, as_of: Column | None = None, date: str = "date") -> DataFrame:
    """The last row of each series on or before a date, or its last row."""
    rows = df if as_of is None else df.where(F.col(date) <= as_of)
    rest = [c for c in df.columns if c != series]
    return rows.groupBy(series).agg(F.max_by(F.struct(*rest), F.col(date)).alias("_r")).select(series, "_r.*")
